"""Elements to Part-10 bytes: the inverse of parse."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from ..dims import EXPLICIT_LE, LONG_LENGTH_VRS, SYNTAX, VR
from .parse import ITEM, ITEM_END, PIXELS, SEQUENCE_END, UNDEFINED, DicomError, DicomFile, Element, Fragments

PAD = {r[0]: bytes([r[2]]) for r in VR}
IMPLEMENTATION_UID, IMPLEMENTATION_NAME = "2.25.212431", "LUMENFRAME"


@dataclass
class Node:
    """An element of a data set to write: a value, or the items of a sequence."""

    tag: int
    vr: str
    raw: bytes = b""
    items: list[list[Node]] | None = None
    fragments: Fragments | None = None


@dataclass
class Writer:
    explicit: bool = True
    big: bool = False
    defined_lengths: bool = False
    out: bytearray = field(default_factory=bytearray)

    def tag(self, tag: int) -> bytes:
        return struct.pack((">" if self.big else "<") + "HH", tag >> 16, tag & 0xFFFF)

    def number(self, n: int, kind: str = "I") -> bytes:
        return struct.pack((">" if self.big else "<") + kind, n)

    def head(self, tag: int, vr: str, length: int) -> bytes:
        if not self.explicit:
            return self.tag(tag) + self.number(length)
        if vr in LONG_LENGTH_VRS:
            return self.tag(tag) + vr.encode() + b"\0\0" + self.number(length)
        if length > 0xFFFF:
            raise DicomError(f"{length} bytes are too long for {vr}")
        return self.tag(tag) + vr.encode() + self.number(length, "H")

    def element(self, n: Node) -> bytes:
        if n.fragments is not None:
            table = struct.pack(f"<{len(n.fragments.offsets)}I", *n.fragments.offsets)
            parts = [p + b"\0" * (len(p) % 2) for p in (table, *n.fragments.fragments)]
            return self.head(n.tag, "OB", UNDEFINED) + b"".join(self.tag(ITEM) + self.number(len(p)) + p for p in parts) + self.tag(SEQUENCE_END) + self.number(0)
        if n.items is not None:
            return self.sequence(n)
        raw = n.raw + PAD.get(n.vr, b"\0") * (len(n.raw) % 2)
        return self.head(n.tag, n.vr, len(raw)) + raw

    def sequence(self, n: Node) -> bytes:
        bodies = [self.dataset(i) for i in n.items or []]
        if self.defined_lengths:
            content = b"".join(self.tag(ITEM) + self.number(len(b)) + b for b in bodies)
            return self.head(n.tag, "SQ", len(content)) + content
        items = b"".join(self.tag(ITEM) + self.number(UNDEFINED) + b + self.tag(ITEM_END) + self.number(0) for b in bodies)
        return self.head(n.tag, "SQ", UNDEFINED) + items + self.tag(SEQUENCE_END) + self.number(0)

    def dataset(self, nodes: list[Node]) -> bytes:
        return b"".join(self.element(n) for n in sorted(nodes, key=lambda n: n.tag))


def tree(elements: list[Element], fragments: Fragments | None = None) -> list[Node]:
    """Rows with paths as nodes that hold their items."""
    root: list[Node] = []
    at: dict[tuple, list[Node]] = {(): root}
    by_tag: dict[tuple, Node] = {}
    for e in sorted(elements, key=lambda e: len(e.path)):
        for depth in range(len(e.path)):
            key = e.path[: depth + 1]
            if key not in at:
                parent = by_tag[(e.path[:depth], key[-1][0])]
                while len(parent.items) <= key[-1][1]:
                    parent.items.append([])
                at[key] = parent.items[key[-1][1]]
        n = Node(e.tag, e.vr, e.raw, [[] for _ in range(e.items)] if e.vr == "SQ" else None, fragments if e.tag == PIXELS and not e.path and fragments else None)
        by_tag[(e.path, e.tag)] = n
        at[e.path].append(n)
    return root


def meta(syntax: str, sop_class: str, sop_instance: str) -> bytes:
    """The meta group with its length; both UIDs are required."""
    if not sop_class or not sop_instance:
        raise DicomError("SOP class and instance are required")
    w = Writer()
    nodes = [Node(0x00020001, "OB", b"\0\1"), Node(0x00020002, "UI", sop_class.encode()), Node(0x00020003, "UI", sop_instance.encode()), Node(0x00020010, "UI", syntax.encode()), Node(0x00020012, "UI", IMPLEMENTATION_UID.encode()), Node(0x00020013, "SH", IMPLEMENTATION_NAME.encode())]
    body = w.dataset(nodes)
    return w.element(Node(0x00020000, "UL", struct.pack("<I", len(body)))) + body


def encode(nodes: list[Node], syntax: str = EXPLICIT_LE, defined_lengths: bool = False, preamble: bytes = bytes(128), sop_class: str | None = None, sop_instance: str | None = None) -> bytes:
    """A whole file. Elements of group 0002 among nodes are left out; the meta group is made anew."""
    body_nodes = [n for n in nodes if n.tag >> 16 != 2]
    text = {n.tag: n.raw.decode("ascii", "replace").strip(" \0") for n in body_nodes if n.tag in (0x00080016, 0x00080018)}
    head = meta(syntax, sop_class or text.get(0x00080016, ""), sop_instance or text.get(0x00080018, ""))
    explicit, little, _, _, compression = SYNTAX.get(syntax, (True, True, False, False, "none"))
    body = Writer(explicit, not little, defined_lengths).dataset(body_nodes)
    if compression == "deflate":
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(body) + z.flush()
        body += b"\0" * (len(body) % 2)
    return preamble + b"DICM" + head + body


@lru_cache(4096)
def _head(tag: int, vr: str, explicit: bool, big: bool) -> tuple[bytes, str]:
    """What goes before an element's length, and the kind of number that this is."""
    w = Writer(explicit, big)
    if not explicit:
        return w.tag(tag), "I"
    return (w.tag(tag) + vr.encode() + b"\0\0", "I") if vr in LONG_LENGTH_VRS else (w.tag(tag) + vr.encode(), "H")


def encode_flat(rows: list[tuple[int, str, bytes]], syntax: str = EXPLICIT_LE) -> bytes:
    """encode() of values alone (tag, representation, bytes) in order of their tags."""
    explicit, little, _, _, compression = SYNTAX.get(syntax, (True, True, False, False, "none"))
    if compression == "deflate":
        return encode([Node(*r) for r in rows], syntax)
    order, parts, text = "<" if little else ">", [], {}
    for tag, vr, raw in rows:
        if tag >> 16 == 2:
            continue
        if tag in (0x00080016, 0x00080018):
            text[tag] = raw.decode("ascii", "replace").strip(" \0")
        if len(raw) % 2:
            raw += PAD.get(vr, b"\0")
        lead, kind = _head(tag, vr, explicit, not little)
        if kind == "H" and len(raw) > 0xFFFF:
            raise DicomError(f"{len(raw)} bytes are too long for {vr}")
        parts += (lead, struct.pack(order + kind, len(raw)), raw)
    return bytes(128) + b"DICM" + meta(syntax, text.get(0x00080016, ""), text.get(0x00080018, "")) + b"".join(parts)


def encode_file(file: DicomFile, syntax: str | None = None) -> bytes:
    return encode(tree(file.elements, file.fragments), syntax or file.syntax)
