"""Protocol data units in bytes: the seven types, with the items of an association's negotiation."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

ASSOCIATE_RQ, ASSOCIATE_AC, ASSOCIATE_RJ, P_DATA, RELEASE_RQ, RELEASE_RP, ABORT = range(1, 8)
APPLICATION_CONTEXT = "1.2.840.10008.3.1.1.1"
# Types of the items.
ITEM_APPLICATION, ITEM_CONTEXT_RQ, ITEM_CONTEXT_AC, ITEM_ABSTRACT, ITEM_TRANSFER, ITEM_USER, ITEM_MAX_LENGTH, ITEM_CLASS_UID, ITEM_VERSION = 0x10, 0x20, 0x21, 0x30, 0x40, 0x50, 0x51, 0x52, 0x55


class PduError(ValueError):
    pass


@dataclass
class Context:
    """A presentation context: proposed with its syntaxes, or answered with a result and one."""

    id: int
    abstract: str = ""
    transfers: list[str] = field(default_factory=list)
    result: int = 0


@dataclass
class Pdu:
    kind: int
    called: str = ""
    calling: str = ""
    contexts: list[Context] = field(default_factory=list)
    max_length: int = 16384
    implementation: str = "2.25.212431"
    reason: tuple[int, int, int] = (0, 0, 0)
    values: list[tuple[int, bool, bool, bytes]] = field(default_factory=list)  # context, command, last, data


def _item(kind: int, body: bytes) -> bytes:
    return struct.pack(">BxH", kind, len(body)) + body


def encode(p: Pdu) -> bytes:
    if p.kind in (ASSOCIATE_RQ, ASSOCIATE_AC):
        body = struct.pack(">H2x16s16s32x", 1, p.called.ljust(16).encode(), p.calling.ljust(16).encode()) + _item(ITEM_APPLICATION, APPLICATION_CONTEXT.encode())
        for c in p.contexts:
            names = (_item(ITEM_ABSTRACT, c.abstract.encode()) if p.kind == ASSOCIATE_RQ else b"") + b"".join(_item(ITEM_TRANSFER, t.encode()) for t in c.transfers)
            body += _item(ITEM_CONTEXT_RQ if p.kind == ASSOCIATE_RQ else ITEM_CONTEXT_AC, struct.pack(">BxBx", c.id, c.result) + names)
        body += _item(ITEM_USER, _item(ITEM_MAX_LENGTH, struct.pack(">I", p.max_length)) + _item(ITEM_CLASS_UID, p.implementation.encode()))
    elif p.kind == P_DATA:
        body = b"".join(struct.pack(">IBB", len(d) + 2, c, command | last << 1) + d for c, command, last, d in p.values)
    elif p.kind in (ASSOCIATE_RJ, ABORT):
        body = struct.pack(">xBBB", *p.reason)
    else:
        body = bytes(4)
    return struct.pack(">BxI", p.kind, len(body)) + body


def _items(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise PduError("item is cut off")
        kind, n = struct.unpack(">BxH", data[at : at + 4])
        if at + 4 + n > len(data):
            raise PduError("item is cut off")
        yield kind, data[at + 4 : at + 4 + n]
        at += 4 + n


def decode(data: bytes) -> tuple[Pdu, int]:
    """The first unit of data and where it ends."""
    if len(data) < 6:
        raise PduError("head is cut off")
    kind, n = struct.unpack(">BxI", data[:6])
    body = data[6 : 6 + n]
    if len(body) < n:
        raise PduError("unit is cut off")
    p = Pdu(kind)
    if kind in (ASSOCIATE_RQ, ASSOCIATE_AC):
        _, called, calling = struct.unpack(">H2x16s16s", body[:36])
        p.called, p.calling = called.decode("ascii").strip(), calling.decode("ascii").strip()
        for what, item in _items(body[68:]):
            if what in (ITEM_CONTEXT_RQ, ITEM_CONTEXT_AC):
                c = Context(item[0], result=item[2])
                for sub, name in _items(item[4:]):
                    if sub == ITEM_ABSTRACT:
                        c.abstract = name.decode("ascii")
                    elif sub == ITEM_TRANSFER:
                        c.transfers.append(name.decode("ascii"))
                p.contexts.append(c)
            elif what == ITEM_USER:
                for sub, value in _items(item):
                    if sub == ITEM_MAX_LENGTH:
                        (p.max_length,) = struct.unpack(">I", value)
                    elif sub == ITEM_CLASS_UID:
                        p.implementation = value.decode("ascii")
    elif kind == P_DATA:
        at = 0
        while at < n:
            size, context, flags = struct.unpack(">IBB", body[at : at + 6])
            if size < 2 or at + 4 + size > n:
                raise PduError("value is cut off")
            p.values.append((context, bool(flags & 1), bool(flags & 2), body[at + 6 : at + 4 + size]))
            at += 4 + size
    elif kind in (ASSOCIATE_RJ, ABORT):
        p.reason = struct.unpack(">xBBB", body[:4])
    elif kind not in (RELEASE_RQ, RELEASE_RP):
        raise PduError(f"no such unit: {kind}")
    return p, 6 + n


def fragments(data: bytes, context: int, command: bool, max_length: int = 16384) -> list[Pdu]:
    """A message in units of at most max_length."""
    most = max_length - 6
    parts = [data[i : i + most] for i in range(0, len(data), most)] or [b""]
    return [Pdu(P_DATA, values=[(context, command, i == len(parts) - 1, x)]) for i, x in enumerate(parts)]


def negotiate(request: Pdu, accepted: dict[str, list[str]] | None = None) -> Pdu:
    """The answer to a request: by default every context with its first syntax; else what accepted has (class: syntaxes).

    Results: 0 accepted, 3 class not supported, 4 no syntax supported.
    """
    out = Pdu(ASSOCIATE_AC, request.called, request.calling)
    for c in request.contexts:
        if accepted is None:
            result, syntax = 0, c.transfers[:1]
        elif c.abstract not in accepted:
            result, syntax = 3, []
        else:
            syntax = [t for t in c.transfers if t in accepted[c.abstract]][:1]
            result = 0 if syntax else 4
        out.contexts.append(Context(c.id, transfers=syntax or c.transfers[:1], result=result))
    return out
