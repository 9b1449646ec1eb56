"""Part-10 bytes to elements: pure Python over a memoryview, one file at a time, without Spark.

parse() reads a whole file: header, meta group, then the data set by its transfer syntax, nested sequences included.
Items of a sequence come as elements of their own with the path of their item; character set and pixel context go down
from a data set to its items.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..dims import CHARSETS, DICTIONARY, EXPLICIT_LE, IMPLICIT_LE, LONG_LENGTH_VRS, STRING_VRS, SYNTAX, VR

UNDEFINED = 0xFFFFFFFF
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
PIXELS, EXTENDED_OFFSETS = 0x7FE00010, 0x7FE00001
CODECS = dict(CHARSETS)
DELIMITER = {r[0]: r[7] for r in VR}
KNOWN_VRS = {r[0] for r in VR}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "UV": "Q", "SV": "q", "FL": "f", "FD": "d"}


class DicomError(ValueError):
    pass


@dataclass
class ReadOptions:
    """header: require (a preamble with DICM), optional (without, if it looks like a data set) or ignore (raw data set)."""

    header: str = "require"
    pixel_data: str = "load"  # or "skip"
    max_length: int = 256 << 20
    max_depth: int = 128
    max_items: int = 100_000
    stop_on_error: bool = True
    #: Representations by tag beside the seed's, for files that don't state them (dictionaries.representations()).
    dictionary: dict[int, str] = field(default_factory=dict)
    #: Called with the length of native pixel data and what is known of it (bits, signed): whether to load it.
    pixel_filter: Callable[[int, dict], bool] | None = None

    @staticmethod
    def strict() -> ReadOptions:
        return ReadOptions()

    @staticmethod
    def lenient() -> ReadOptions:
        return ReadOptions(header="optional", stop_on_error=False)

    @staticmethod
    def permissive() -> ReadOptions:
        return ReadOptions(header="ignore", stop_on_error=False, max_length=1 << 31)


@dataclass
class Element:
    tag: int
    vr: str
    length: int
    raw: bytes
    pos: int
    path: tuple[tuple[int, int], ...] = ()
    codec: str = "ascii"
    big: bool = False
    items: int = 0  # of a sequence, empty ones included
    body: int = -1  # the place of the value in the file, where it has one there

    @property
    def text(self) -> str:
        return self.raw.decode(self.codec, "replace").rstrip(" \0")

    @property
    def values(self) -> list[str] | None:
        if self.vr not in STRING_VRS:
            return None
        mark = DELIMITER.get(self.vr)
        return [v.strip(" \0") if mark else v for v in (self.text.split(mark) if mark else [self.text])]

    @property
    def numbers(self) -> list | None:
        if self.vr == "AT":
            two = struct.unpack(("><"[not self.big]) + "H" * (len(self.raw) // 2), self.raw[: len(self.raw) // 4 * 4])
            return [a << 16 | b for a, b in zip(two[::2], two[1::2], strict=True)]
        kind = NUMBERS.get(self.vr)
        if kind is None or len(self.raw) % struct.calcsize(kind):
            return None
        return list(struct.unpack((">" if self.big else "<") + kind * (len(self.raw) // struct.calcsize(kind)), self.raw))


@dataclass
class Fragments:
    """Encapsulated pixel data."""

    offsets: list[int]
    fragments: list[bytes]

    @property
    def size(self) -> int:
        """Bytes of all fragments."""
        return sum(map(len, self.fragments))

    def frames(self, count: int) -> list[bytes]:
        """Frames by the offset table where there is one; one fragment a frame, or all in one frame, otherwise."""
        if count <= 1:
            return [b"".join(self.fragments)]
        if len(self.offsets) == count:
            starts, at = [], 0
            for f in self.fragments:
                starts.append(at)
                at += len(f) + 8
            edges = [*self.offsets, at]
            return [b"".join(f for f, s in zip(self.fragments, starts, strict=True) if a <= s < b) for a, b in zip(edges, edges[1:], strict=False)]
        return list(self.fragments)


@dataclass
class DicomFile:
    preamble: bytes = b""
    meta: list[Element] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    syntax: str = EXPLICIT_LE
    fragments: Fragments | None = None
    error: str | None = None

    def get(self, tag: int) -> Element | None:
        return next((e for e in self.elements if e.tag == tag and not e.path), None)

    def first(self) -> dict[int, Element]:
        """The first element of each tag outside of sequences."""
        found: dict[int, Element] = {}
        for e in self.elements:
            if not e.path:
                found.setdefault(e.tag, e)
        return found

    def text(self, tag: int, first: dict[int, Element] | None = None) -> str | None:
        e = self.get(tag) if first is None else first.get(tag)
        return None if e is None else e.text

    def number(self, tag: int, first: dict[int, Element] | None = None) -> int | None:
        e = self.get(tag) if first is None else first.get(tag)
        if e is None:
            return None
        if e.numbers:
            return int(e.numbers[0])
        try:
            return int(e.text.split("\\")[0])
        except ValueError:
            return None


def codec_of(term: str) -> str:
    first = term.split("\\")[0].strip(" \0").upper().replace("ISO IR ", "ISO_IR ").replace("ISO-IR ", "ISO_IR ")
    return CODECS.get(first, "ascii")


def _find_header(data: memoryview, options: ReadOptions) -> int:
    """Where the meta group, or the data set of a file without one, begins."""
    if bytes(data[128:132]) == b"DICM":
        return 132
    if bytes(data[:4]) == b"DICM":
        return 4
    if options.header == "require":
        raise DicomError("no DICM prefix")
    if options.header == "optional":
        looks = len(data) >= 8 and (bytes(data[:2]) in (b"\x08\0", b"\x02\0") or all(65 <= c <= 90 for c in data[4:6]))
        if not looks:
            raise DicomError("neither a DICM prefix nor a data set")
    return 0


class _Reader:
    def __init__(self, data: memoryview, explicit: bool, big: bool, options: ReadOptions):
        self.data, self.explicit, self.big, self.options = data, explicit, big, options
        self.order = ">" if big else "<"
        self.items = 0
        self.fragments: Fragments | None = None
        self.inflated = False

    def tag(self, at: int) -> int:
        if at + 4 > len(self.data):
            raise DicomError(f"cut off at {at}")
        group, element = struct.unpack_from(self.order + "HH", self.data, at)
        return group << 16 | element

    def head(self, at: int) -> tuple[int, str, int, int]:
        """Tag, representation, length and place of the value."""
        tag = self.tag(at)
        if at + 8 > len(self.data):
            raise DicomError(f"cut off at {at}")
        if tag >> 16 == 0xFFFE:
            return tag, "", struct.unpack_from(self.order + "I", self.data, at + 4)[0], at + 8
        if self.explicit:
            vr = bytes(self.data[at + 4 : at + 6]).decode("latin-1")
            if vr in LONG_LENGTH_VRS or vr not in KNOWN_VRS:
                if at + 12 > len(self.data):
                    raise DicomError(f"cut off at {at}")
                return tag, vr if vr in KNOWN_VRS else "UN", struct.unpack_from(self.order + "I", self.data, at + 8)[0], at + 12
            return tag, vr, struct.unpack_from(self.order + "H", self.data, at + 6)[0], at + 8
        vr = self.options.dictionary.get(tag) or DICTIONARY.get(tag, "UL" if not tag & 0xFFFF else "LO" if tag >> 16 & 1 and 0x10 <= tag & 0xFFFF <= 0xFF else "UN")
        return tag, vr, struct.unpack_from(self.order + "I", self.data, at + 4)[0], at + 8

    def dataset(self, at: int, end: int, path: tuple, codec: str, context: dict, in_item: bool = False, stop_after: int | None = None) -> tuple[list[Element], int]:
        """Elements from a place up to end, or to the end of an item of undefined length; and where they end."""
        out: list[Element] = []
        context = dict(context)
        while at < end:
            tag, vr, length, body = self.head(at)
            if tag == ITEM_END and in_item:
                return out, body
            if stop_after is not None and tag >> 16 != stop_after:
                return out, at
            if tag == PIXELS:
                vr = "OB" if length == UNDEFINED else vr if self.explicit and vr != "UN" else "OW" if context.get("bits", 16) > 8 else "OB"
            elif tag in (0x00280106, 0x00280107, 0x00280120) and not self.explicit:
                vr = "SS" if context.get("signed") else "US"
            if length == UNDEFINED and tag == PIXELS:
                self.fragments, stop = self.encapsulated(body)
                out.append(Element(tag, vr, UNDEFINED, b"", at, path, codec, self.big))
            elif vr == "SQ" or length == UNDEFINED:
                more, stop, count = self.sequence(tag, body, length, path, codec, context)
                out += [Element(tag, "SQ", length, b"", at, path, codec, self.big, count), *more]
            else:
                if length > self.options.max_length:
                    raise DicomError(f"element of {length} bytes at {at}")
                stop = body + length
                if stop > end:
                    raise DicomError(f"value cut off at {at}")
                skip = tag == PIXELS and (self.options.pixel_data == "skip" or self.options.pixel_filter is not None and not self.options.pixel_filter(length, context))
                e = Element(tag, vr, length, b"" if skip else bytes(self.data[body:stop]), at, path, codec, self.big, body=-1 if self.inflated else body)
                if tag == 0x00080005:
                    codec = codec_of(e.raw.decode("ascii", "replace"))
                elif tag == 0x00280100 and e.numbers:
                    context["bits"] = e.numbers[0]
                elif tag == 0x00280103 and e.numbers:
                    context["signed"] = e.numbers[0] == 1
                e.codec = codec if vr in ("LO", "LT", "PN", "SH", "ST", "UC", "UT") else "latin-1"
                out.append(e)
            at = stop
        if in_item and end == len(self.data) and stop_after is None:
            raise DicomError("item without end")
        return out, at

    def sequence(self, tag: int, at: int, length: int, path: tuple, codec: str, context: dict) -> tuple[list[Element], int, int]:
        if len(path) + 1 > self.options.max_depth:
            raise DicomError("sequences nest too deep")
        end = len(self.data) if length == UNDEFINED else at + length
        if end > len(self.data):
            raise DicomError(f"sequence cut off at {at}")
        out, number = [], 0
        while at < end:
            mark, _, size, body = self.head(at)
            if mark == SEQUENCE_END:
                return out, body, number
            if mark != ITEM:
                raise DicomError(f"no item at {at}")
            self.items += 1
            if self.items > self.options.max_items:
                raise DicomError("too many items")
            inner = (*path, (tag, number))
            if size == UNDEFINED:
                more, at = self.dataset(body, len(self.data), inner, codec, context, in_item=True)
            else:
                if body + size > end:
                    raise DicomError(f"item cut off at {at}")
                more, at = self.dataset(body, body + size, inner, codec, context)
            out += more
            number += 1
        if length == UNDEFINED:
            raise DicomError("sequence without end")
        return out, at, number

    def encapsulated(self, at: int) -> tuple[Fragments, int]:
        parts: list[bytes] = []
        while True:
            mark, _, size, body = self.head(at)
            if mark == SEQUENCE_END:
                break
            if mark != ITEM or body + size > len(self.data):
                raise DicomError(f"bad fragment at {at}")
            parts.append(bytes(self.data[body : body + size]))
            at = body + size
        table = parts[0] if parts else b""
        return Fragments(list(struct.unpack(f"<{len(table) // 4}I", table[: len(table) // 4 * 4])), parts[1:] if self.options.pixel_data == "load" else []), body


def parse(content: bytes, options: ReadOptions | None = None) -> DicomFile:
    """All of a file; with stop_on_error unset, what was read before an error, and the error."""
    options = options or ReadOptions()
    out = DicomFile()
    try:
        data = memoryview(content)
        at = _find_header(data, options)
        if at >= 4:
            out.preamble = bytes(data[: at - 4])
        syntax = None
        if at or (len(data) >= 6 and bytes(data[:2]) == b"\x02\0"):
            out.meta, at = _Reader(data, True, False, options).dataset(at, len(data), (), "ascii", {}, stop_after=2)
            syntax = next((e.raw.decode("ascii", "replace").strip(" \0") for e in out.meta if e.tag == 0x00020010), None)
        if syntax is None:
            syntax = EXPLICIT_LE if all(65 <= c <= 90 for c in data[at + 4 : at + 6]) and len(data) >= at + 6 else IMPLICIT_LE
        out.syntax = syntax
        explicit, little, _, _, compression = SYNTAX.get(syntax, (True, True, False, False, "none"))
        if compression == "deflate":
            data, at = memoryview(zlib.decompressobj(-15).decompress(data[at:])), 0
        reader = _Reader(data, explicit, not little, options)
        reader.inflated = compression == "deflate"
        out.elements, _ = _collect(reader, at, out)
        out.fragments = reader.fragments
        table = out.get(EXTENDED_OFFSETS)
        if out.fragments is not None and not out.fragments.offsets and table is not None:
            out.fragments.offsets = list(struct.unpack(f"<{len(table.raw) // 8}Q", table.raw[: len(table.raw) // 8 * 8]))
    except (DicomError, struct.error, zlib.error, UnicodeDecodeError) as e:
        if options.stop_on_error:
            raise e if isinstance(e, DicomError) else DicomError(str(e)) from None
        out.error = str(e)
    return out


def _collect(reader: _Reader, at: int, out: DicomFile) -> tuple[list[Element], int]:
    """The data set; what was read before an error stays in out."""
    if reader.options.stop_on_error:
        return reader.dataset(at, len(reader.data), (), "ascii", {})
    found: list[Element] = []
    codec, context, end = "ascii", {}, len(reader.data)
    while at < end:  # an element at a time, so that an error costs only what follows
        try:
            one, at = _single(reader, at, end, codec, context)
        except (DicomError, struct.error) as e:
            out.error = str(e)
            break
        for e in one:
            if not e.path and e.tag == 0x00080005:
                codec = codec_of(e.raw.decode("ascii", "replace"))
            if not e.path and e.tag == 0x00280100 and e.numbers:
                context["bits"] = e.numbers[0]
            if not e.path and e.tag == 0x00280103 and e.numbers:
                context["signed"] = e.numbers[0] == 1
        found += one
    return found, at


def _single(reader: _Reader, at: int, end: int, codec: str, context: dict) -> tuple[list[Element], int]:
    """One element with what it holds."""
    tag, vr, length, body = reader.head(at)
    if length != UNDEFINED and vr != "SQ":
        if body + length > end:
            raise DicomError(f"value cut off at {at}")
        return reader.dataset(at, body + length, (), codec, context)
    if tag == PIXELS:
        reader.fragments, stop = reader.encapsulated(body)
        return [Element(tag, "OB", UNDEFINED, b"", at, (), codec, reader.big)], stop
    more, stop, count = reader.sequence(tag, body, length, (), codec, context)
    return [Element(tag, "SQ", length, b"", at, (), codec, reader.big, count), *more], stop


def iter_frames(file: DicomFile) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of each frame of a file's pixel data."""
    count = file.number(0x00280008) or 1
    if file.fragments is not None:
        yield from enumerate(file.fragments.frames(count))
        return
    e = file.get(PIXELS)
    if e is None:
        return
    rows, cols = file.number(0x00280010) or 0, file.number(0x00280011) or 0
    size = rows * cols * (file.number(0x00280002) or 1) * (((file.number(0x00280100) or 16) + 7) // 8)
    for i in range(count):
        if size and (i + 1) * size <= len(e.raw):
            yield i, e.raw[i * size : (i + 1) * size]
