"""Values in text as the bytes of a representation."""

from __future__ import annotations

import struct

from .parse import NUMBERS, codec_of


def to_bytes(vr: str, value: str | None, charset: str = "ISO_IR 100", big: bool = False) -> bytes:
    """Little-endian bytes of numbers (several are split at backslashes), text in a character set."""
    if not value:
        return b""
    if vr in NUMBERS:
        whole = NUMBERS[vr] not in "fd"
        return b"".join(struct.pack((">" if big else "<") + NUMBERS[vr], int(v) if whole else float(v)) for v in value.split("\\"))
    if vr == "AT":
        return b"".join(struct.pack((">" if big else "<") + "HH", int(v, 16) >> 16, int(v, 16) & 0xFFFF) for v in value.split("\\"))
    return value.encode(codec_of(charset), "replace")
