"""Run-length coding of frames: a 64-byte header, then a PackBits segment for each byte plane, high byte first."""

from __future__ import annotations

import struct

import numpy as np

HEADER = 64
MOST_SEGMENTS = 15


class CodecError(ValueError):
    pass


def unpack(data: bytes, size: int) -> bytes:
    """size bytes of a PackBits segment."""
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        c = data[at]
        if c < 128:
            out += data[at + 1 : at + 2 + c]
            at += c + 2
        elif c > 128:
            if at + 1 >= n:
                raise CodecError("run without a value")
            out += data[at + 1 : at + 2] * (257 - c)
            at += 2
        else:
            at += 1
    if len(out) < size:
        raise CodecError(f"segment holds {len(out)} of {size} bytes")
    return bytes(out[:size])


def pack(data: bytes) -> bytes:
    """PackBits: runs of three and more as replicates, all else as literals, both of at most 128; even length."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    lengths = np.diff(np.append(starts, len(x)))
    out, literal = bytearray(), 0  # literal: where the bytes not written yet begin

    def flush(stop: int) -> None:
        for a in range(literal, stop, 128):
            b = min(stop, a + 128)
            out.append(b - a - 1)
            out.extend(data[a:b])

    for k in np.flatnonzero(lengths >= 3):
        a, left = int(starts[k]), int(lengths[k])
        flush(a)
        while left >= 3:
            n = min(left, 128)
            out += bytes((257 - n, data[a]))
            a, left = a + n, left - n
        literal = a
    flush(len(data))
    return bytes(out) + b"\0" * (len(out) % 2)


def header(data: bytes) -> list[int]:
    """Offsets of the segments."""
    if len(data) < HEADER:
        raise CodecError("no header")
    count, *offsets = struct.unpack("<16I", data[:HEADER])
    offsets = offsets[:count]
    if not 1 <= count <= MOST_SEGMENTS or offsets[0] != HEADER or any(a >= b for a, b in zip(offsets, [*offsets[1:], len(data) + 1], strict=True)):
        raise CodecError("bad header")
    return offsets


def planes(bits: int, samples: int) -> int:
    return (bits + 7) // 8 * samples


def validate(data: bytes, bits: int, samples: int) -> str | None:
    """What is wrong with a frame's header, if anything."""
    try:
        found = header(data)
    except CodecError as e:
        return str(e)
    return None if len(found) == planes(bits, samples) else f"{len(found)} segments for {planes(bits, samples)} planes"


def decode(data: bytes, rows: int, cols: int, bits: int, samples: int) -> bytes:
    """Pixels with samples interleaved, little-endian."""
    offsets, width = header(data), (bits + 7) // 8
    if len(offsets) != width * samples:
        raise CodecError(f"{len(offsets)} segments for {width * samples} planes")
    n = rows * cols
    parts = [np.frombuffer(unpack(data[a:b], n), np.uint8) for a, b in zip(offsets, [*offsets[1:], len(data)], strict=True)]
    out = np.empty((n, samples, width), np.uint8)
    for k, p in enumerate(parts):
        out[:, k // width, width - 1 - k % width] = p
    return out.tobytes()


def encode(frame: bytes, rows: int, cols: int, bits: int, samples: int) -> bytes:
    width = (bits + 7) // 8
    x = np.frombuffer(frame, np.uint8, rows * cols * samples * width).reshape(-1, samples, width)
    parts = [pack(x[:, s, width - 1 - w].tobytes()) for s in range(samples) for w in range(width)]
    if len(parts) > MOST_SEGMENTS:
        raise CodecError(f"{len(parts)} planes")
    offsets, at = [], HEADER
    for p in parts:
        offsets.append(at)
        at += len(p)
    return struct.pack("<16I", len(parts), *offsets, *[0] * (MOST_SEGMENTS - len(parts))) + b"".join(parts)


def offset_table(frames: list[bytes]) -> list[int]:
    """Where each frame's item begins, with its 8-byte head; empty for a single frame."""
    if len(frames) < 2:
        return []
    out, at = [], 0
    for f in frames:
        out.append(at)
        at += 8 + len(f) + len(f) % 2
    return out
