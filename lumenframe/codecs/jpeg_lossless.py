"""JPEG lossless (process 14): prediction of each sample from its neighbours, and Huffman codes of the differences.

Differences are computed for whole pictures in NumPy; decoding goes sample by sample, as each prediction needs the
samples before it.
"""

from __future__ import annotations

import struct

import numpy as np

from .jpeg_common import DHT, DRI, EOI, SOF3, SOS, BitReader, BitWriter, Huffman, segment, segments
from .rle import CodecError


def _predict(p: int, a, b, c):
    return (a * 0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[p]


def differences(x: np.ndarray, bits: int, predictor: int) -> np.ndarray:
    """What remains of a plane after prediction, modulo 2^16, as signed numbers."""
    x = x.astype(np.int64)
    a = np.zeros_like(x)
    b, c = a.copy(), a.copy()
    a[:, 1:], b[1:], c[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    guess = _predict(predictor, a, b, c)
    guess[0, 1:] = x[0, :-1]
    guess[1:, 0] = x[:-1, 0]
    guess[0, 0] = 1 << (bits - 1)
    d = (x - guess) & 0xFFFF
    return np.where(d > 32768, d - 65536, d)


def _category(d: np.ndarray) -> np.ndarray:
    n = np.zeros(d.shape, np.int64)
    m = np.abs(d)
    while (m > 0).any():
        n += m > 0
        m >>= 1
    return n


def encode(frame: bytes, rows: int, cols: int, bits: int, samples: int, predictor: int = 1) -> bytes:
    kind = np.dtype("u1") if bits <= 8 else np.dtype("<u2")
    x = np.frombuffer(frame, kind, rows * cols * samples).reshape(rows, cols, samples)
    d = np.stack([differences(x[..., s], bits, predictor) for s in range(samples)], -1).reshape(-1)
    n = _category(d)
    values, counts = np.unique(n, return_counts=True)
    table = Huffman.of(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    w = BitWriter()
    for v, k in zip(d.tolist(), n.tolist(), strict=True):
        w.put(*table.codes[k])
        if k < 16:
            w.signed(v, k)
    frame_head = struct.pack(">BHHB", bits, rows, cols, samples) + b"".join(bytes((s + 1, 0x11, 0)) for s in range(samples))
    scan_head = bytes([samples]) + b"".join(bytes((s + 1, 0)) for s in range(samples)) + bytes((predictor, 0, 0))
    return b"\xff\xd8" + segment(SOF3, frame_head) + segment(DHT, table.body(0)) + segment(SOS, scan_head) + w.done() + bytes((0xFF, EOI))


def decode(data: bytes) -> tuple[bytes, int, int, int, int]:
    """(pixels, rows, cols, bits, samples)."""
    tables: dict[int, Huffman] = {}
    restart, shape, at, scan = 0, None, 0, b""
    for marker, body, after in segments(data):
        if marker == SOF3:
            bits, rows, cols, samples = struct.unpack(">BHHB", body[:6])
            shape = (rows, cols, samples)
        elif 0xC0 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise CodecError(f"process {marker:02X} is not lossless Huffman")
        elif marker == DHT:
            tables |= Huffman.read(body)
        elif marker == DRI:
            (restart,) = struct.unpack(">H", body[:2])
        elif marker == SOS:
            at, scan = after, body
    if shape is None or not at:
        raise CodecError("no frame or scan")
    count = scan[0]
    if count != samples:
        raise CodecError("samples in several scans")
    use = [tables[scan[2 + 2 * k] >> 4] for k in range(count)]
    predictor, shift = scan[1 + 2 * count], scan[3 + 2 * count] & 15
    r = BitReader(data, at)
    out = [[[0] * cols for _ in range(rows)] for _ in range(samples)]
    start, left, fresh = 1 << (bits - shift - 1), restart, True
    for y in range(rows):
        for x in range(cols):
            if restart and not left:
                r.restart()
                left, fresh = restart, True
            left -= 1
            for s in range(samples):
                plane = out[s]
                n = r.symbol(use[s])
                d = 32768 if n == 16 else r.signed(n)
                if fresh:
                    guess = start
                elif y == 0:
                    guess = plane[y][x - 1]
                elif x == 0:
                    guess = plane[y - 1][0]
                else:
                    guess = _predict(predictor, plane[y][x - 1], plane[y - 1][x], plane[y - 1][x - 1])
                plane[y][x] = (guess + d) & 0xFFFF
            fresh = False
    pixels = np.array(out, np.int64).transpose(1, 2, 0) << shift
    return pixels.astype(np.dtype("u1") if bits <= 8 else np.dtype("<u2")).tobytes(), rows, cols, bits, samples
