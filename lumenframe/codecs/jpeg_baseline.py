"""JPEG baseline (process 1): 8-bit DCT coding of one or three components, without sub-sampling when encoding.

Transforms are matrix products over all blocks at once; only the entropy coder goes block by block.
"""

from __future__ import annotations

import struct

import numpy as np

from .jpeg_common import DHT, DQT, DRI, EOI, SOF0, SOS, BitReader, BitWriter, Huffman, segment, segments
from .rle import CodecError

# The standard's example quantisation tables for luminance and chrominance, in natural order.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: Places of an 8 x 8 block along its diagonals, up and down in turn.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_K, _N = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
DCT = np.where(_K == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _N + 1) * _K * np.pi / 16))


def quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(np.int64) for t in (LUMINANCE, CHROMINANCE)]


def to_ycbcr(x: np.ndarray) -> np.ndarray:
    r, g, b = (x[..., k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128], -1)


def to_rgb(x: np.ndarray) -> np.ndarray:
    y, cb, cr = x[..., 0], x[..., 1] - 128, x[..., 2] - 128
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)


def _blocks(plane: np.ndarray) -> np.ndarray:
    rows, cols = (-(-n // 8) * 8 for n in plane.shape)
    x = np.pad(plane, ((0, rows - plane.shape[0]), (0, cols - plane.shape[1])), mode="edge")
    return x.reshape(rows // 8, 8, cols // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)


def _coefficients(plane: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.rint((DCT @ (_blocks(plane) - 128.0) @ DCT.T).reshape(-1, 64) / q).astype(np.int64)[:, ZIGZAG]


def _symbols(z: list[int], dc: int) -> list[tuple[int, int, int]]:
    """(symbol, value, bits) of a block: the difference of its first coefficient, then runs of zeros and values."""
    n = abs(z[0] - dc).bit_length()
    out, run = [(n, z[0] - dc, n)], 0
    last = max((k for k in range(1, 64) if z[k]), default=0)
    for v in z[1 : last + 1]:
        if not v:
            run += 1
            continue
        while run > 15:
            out.append((0xF0, 0, 0))
            run -= 16
        n = abs(v).bit_length()
        out.append((run << 4 | n, v, n))
        run = 0
    if last < 63:
        out.append((0, 0, 0))
    return out


def encode(frame: bytes, rows: int, cols: int, samples: int, quality: int = 90) -> bytes:
    x = np.frombuffer(frame, np.uint8, rows * cols * samples).reshape(rows, cols, samples)
    planes = to_ycbcr(x) if samples == 3 else x.astype(float)
    q = quantisers(quality)
    z = [_coefficients(planes[..., s], q[s > 0]).tolist() for s in range(samples)]
    coded, dc = [], [0] * samples
    for k in range(len(z[0])):
        for s in range(samples):
            coded.append((s > 0, _symbols(z[s][k], dc[s])))
            dc[s] = z[s][k][0]
    used: list[dict[int, int]] = [{}, {}, {}, {}]  # by class: first coefficients and others, luminance and chrominance
    for c, block in coded:
        for i, (sym, _, _) in enumerate(block):
            t = used[2 * c + (i > 0)]
            t[sym] = t.get(sym, 0) + 1
    tables = [Huffman.of(u) if u else None for u in used]
    w = BitWriter()
    for c, block in coded:
        for i, (sym, v, n) in enumerate(block):
            w.put(*tables[2 * c + (i > 0)].codes[sym])
            w.signed(v, n)
    out = b"\xff\xd8" + b"".join(segment(DQT, bytes([k]) + bytes(q[k][ZIGZAG].tolist())) for k in range(1 + (samples == 3)))
    out += segment(SOF0, struct.pack(">BHHB", 8, rows, cols, samples) + b"".join(bytes((s + 1, 0x11, s > 0)) for s in range(samples)))
    out += b"".join(segment(DHT, t.body((k % 2) << 4 | k // 2)) for k, t in enumerate(tables) if t)
    out += segment(SOS, bytes([samples]) + b"".join(bytes((s + 1, 0x11 * (s > 0))) for s in range(samples)) + b"\0\x3f\0")
    return out + w.done() + bytes((0xFF, EOI))


def decode(data: bytes) -> tuple[bytes, int, int, int]:
    """(pixels, rows, cols, samples); sub-sampled components are repeated."""
    tables: dict[int, Huffman] = {}
    q: dict[int, np.ndarray] = {}
    restart, parts, at, scan = 0, [], 0, b""
    for marker, body, after in segments(data):
        if marker == SOF0:
            bits, rows, cols, samples = struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(samples)]
            if bits != 8:
                raise CodecError(f"{bits} bits")
        elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise CodecError(f"process {marker:02X} is not baseline")
        elif marker == DHT:
            tables |= Huffman.read(body)
        elif marker == DQT:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                n = 64 * (1 + wide)
                t = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                q[body[k] & 15] = t
                k += 1 + n
        elif marker == DRI:
            (restart,) = struct.unpack(">H", body[:2])
        elif marker == SOS:
            at, scan = after, body
    if not parts or not at or scan[0] != len(parts):
        raise CodecError("no frame, or components in several scans")
    use = {scan[1 + 2 * k]: scan[2 + 2 * k] for k in range(scan[0])}
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        wide = high = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = -(-cols // (8 * wide)), -(-rows // (8 * high))
    z = [np.zeros((down * p[2], across * p[1], 64), np.int64) for p in parts]
    r, dc = BitReader(data, at), [0] * len(parts)
    for m in range(across * down):
        if restart and m and m % restart == 0:
            r.restart()
            dc = [0] * len(parts)
        for k, (name, h, v, _) in enumerate(parts):
            first, rest = tables[use[name] >> 4], tables[0x10 | use[name] & 15]
            for i in range(v):
                for j in range(h):
                    block = z[k][m // across * v + i, m % across * h + j]
                    dc[k] += r.signed(r.symbol(first))
                    block[0], at_k = dc[k], 1
                    while at_k < 64:
                        sym = r.symbol(rest)
                        n = sym & 15
                        if not n:
                            if sym != 0xF0:
                                break
                            at_k += 16
                            continue
                        at_k += sym >> 4
                        if at_k > 63:
                            raise CodecError("block is too long")
                        block[at_k] = r.signed(n)
                        at_k += 1
    planes = []
    for k, (_, h, v, t) in enumerate(parts):
        c = np.zeros((*z[k].shape[:2], 64))
        c[..., ZIGZAG] = z[k] * q[t]
        x = DCT.T @ c.reshape(-1, 8, 8) @ DCT + 128.0
        x = x.reshape(*z[k].shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(z[k].shape[0] * 8, z[k].shape[1] * 8)
        planes.append(x.repeat(high // v, 0).repeat(wide // h, 1)[:rows, :cols])
    x = np.stack(planes, -1)
    x = to_rgb(x) if len(parts) == 3 else x
    return np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes(), rows, cols, len(parts)
