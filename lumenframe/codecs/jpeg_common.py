"""What the two JPEG processes share: markers, Huffman tables and bits."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

from .rle import CodecError

SOI, EOI, SOS, DHT, DQT, DRI, SOF0, SOF3 = 0xD8, 0xD9, 0xDA, 0xC4, 0xDB, 0xDD, 0xC0, 0xC3


def segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, contents, where what follows begins) up to the first scan."""
    if data[:2] != b"\xff\xd8":
        raise CodecError("no JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise CodecError(f"no marker at {at}")
        marker = data[at + 1]
        if marker in (0xFF, EOI) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        yield marker, data[at + 4 : at + 2 + n], at + 2 + n
        if marker == SOS:
            return
        at += 2 + n


def segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


class Huffman:
    """A table by the numbers of codes of each length and their symbols in order."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.codes: dict[int, tuple[int, int]] = {}
        self.lookup: list[tuple[int, int] | None] = [None] * 65536
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                s = symbols[at]
                self.codes[s] = (code, length)
                low = code << (16 - length)
                self.lookup[low : low + (1 << (16 - length))] = [(s, length)] * (1 << (16 - length))
                code, at = code + 1, at + 1
            code <<= 1

    @staticmethod
    def read(body: bytes) -> dict[int, Huffman]:
        out, at = {}, 0
        while at < len(body):
            kind, counts = body[at], body[at + 1 : at + 17]
            n = sum(counts)
            out[kind] = Huffman(counts, body[at + 17 : at + 17 + n])
            at += 17 + n
        return out

    @staticmethod
    def of(frequencies: dict[int, int]) -> Huffman:
        """A table for these symbols with codes of at most 16 bits, none of ones alone."""
        # a dummy symbol takes the code of all ones; too long codes are shortened by flattening the frequencies
        f = {s: n for s, n in frequencies.items() if n}
        while True:
            heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(f.items()))] + [(0, -1, [-1])]
            heapq.heapify(heap)
            depth = dict.fromkeys([*f, -1], 0)
            k = len(heap)
            while len(heap) > 1:
                (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
                for s in (*x, *y):
                    depth[s] += 1
                heapq.heappush(heap, (a + b, k, x + y))
                k += 1
            if max(depth.values()) <= 16:
                break
            f = {s: (n + 1) // 2 + 1 for s, n in f.items()}
        longest = max(depth.values())
        depth[-1] = longest  # the dummy gets the last code of the longest length
        order = sorted((d, s) for s, d in depth.items() if s >= 0)
        return Huffman(bytes(sum(d == n for d, _ in order) for n in range(1, 17)), bytes(s for _, s in order))

    def body(self, kind: int) -> bytes:
        return bytes([kind]) + bytes(self.counts) + bytes(self.symbols)


class BitReader:
    def __init__(self, data: bytes, at: int):
        end = at
        while True:  # the scan ends at the first marker that is no restart
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
                continue
            break
        self.parts = []
        start = k = at
        while k < end:
            k = data.find(b"\xff", k, end)
            if k < 0 or k + 1 >= end:
                break
            if 0xD0 <= data[k + 1] <= 0xD7:
                self.parts.append(data[start:k])
                start = k + 2
            k += 2
        self.parts.append(data[start:end])
        self.part = -1
        self.restart()

    def restart(self) -> None:
        self.part += 1
        if self.part >= len(self.parts):
            raise CodecError("scan ends early")
        self.data = self.parts[self.part].replace(b"\xff\x00", b"\xff")
        self.at = self.held = self.bits = 0

    def need(self, n: int) -> None:
        while self.bits < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            if self.at > len(self.data) + 8:
                raise CodecError("scan is cut off")
            self.at += 1
            self.held = (self.held << 8 | byte) & 0xFFFFFFFFFFFF
            self.bits += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.bits -= n
        return self.held >> self.bits & ((1 << n) - 1)

    def symbol(self, table: Huffman) -> int:
        self.need(16)
        found = table.lookup[self.held >> (self.bits - 16) & 0xFFFF]
        if found is None:
            raise CodecError("no such code")
        self.bits -= found[1]
        return found[0]

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class BitWriter:
    def __init__(self) -> None:
        self.out, self.held, self.bits = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.held = self.held << n | value
        self.bits += n
        while self.bits >= 8:
            self.bits -= 8
            byte = self.held >> self.bits & 255
            self.out.append(byte)
            if byte == 255:
                self.out.append(0)
        self.held &= (1 << self.bits) - 1

    def signed(self, value: int, n: int) -> None:
        if n:
            self.put(value if value >= 0 else value + (1 << n) - 1, n)

    def done(self) -> bytes:
        if self.bits:
            self.put((1 << (8 - self.bits)) - 1, 8 - self.bits)
        return bytes(self.out)
