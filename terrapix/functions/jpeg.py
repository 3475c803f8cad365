"""Baseline JPEG: 8-bit gray or YCbCr, sequential, with any sampling factors when read and none when written."""

from __future__ import annotations

import math
import struct

import numpy as np

# The example quantisation tables for luminance and chrominance, row by row.
LUMINANCE = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
CHROMINANCE = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"

_k = np.arange(8)
DCT = np.where(_k[:, None] == 0, math.sqrt(1 / 8), 0.5 * np.cos((2 * _k[None, :] + 1) * _k[:, None] * math.pi / 16))
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _table(text: str, quality: int) -> np.ndarray:
    base = np.array(text.split(), float)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((base * scale + 50) / 100), 1, 255).reshape(8, 8)


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths near the ideal, at most 16, with the code of all ones left free."""
    total = sum(counts.values()) + 1
    return {s: min(16, max(1, math.ceil(-math.log2(n / total)))) for s, n in counts.items()}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    out, code, width = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - width
        width = lengths[s]
        out[s] = (code, width)
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode(image: np.ndarray, quality: int = 90) -> bytes:
    """Gray or RGB, array (height, width, 1 or 3)."""
    h, w, n = image.shape
    x = image.astype(float)
    if n == 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        x = np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128], axis=2)
    x = np.pad(x, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    rows, cols = x.shape[0] // 8, x.shape[1] // 8
    tables = [_table(LUMINANCE, quality), _table(CHROMINANCE, quality)]
    symbols: list[tuple[int, int, int, int]] = []  # table, symbol, extra bits, their number
    before = [0] * n
    blocks = [np.round(DCT @ x[..., c].reshape(rows, 8, cols, 8).transpose(0, 2, 1, 3) @ DCT.T / tables[min(c, 1)]).astype(int).reshape(rows * cols, 64)[:, ZIGZAG] for c in range(n)]

    def number(v: int) -> tuple[int, int]:
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    for k in range(rows * cols):
        for c in range(n):
            z = blocks[c][k]
            size, bits = number(int(z[0]) - before[c])
            before[c] = int(z[0])
            symbols.append((2 * min(c, 1), size, bits, size))
            at = 0
            for i in np.flatnonzero(z[1:]).tolist():
                run = i - at
                while run > 15:
                    symbols.append((2 * min(c, 1) + 1, 0xF0, 0, 0))
                    run -= 16
                size, bits = number(int(z[i + 1]))
                symbols.append((2 * min(c, 1) + 1, run << 4 | size, bits, size))
                at = i + 1
            if at < 63:
                symbols.append((2 * min(c, 1) + 1, 0, 0, 0))
    kinds = range(2 if n == 1 else 4)
    counts: list[dict[int, int]] = [{} for _ in kinds]
    for t, s, _, _ in symbols:
        counts[t][s] = counts[t].get(s, 0) + 1
    lengths = [_lengths(c) for c in counts]
    codes = [_codes(x) for x in lengths]
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for t in range(min(n, 2)):
        out += _segment(0xDB, bytes([t]) + bytes(tables[t].reshape(64)[ZIGZAG].astype(np.uint8)))
    out += _segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(n)))
    for t in kinds:
        order = sorted(lengths[t], key=lambda s: (lengths[t][s], s))
        per = bytes(sum(v == k for v in lengths[t].values()) for k in range(1, 17))
        out += _segment(0xC4, bytes([(t % 2) << 4 | t // 2]) + per + bytes(order))
    out += _segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(n)) + bytes([0, 63, 0]))
    acc = held = 0
    body = bytearray()
    for t, s, bits, size in symbols:
        code, width = codes[t][s]
        acc = ((acc << width) | code) << size | bits
        held += width + size
        while held >= 8:
            held -= 8
            byte = (acc >> held) & 255
            body.append(byte)
            if byte == 255:
                body.append(0)
        acc &= (1 << held) - 1
    if held:
        byte = ((acc << (8 - held)) | ((1 << (8 - held)) - 1)) & 255
        body.append(byte)
        if byte == 255:
            body.append(0)
    return out + bytes(body) + b"\xff\xd9"


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.acc, self.held = data, at, 0, 0

    def take(self, n: int) -> int:
        while self.held < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if byte == 255 and self.data[self.at + 1 : self.at + 2] == b"\0":
                self.at += 2
            elif byte == 255:
                byte = 0  # a marker: the rest reads as zeros
            else:
                self.at += 1
            self.acc = self.acc << 8 | byte
            self.held += 8
        self.held -= n
        out = self.acc >> self.held
        self.acc &= (1 << self.held) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for width in range(1, 17):
            code = code << 1 | self.take(1)
            if (width, code) in codes:
                return codes[width, code]
        raise ValueError("not a Huffman code")

    def number(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def restart(self) -> None:
        self.acc = self.held = 0
        while self.data[self.at : self.at + 1] != b"\xff" or not 0xD0 <= self.data[self.at + 1] <= 0xD7:
            self.at += 1
        self.at += 2


def decode(data: bytes) -> np.ndarray:
    """(height, width, 1 or 3); ValueError for progressive files."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, tables, huffman, parts, interval = 2, {}, {}, [], 0
    h = w = 0
    while True:
        marker = data[at + 1]
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                table = np.zeros(64)
                table[ZIGZAG] = values
                tables[body[0] & 15] = table.reshape(8, 8)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                code, k, codes = 0, 17, {}
                for width in range(1, 17):
                    for _ in range(body[width]):
                        codes[width, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huffman[body[0]] = codes
                body = body[k:]
        elif marker in (0xC0, 0xC1):
            _, h, w, count = struct.unpack_from(">BHHB", body)
            parts = [[*body[6 + 3 * c : 9 + 3 * c]] for c in range(count)]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline JPEG")
        elif marker == 0xDA:
            how = {body[1 + 2 * c]: body[2 + 2 * c] for c in range(body[0])}
            break
    hs, vs = [p[1] >> 4 for p in parts], [p[1] & 15 for p in parts]
    across, down = -(-w // (8 * max(hs))), -(-h // (8 * max(vs)))
    planes = [np.zeros((down * v * 8, across * x * 8)) for x, v in zip(hs, vs, strict=True)]
    bits, before = _Bits(data, at), [0] * len(parts)
    for k in range(across * down):
        if interval and k and k % interval == 0:
            bits.restart()
            before = [0] * len(parts)
        for c, (name, _, q) in enumerate(parts):
            dc, ac = huffman[how[name] >> 4], huffman[0x10 | how[name] & 15]
            for y in range(vs[c]):
                for x in range(hs[c]):
                    z = np.zeros(64)
                    before[c] += bits.number(bits.symbol(dc))
                    z[0], i = before[c], 1
                    while i < 64:
                        s = bits.symbol(ac)
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            z[ZIGZAG[i]] = bits.number(s & 15)
                        i += 1
                    r, col = (k // across * vs[c] + y) * 8, (k % across * hs[c] + x) * 8
                    planes[c][r : r + 8, col : col + 8] = DCT.T @ (z.reshape(8, 8) * tables[q]) @ DCT
    full = [np.repeat(np.repeat(p, max(vs) // v, axis=0), max(hs) // x, axis=1)[:h, :w] + 128 for p, x, v in zip(planes, hs, vs, strict=True)]
    if len(full) == 3:
        y, cb, cr = full
        full = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    return np.clip(np.round(np.stack(full, axis=2)), 0, 255).astype(np.uint8)
