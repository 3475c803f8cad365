"""Sample codecs: raw, deflate, PackBits, LZW, PNG, and TIFF files. Images are arrays (height, width, channels)."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def packbits_encode(data: bytes) -> bytes:
    out, k, n = bytearray(), 0, len(data)
    while k < n:
        run = k + 1
        while run < n and run - k < 128 and data[run] == data[k]:
            run += 1
        if run - k >= 2:
            out += bytes((257 - (run - k), data[k]))
            k = run
            continue
        end = k + 1
        while end < n and end - k < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out.append(end - k - 1)
        out += data[k:end]
        k = end
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        head = data[k]
        if head < 128:
            out += data[k + 1 : k + 2 + head]
            k += head + 2
        elif head == 128:
            k += 1
        else:
            out += data[k + 1 : k + 2] * (257 - head)
            k += 2
    return bytes(out)


CLEAR, END = 256, 257


def lzw_encode(data: bytes) -> bytes:
    """TIFF's variant: most significant bit first, code width grown one code early."""
    out, acc, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, nxt = 9, 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = (acc << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    def code_of(s: bytes) -> int:
        return s[0] if len(s) == 1 else table[s]

    put(CLEAR)
    held = b""
    for k in range(len(data)):
        more = held + data[k : k + 1]
        if len(more) == 1 or more in table:
            held = more
            continue
        put(code_of(held))
        table[more] = nxt
        nxt += 1
        if nxt == (1 << width) and width < 12:
            width += 1
        elif nxt == 4095:
            put(CLEAR)
            table, width, nxt = {}, 9, 258
        held = data[k : k + 1]
    if held:
        put(code_of(held))
        nxt += 1
        if nxt == (1 << width) and width < 12:
            width += 1
    put(END)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out = bytearray()
    table: list[bytes] = []
    width, acc, bits, prev = 9, 0, 0, b""
    first = [bytes((k,)) for k in range(256)] + [b"", b""]
    for byte in data:
        acc = (acc << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = (acc >> bits) & ((1 << width) - 1)
        acc &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, prev = list(first), 9, b""
            continue
        if not table:
            table = list(first)
        if not prev:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out += entry
        prev = entry
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
    return bytes(out)


def png_encode(image: np.ndarray, palette: list[tuple[int, int, int, int]] | None = None) -> bytes:
    """8-bit gray, gray and alpha, RGB or RGBA; with a palette, one channel of indices."""
    h, w, n = image.shape
    kind = 3 if palette else {1: 0, 2: 4, 3: 2, 4: 6}[n]
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.zeros((h, 1 + w * n), np.uint8)
    rows[:, 1:] = image.reshape(h, w * n)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
    if palette:
        out += chunk(b"PLTE", bytes(v for p in palette for v in p[:3])) + chunk(b"tRNS", bytes(p[3] for p in palette))
    return out + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _png_chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def png_with_palette(data: bytes, palette: list[tuple[int, int, int, int]]) -> bytes:
    """A one-channel PNG as a palette PNG: the header's colour type and two chunks change, no sample is decoded."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    out = data[:8]
    for name, body in _png_chunks(data):
        if name == b"IHDR":
            out += chunk(name, body[:9] + b"\x03" + body[10:]) + chunk(b"PLTE", bytes(v for p in palette for v in p[:3])) + chunk(b"tRNS", bytes(p[3] for p in palette))
        elif name not in (b"PLTE", b"tRNS"):
            out += chunk(name, body)
    return out


def png_decode(data: bytes) -> np.ndarray:
    """8-bit images without interlacing; a palette is applied, with its transparency."""
    w = h = depth = kind = 0
    body, palette, alpha = b"", None, b""
    for name, x in _png_chunks(data):
        if name == b"IHDR":
            w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", x)
            if depth != 8 or laced:
                raise ValueError("only 8-bit PNG without interlacing")
        elif name == b"PLTE":
            palette = np.frombuffer(x, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = x
        elif name == b"IDAT":
            body += x
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    plain = not raw[:, 0].any()
    out = raw[:, 1:] if plain else np.zeros((h, w * n), np.uint8)
    for y in range(0 if plain else h):
        how, line = raw[y, 0], raw[y, 1:]
        up = out[y - 1] if y else np.zeros(w * n, np.uint8)
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = line + up
        elif how == 1:
            out[y] = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).reshape(-1)
        else:
            row = out[y]
            for k in range(w * n):
                a, b, c = int(row[k - n]) if k >= n else 0, int(up[k]), int(up[k - n]) if k >= n else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[k] = (int(line[k]) + guess) & 255
    image = out.reshape(h, w, n)
    if kind == 3:
        rgb = palette[image[..., 0]]
        if not alpha:
            return rgb
        a = np.full(len(palette), 255, np.uint8)
        a[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        return np.concatenate([rgb, a[image[..., :1]]], axis=2)
    return image


CODECS = {"raw": (bytes, bytes), "zip": (lambda b: zlib.compress(b, 6), zlib.decompress), "pkb": (packbits_encode, packbits_decode), "lzw": (lzw_encode, lzw_decode)}
# The compression codes of TIFF.
TIFF_CODES = {"raw": 1, "lzw": 5, "zip": 8, "pkb": 32773}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
FORMS = {1: "B", 2: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


def encode(image: np.ndarray, codec: str) -> bytes:
    return png_encode(image) if codec == "png" else CODECS[codec][0](np.ascontiguousarray(image).tobytes())


def decode(data: bytes, codec: str, shape: tuple[int, int, int], dtype: str) -> np.ndarray:
    """Raises ValueError for an unknown codec."""
    if codec == "png":
        return png_decode(data)
    if codec not in CODECS:
        raise ValueError(f"no codec {codec}")
    return np.frombuffer(CODECS[codec][1](data), dtype).reshape(shape)


def tiff_ifd(tags: list[tuple[int, int, list]], at: int) -> bytes:
    """A TIFF directory for offset at: entries, then the values that do not fit in them."""
    tail_at, head, tail = at + 2 + 12 * len(tags) + 4, struct.pack("<H", len(tags)), b""
    for tag, kind, values in sorted(tags):
        body = struct.pack(f"<{len(values)}{FORMS[kind]}", *values)
        if len(body) <= 4:
            head += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, len(values), tail_at + len(tail))
            tail += body + b"\0" * (len(body) % 2)
    return head + struct.pack("<I", 0) + tail


def tiff_tags(width: int, height: int, channels: int, dtype: np.dtype, codec: str) -> list[tuple[int, int, list]]:
    photometric = 2 if channels >= 3 else 1
    out = [(256, 4, [width]), (257, 4, [height]), (258, 3, [dtype.itemsize * 8] * channels), (259, 3, [TIFF_CODES[codec]]), (262, 3, [photometric]), (277, 3, [channels]), (284, 3, [1]), (339, 3, [3 if dtype.kind == "f" else 1] * channels)]
    return out + ([(338, 3, [2])] if channels in (2, 4) else [])


def tiff_encode(image: np.ndarray, codec: str = "raw", geo: tuple[float, float, float, float] | None = None) -> bytes:
    """One strip. geo is (x of the left edge, y of the top edge, resx, resy), written as pixel scale and tie point."""
    h, w, n = image.shape
    body = encode(image, codec)
    tags = tiff_tags(w, h, n, image.dtype, codec) + [(273, 4, [8]), (278, 4, [h]), (279, 4, [len(body)])]
    if geo:
        tags += [(33550, 12, [geo[2], geo[3], 0.0]), (33922, 12, [0.0, 0.0, 0.0, geo[0], geo[1], 0.0])]
    body += b"\0" * (len(body) % 2)
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + tiff_ifd(tags, 8 + len(body))


def tiff_info(data: bytes) -> dict[int, list]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    out: dict[int, list] = {0: [order]}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in FORMS:
            continue
        where = at + 10 + 12 * k
        if SIZES[kind] * count > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        out[tag] = list(struct.unpack_from(f"{order}{count}{FORMS[kind]}", data, where))
    return out


def tiff_decode(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float] | None]:
    """Strips or tiles, 8- or 16-bit integers or 32-bit floats, without predictor."""
    t = tiff_info(data)
    w, h, n = t[256][0], t[257][0], t.get(277, [1])[0]
    bits, form = t.get(258, [8])[0], t.get(339, [1])[0]
    dtype = np.dtype(f"{t[0][0]}{'f' if form == 3 else 'u'}{bits // 8}")
    codec = {v: k for k, v in TIFF_CODES.items()} | {32946: "zip"}
    how = codec[t.get(259, [1])[0]]
    image = np.zeros((h, w, n), dtype.newbyteorder("="))
    tiled = 324 in t
    tw, th = (t[322][0], t[323][0]) if tiled else (w, t.get(278, [h])[0])
    across = -(-w // tw)
    for k, (at, size) in enumerate(zip(t[324 if tiled else 273], t[325 if tiled else 279], strict=True)):
        x, y = k % across * tw, k // across * th
        rows = th if tiled else min(th, h - y)
        if size:
            part = np.frombuffer(CODECS[how][1](data[at : at + size])[: rows * tw * n * dtype.itemsize], dtype).reshape(rows, tw, n)
            image[y : y + rows, x : x + tw] = part[: h - y, : w - x]
    geo = (t[33922][3], t[33922][4], t[33550][0], t[33550][1]) if 33922 in t and 33550 in t else None
    return image, geo


HEADER = 2048
ALIGN = 16


def slab_encode(tiles: dict[int, bytes], across: int, down: int, tile_w: int, tile_h: int, channels: int, dtype: str, codec: str) -> bytes:
    """A slab: a 2048-byte TIFF header, the offsets and the sizes of all tiles, then the tiles, each aligned; a missing tile has size 0."""
    n, kind = across * down, np.dtype(dtype)
    at, offsets, sizes, body = HEADER + 8 * n, [], [], bytearray()
    for k in range(n):
        gap = -(at + len(body)) % ALIGN
        data = tiles.get(k, b"")
        if data:
            body += b"\0" * gap
        offsets.append(at + len(body))
        sizes.append(len(data))
        body += data
    code = codec if codec in TIFF_CODES else "raw"
    tags = tiff_tags(across * tile_w, down * tile_h, channels, kind, code) + [(322, 4, [tile_w]), (323, 4, [tile_h])]
    ifd = tiff_ifd([*tags, (324, 4, offsets if n == 1 else [0, 0]), (325, 4, sizes if n == 1 else [0, 0])], 8)
    header = bytearray(b"II*\0" + struct.pack("<I", 8) + ifd)
    for k in range(len(tags) + 2):  # the two indices stand behind the header, whatever their length
        where = 10 + 12 * k
        (tag,) = struct.unpack_from("<H", header, where)
        if tag in (324, 325) and n > 1:
            struct.pack_into("<HHII", header, where, tag, 4, n, HEADER + 4 * n * (tag == 325))
    return bytes(header).ljust(HEADER, b"\0") + struct.pack(f"<{n}I", *offsets) + struct.pack(f"<{n}I", *sizes) + bytes(body)


def slab_index(data: bytes, n: int) -> list[tuple[int, int]]:
    """(offset, size) of each of n tiles."""
    offsets, sizes = struct.unpack_from(f"<{n}I", data, HEADER), struct.unpack_from(f"<{n}I", data, HEADER + 4 * n)
    return list(zip(offsets, sizes, strict=True))


LINK = b"SYMLINK#"


def link_target(data: bytes) -> str | None:
    """The name that a symbolic object points to; null for a slab."""
    return data[len(LINK) :].decode() if len(data) < HEADER and data.startswith(LINK) else None
