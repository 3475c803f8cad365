"""Vector tiles of points: the protocol-buffer encoding of one layer, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

EXTENT = 4096
# Field numbers of the format, and the wire types of protocol buffers.
LAYER, NAME, FEATURE, KEY, VALUE, EXTENT_FIELD, VERSION = 3, 1, 2, 3, 4, 5, 15
FEATURE_ID, TAGS, KIND, GEOMETRY, DOUBLE = 1, 2, 3, 4, 3
VARINT, FIXED64, BYTES = 0, 1, 2


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return varint(field << 3 | VARINT) + varint(n)


def _block(field: int, data: bytes) -> bytes:
    return varint(field << 3 | BYTES) + varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def encode(points: list[tuple[int, int, int, float]], layer: str = "points", key: str = "v") -> bytes:
    """A tile of one layer of points (id, x, y, value), x and y in 0..EXTENT."""
    values: dict[float, int] = {}
    features = []
    for number, x, y, v in points:
        place = values.setdefault(v, len(values))
        move = varint(1 << 3 | 1) + varint(_zigzag(x)) + varint(_zigzag(y))
        features.append(_block(FEATURE, _number(FEATURE_ID, number) + _block(TAGS, varint(0) + varint(place)) + _number(KIND, 1) + _block(GEOMETRY, move)))
    held = b"".join(_block(VALUE, varint(DOUBLE << 3 | FIXED64) + struct.pack("<d", v)) for v in values)
    return _block(LAYER, _number(VERSION, 2) + _block(NAME, layer.encode()) + b"".join(features) + _block(KEY, key.encode()) + held + _number(EXTENT_FIELD, EXTENT))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def read() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(data):
        tag = read()
        if tag & 7 == VARINT:
            yield tag >> 3, read()
        else:
            size = 8 if tag & 7 == FIXED64 else 4 if tag & 7 == 5 else read()
            yield tag >> 3, data[at : at + size]
            at += size


def _varints(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(n)
            n = shift = 0
    return out


def decode(data: bytes) -> list[tuple[int, int, int, float]]:
    """The points (id, x, y, value) of a tile's layers."""
    back = lambda n: n >> 1 if n % 2 == 0 else -(n + 1 >> 1)
    out = []
    for field, layer in _fields(data):
        if field != LAYER:
            continue
        parts = list(_fields(layer))
        values = [struct.unpack("<d", dict(_fields(v))[DOUBLE])[0] for f, v in parts if f == VALUE]
        for f, v in parts:
            if f == FEATURE:
                own = dict(_fields(v))
                _, x, y = _varints(own[GEOMETRY])
                out.append((own[FEATURE_ID], back(x), back(y), values[_varints(own[TAGS])[1]]))
    return out
