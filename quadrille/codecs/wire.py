"""Protocol-buffer wire format: varints and fields, written and read without a generated schema."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def varint(v: int) -> bytes:
    out = bytearray()
    v &= (1 << 64) - 1
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at


def zigzag(v: int) -> int:
    return (v << 1) ^ (v >> 63)


def unzigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def whole(number: int, v: int) -> bytes:
    return varint(number << 3) + varint(v)


def block(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def packed(number: int, values) -> bytes:
    return block(number, b"".join(varint(int(v)) for v in values)) if len(values) else b""


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field; fixed-size ones as their bytes."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == 0:
            v, at = read_varint(data, at)
        elif kind == 2:
            n, at = read_varint(data, at)
            v, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, v


def unpacked(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = read_varint(data, at)
        out.append(v)
    return out


class Dictionary:
    """Keys and values of a layer, each once, in the order of first use."""

    def __init__(self):
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}

    def tags(self, properties: dict) -> list[int]:
        out = []
        for k, v in properties.items():
            if v is not None:
                out += [self.keys.setdefault(k, len(self.keys)), self.values.setdefault((type(v).__name__, v), len(self.values))]
        return out


def tile_value(v) -> bytes:
    """A value message: text, double, whole number (signed ones zigzagged) or truth."""
    if isinstance(v, bool):
        return whole(7, int(v))
    if isinstance(v, int):
        return whole(6, zigzag(v)) if v < 0 else whole(5, v)
    if isinstance(v, float):
        return varint(3 << 3 | 1) + struct.pack("<d", v)
    return block(1, str(v).encode())


def read_tile_value(data: bytes):
    for number, v in fields(data):
        if number == 1:
            return v.decode()
        if number == 2:
            return struct.unpack("<f", v)[0]
        if number == 3:
            return struct.unpack("<d", v)[0]
        if number == 4:
            return v - (1 << 64) if v >> 63 else v
        if number == 6:
            return unzigzag(v)
        if number == 7:
            return bool(v)
        return v
    return None
