"""A bounds-checked cursor over bytes, for the formats that have no reader elsewhere."""

import struct

import numpy as np

from loamgrid.core.errors import Malformed


class Cursor:
    def __init__(self, data: bytes, at: int = 0, order: str = "<", error: type[Malformed] = Malformed):
        self.data, self.at, self.order, self.error = data, at, order, error

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or self.left < n:
            raise self.error(f"{n} bytes wanted at {self.at}, {self.left} left")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def peek(self) -> int:
        if not self.left:
            raise self.error("end of data")
        return self.data[self.at]

    def number(self, code: str, order: str | None = None) -> int | float:
        return struct.unpack((order or self.order) + code, self.take(struct.calcsize("<" + code)))[0]

    def uint(self, n: int) -> int:
        """Unsigned, little-endian, of any width."""
        return int.from_bytes(self.take(n), "little")

    def varuint(self) -> int:
        """Seven bits to a byte, the lowest first."""
        out = shift = 0
        while True:
            b = self.uint(1)
            out |= (b & 0x7F) << shift
            if b < 0x80:
                if out >> 64:
                    raise self.error("a number of more than 64 bits")
                return out
            shift += 7
            if shift > 63:
                raise self.error("a number of more than 64 bits")

    def varint(self) -> int:
        """The same with a sign in bit 6 of the first byte, which then has six bits of the number."""
        b = self.uint(1)
        sign, out, shift = -1 if b & 0x40 else 1, b & 0x3F, 6
        while b & 0x80:
            b = self.uint(1)
            out |= (b & 0x7F) << shift
            shift += 7
            if shift > 70:
                raise self.error("a number of more than 64 bits")
        return sign * out

    def varints(self, n: int) -> np.ndarray:
        """The next n of them at once: bytes are cut behind each one below 128 and added up in their places."""
        raw = np.frombuffer(self.data, np.uint8, offset=self.at)
        ends = np.flatnonzero(raw < 0x80)[:n]
        if len(ends) < n:
            raise self.error(f"{n} numbers wanted at {self.at}, {len(ends)} there")
        if not n:
            return np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
        if place.max() > 9:
            raise self.error("a number of more than 64 bits")
        used = raw[: ends[-1] + 1].astype(np.int64)
        bits = np.where(place == 0, used & 0x3F, (used & 0x7F) << np.maximum(7 * place - 1, 0))
        self.at += int(ends[-1]) + 1
        return np.add.reduceat(bits, starts) * np.where(used[starts] & 0x40, -1, 1)

    def text(self, n: int, coding: str) -> str:
        try:
            return self.take(n).decode(coding)
        except UnicodeDecodeError as e:
            raise self.error(f"no {coding}: {e}") from e


def varuint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def varint(n: int) -> bytes:
    """Six bits and the sign in the first byte, seven bits in each other."""
    a = abs(n)
    return varuint(a << 1 & ~0x7F | a & 0x3F | (0x40 if n < 0 else 0))


def zigzag(n: int) -> int:
    return n << 1 ^ n >> 63 if n >= 0 else (-n << 1) - 1
