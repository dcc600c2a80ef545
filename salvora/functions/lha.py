"""LHA members of method -lh5-, and the wrapper in which documents carry one.

A member is a bit stream of blocks. A block has three code tables (lengths of the lengths, symbols, positions) and a count of symbols; symbols below
256 are bytes, the others copy from the last 8,192 bytes. Codes are resolved through one table look-up of as many bits as the longest code has.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from salvora.functions.errors import DocumentError, NotFound, Unsupported
from salvora.functions.limits import Budget

METHOD = b"-lh5-"
WRAPPER = b"\x26\x00JustCompressedDocument"
WINDOW = 8192
#: Least length of a copy, by which symbols from 256 on are counted.
SHORTEST = 3


@dataclass(frozen=True)
class Member:
    name: bytes
    packed: int
    original: int
    body: bytes


class _Bits:
    """Bits from the most significant one on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def peek(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        chunk = self.data[first:last]
        value = int.from_bytes(chunk, "big") << 8 * (last - first - len(chunk))
        return value >> (8 * (last - first) - (self.at & 7) - n) & (1 << n) - 1

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise DocumentError("LH5 bitstream ended early")
        value = self.peek(n) if n else 0
        self.at += n
        return value


class _Code:
    """A canonical prefix code: codes of one length are consecutive, in the order of symbols."""

    def __init__(self, lengths: list[int] | None, only: int | None = None):
        self.only = only
        if only is not None:
            return
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if not used:
            raise DocumentError("LH5 code table is empty")
        self.width = used[-1][0]
        if self.width > 16:
            raise DocumentError("LH5 code is too long")
        self.table: list[tuple[int, int]] = []
        for n, s in used:
            self.table += [(n, s)] * (1 << self.width - n)
            if len(self.table) > 1 << self.width:
                raise DocumentError("LH5 code table is ambiguous")

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        at = bits.peek(self.width)
        if at >= len(self.table):
            raise DocumentError("LH5 code is invalid")
        n, symbol = self.table[at]
        bits.take(n)
        return symbol


def _length_code(bits: _Bits, symbols: int, width: int, gap_at: int | None) -> _Code:
    """The code of code lengths (gap_at = 3) or of positions (None)."""
    n = bits.take(width)
    if n == 0:
        return _Code(None, bits.take(width))
    if n > symbols:
        raise DocumentError("LH5 code table is too large")
    lengths: list[int] = []
    while len(lengths) < n:
        size = bits.take(3)
        if size == 7:
            while bits.take(1):
                size += 1
        lengths.append(size)
        if len(lengths) == gap_at:
            lengths += [0] * bits.take(2)
    if len(lengths) > symbols:
        raise DocumentError("LH5 PT zero run exceeds table")
    return _Code(lengths)


def _symbol_code(bits: _Bits, outer: _Code) -> _Code:
    n = bits.take(9)
    if n == 0:
        return _Code(None, bits.take(9))
    if n > 510:
        raise DocumentError("LH5 code table is too large")
    lengths: list[int] = []
    while len(lengths) < n:
        s = outer.read(bits)
        if s > 2:
            lengths.append(s - 2)
        else:
            lengths += [0] * (1 if s == 0 else bits.take(4) + 3 if s == 1 else bits.take(9) + 20)
    if len(lengths) > 510:
        raise DocumentError("LH5 C zero run exceeds table")
    return _Code(lengths)


def decode(packed: bytes, size: int) -> bytes:
    """`size` bytes from a packed body. A block that announces no symbols at all goes on without end under the tables it has."""
    bits, out = _Bits(packed), bytearray()
    left, symbols, positions = 0, None, None
    while len(out) < size:
        if left == 0:
            left = bits.take(16)
            outer = _length_code(bits, 19, 5, 3)
            symbols = _symbol_code(bits, outer)
            positions = _length_code(bits, 14, 4, None)
        left = max(left, 0) - 1
        s = symbols.read(bits)
        if s < 256:
            out.append(s)
            continue
        length = s - 256 + SHORTEST
        p = positions.read(bits)
        back = (1 << p - 1) + bits.take(p - 1) + 1 if p else 1
        if back > WINDOW:
            raise DocumentError("LH5 distance is outside the window")
        length = min(length, size - len(out))
        start = len(out) - back
        if start < 0:  # the window begins as zeros
            fill = min(-start, length)
            out += bytes(fill)
            length, start = length - fill, 0
        while length > 0:
            piece = out[start : start + min(length, len(out) - start)]
            out += piece
            start, length = start + len(piece), length - len(piece)
    return bytes(out)


def member(data: bytes, budget: Budget) -> Member:
    """The member at the start of data; its size is taken from the budget before anything is decoded."""
    if len(data) < 22 or data[2:7] != METHOD:
        raise Unsupported("not an -lh5- member")
    head = data[0] + 2
    packed, original = struct.unpack_from("<II", data, 7)
    name = data[22 : 22 + data[21]]
    if len(data) < head + packed:
        raise DocumentError("LHA member is truncated")
    budget.reserve(packed, original)
    return Member(name, packed, original, decode(data[head : head + packed], original))


def is_wrapped(data: bytes) -> bool:
    return data.startswith(WRAPPER)


def unwrap(data: bytes, budget: Budget) -> bytes:
    """The document inside a compressed wrapper."""
    budget.limits.check_input(len(data))
    if not is_wrapped(data):
        raise Unsupported("no compressed document")
    at = data.find(METHOD)
    if at < 2:
        raise NotFound("-lh5- member")
    return member(data[at - 2 :], budget).body
