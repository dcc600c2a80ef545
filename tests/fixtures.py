"""Byte fixtures, made from the layouts of the streams."""

import struct


def enc(*units):
    return b"".join(u.encode("utf-16-be") if isinstance(u, str) else struct.pack(">H", u) for u in flat(units))


def flat(units):
    for u in units:
        if isinstance(u, (list, tuple)):
            yield from flat(u)
        else:
            yield u


def record(cls, *body):
    n = 3 + len(body) + 4
    return [0x1C, cls, n, *body, n, 0, cls, 0x1F]


def span(left, right, flags=0xFF, flags2=0):
    return record(0x30, 0, left, right, flags, flags2)


def para(w4=0x10):
    return record(0x10, 0, w4, 1, 1, 0xFFFF, 0)


def header(n=2):
    return record(0x10, 0, 0x8F, 4 * (n - 1) + 3, 8, *([8, 0x13, 0, 0] * (n - 1)), 0)


def section():
    return record(0x20, 0, 0x10, 2, 0, 1)


ADV, WRAP = 0x0E, 0x0A


def row(*cells, wraps=(), head=0, flags=()):
    """cells: (left, right, text)."""
    out = [header(head)] if head else []
    for i, (left, right, text) in enumerate(cells):
        out += [span(left, right, *(flags[i] if i < len(flags) else ())), text, *([WRAP] if i in wraps else [])]
    return [*out, ADV]


def body(*units):
    return b"SsmgV.01" + enc(*units)


def raw(text, count=1):
    return b"SsmgV.01" + enc([0] * 5, count) + b"TextV.01" + enc(0, len(text), text)


class BitWriter:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value, f"0{width}b") if width else ""

    def bytes(self):
        padded = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8))


def lh5(data, block=5000):
    """An independent encoder: fixed code lengths, greedy copies of the last 255 bytes."""
    symbols, i = [], 0
    while i < len(data):
        best, back = 0, 0
        for d in range(1, min(i, 255) + 1):
            n = 0
            while n < 256 and i + n < len(data) and data[i + n] == data[i + n - d]:
                n += 1
            if n > best:
                best, back = n, d
        if best >= 3:
            symbols.append((253 + best, back - 1))
            i += best
        else:
            symbols.append((data[i], None))
            i += 1
    w = BitWriter()
    for at in range(0, len(symbols), block):
        part = symbols[at : at + block]
        w.put(len(part), 16)
        w.put(0, 5), w.put(11, 5)  # all lengths of the symbol code are 9
        w.put(510, 9)
        for _ in range(0):
            pass
        w.put(14, 4)
        for _ in range(14):
            w.put(4, 3)  # positions: 4 bits each
        for s, back in part:
            w.put(s, 9)
            if back is not None:
                c = back.bit_length()
                w.put(c, 4)
                if c > 1:
                    w.put(back - (1 << c - 1), c - 1)
    return w.bytes()


def member(packed, original, name=b""):
    head = bytes([20 + len(name) + 2, 0]) + b"-lh5-" + struct.pack("<II", len(packed), original) + bytes(6) + bytes([len(name)]) + name + b"\0\0"
    return head + packed


def wrapped(data):
    return b"\x26\x00JustCompressedDocument" + bytes(4) + member(lh5(data), len(data), b"a")
