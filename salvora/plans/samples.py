"""Small containers of known content, made from the layouts of the streams, for queries over bytes."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvora.sources.compound import write_compound

MAGIC_HEX = "53736d67562e3031"


def units(*parts) -> bytes:
    """Words and texts as big-endian 16-bit words."""
    return b"".join(p.encode("utf-16-be") if isinstance(p, str) else struct.pack(">H", p) for p in parts)


def record(kind: int, *body: int) -> bytes:
    size = len(body) + 7
    return units(0x1C, kind, size, *body, size, 0, kind, 0x1F)


def stream(*parts: bytes) -> bytes:
    return b"SsmgV.01" + b"".join(parts)


def row(*cells: tuple[int, int, str], headed: bool = True) -> bytes:
    head = record(0x10, 0, 0x8F, 4 * (len(cells) - 1) + 3, 8, 0) if headed else b""
    return head + b"".join(record(0x30, 0, a, b, 0xFF, 0) + units(t) for a, b, t in cells) + units(0x0E)


def stored(data: bytes) -> bytes:
    """An LHA member whose codes are all of one length: literals only."""
    bits = format(len(data), "016b") + "00000" + format(11, "05b") + format(510, "09b") + "0000" + "0000"
    bits += "".join(format(b, "09b") for b in data)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    return bytes([22, 0]) + b"-lh5-" + struct.pack("<II", len(packed), len(data)) + bytes(6) + b"\0\0\0" + packed


def packed(data: bytes, block: int = 4000) -> bytes:
    """LH5 bits of data in blocks of symbols: codes of one length, and copies from the last place of the same three bytes within the ring."""
    symbols, seen, i = [], {}, 0
    while i < len(data):
        at, n = seen.get(data[i : i + 3], -1), 0
        if at >= 0 and i - at <= 8192:
            while n < 256 and i + n < len(data) and data[at + n] == data[i + n]:
                n += 1
        for k in range(i, i + max(n, 1) if n >= 3 else i + 1):
            seen[data[k : k + 3]] = k
        symbols.append((253 + n, i - at - 1) if n >= 3 else (data[i], None))
        i += n if n >= 3 else 1
    bits = []
    for first in range(0, len(symbols), block):
        some = symbols[first : first + block]
        bits += [format(len(some), "016b"), "00000", format(11, "05b"), format(510, "09b"), format(14, "04b"), "100" * 14]
        for symbol, back in some:
            bits.append(format(symbol, "09b"))
            if back is not None:
                size = back.bit_length()
                bits += [format(size, "04b"), format(back, "b")[1:] if size > 1 else ""]
    whole = "".join(bits)
    return int(whole.ljust(-(-len(whole) // 8) * 8, "0"), 2).to_bytes(-(-len(whole) // 8), "big")


def wrapper(data: bytes) -> bytes:
    """A compressed document: its name and an LHA member."""
    bits = packed(data)
    return b"\x26\x00JustCompressedDocument" + bytes(2) + bytes([22, 0]) + b"-lh5-" + struct.pack("<II", len(bits), len(data)) + bytes(6) + b"\0\0\0" + bits


SLOT = 256


def slots(texts: list[str]) -> bytes:
    """A header or box stream: named spans, each at the start of a slot of 128 words."""
    spans = [b"TextV.01" + units(0, len(t), t) for t in texts]
    whole = b"".join(s.ljust(-(-len(s) // SLOT) * SLOT, b"\0") for s in spans)
    return b"SsmgV.01" + bytes(10) + units(len(whole) // SLOT) + whole


def _counted(text: str) -> bytes:
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def root_sheet(name: str) -> bytes:
    return bytes(16) + _counted(name)


def sheet_list(sheets: list[tuple[str, int]]) -> bytes:
    """Names and numbers of the sheets below the root; the last one's trailer is short."""
    entries = [b"\1\0\0\0" + _counted(name) + struct.pack("<I", number) + bytes(26) for name, number in sheets]
    return struct.pack("<I", len(sheets)) + b"".join(entries)[: -20 if entries else None]


def counted_paths(paths: list[str]) -> bytes:
    return b"\0\0" + b"".join(map(_counted, paths))


def samples() -> dict[str, bytes]:
    plain = write_compound({"/DocumentText": stream(units(0x1F, "銀河鉄道の夜"))})
    grid = stream(row((8, 40, "銀河帯"), (41, 80, "けぶった")), row((8, 80, "天上")), row((8, 40, "白い"), (41, 80, "野原")), record(0x20, 0, 0x10, 2, 0, 1))
    numbers = stream(*(record(0x10, 0, 0x26, 5, 0xA3, 2, s, *((0x50, 2, lv) if lv else ()), 0xFFFF, 0) + units("項", 0x0E) for s, lv in ((1, 1), (1, 2), (2, 0), (2, 0), (8, 1))))
    return {
        "a-plain": plain,
        "b-packed": write_compound({"/JSCompDocument": b"\x26\x00JustCompressedDocument" + bytes(2) + stored(plain)}),
        "c-table": write_compound({"/DocumentText": grid, "/Footnote": stream(units(0x1F, "注"))}),
        "d-numbers": write_compound({"/DocumentText": numbers}),
        "e-objects": write_compound({"/DocumentText": stream(units(0x1F, "x")), "/Box/Embedding 1/Contents": b"..GIF89a", "/Box/Embedding 1/Workbook": b"\x09\x08" + bytes(30), "/Box/Notes": b"n"}),
        "f-broken": b"no container",
        "g-loose": write_compound({"/other": stream(units(0x1F, "こぼれた本文"))}),
    }


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v)) for k, v in samples().items()], "doc_id string, content binary")


def text_stream(text: Column) -> Column:
    """A body stream of one run."""
    return F.concat(F.unhex(F.lit(MAGIC_HEX + "001f")), F.encode(text, "UTF-16BE"))


def row_hex(cells: list[tuple[int, int, Column]]) -> Column:
    """A headed row of cells with given edges, in hexadecimal digits."""
    head = record(0x10, 0, 0x8F, 4 * (len(cells) - 1) + 3, 8, 0).hex()
    parts = [F.lit(head)]
    for a, b, text in cells:
        parts += [F.lit(record(0x30, 0, a, b, 0xFF, 0).hex()), F.hex(F.encode(text, "UTF-16BE"))]
    return F.concat(*parts, F.lit("000e"))
