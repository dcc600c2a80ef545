"""Compound files: a reader that lists and reads streams, and a small writer.

The reader follows the published compound-file layout: header, sector chains over the allocation tables, a directory of 128-byte entries whose
siblings form a tree, and small streams inside the root's own stream. Loops and missing sectors raise CompoundError.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
STORAGE, STREAM, ROOT = 1, 2, 5
#: Streams above this size are not read.
MAX_STREAM = 64 << 20


class CompoundError(ValueError):
    pass


@dataclass(frozen=True)
class Entry:
    """One node of the tree. size is -1 for a directory; children counts its direct nodes."""

    kind: str
    path: str
    size: int
    children: int = 0


class _Node:
    __slots__ = ("name", "type", "left", "right", "child", "start", "size")

    def __init__(self, raw: bytes, version: int):
        length = struct.unpack_from("<H", raw, 64)[0]
        self.name = raw[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        self.type = raw[66]
        self.left, self.right, self.child = struct.unpack_from("<III", raw, 68)
        self.start, low, high = struct.unpack_from("<III", raw, 116)
        self.size = low if version == 3 else low | high << 32


class CompoundFile:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise CompoundError("not a compound file")
        self.data = data
        self.version, _, shift, mini_shift = struct.unpack_from("<HHHH", data, 26)
        if shift not in (9, 12) or mini_shift > shift:
            raise CompoundError("unknown sector size")
        self.sector, self.mini = 1 << shift, 1 << mini_shift
        n_fat, first_dir, _, self.cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        fat_at = [s for s in struct.unpack_from("<109I", data, 76) if s < DIFAT]
        seen: set[int] = set()
        while first_difat < DIFAT:
            if first_difat in seen:
                raise CompoundError("loop in the allocation list")
            seen.add(first_difat)
            words = self._words(first_difat)
            fat_at += [s for s in words[:-1] if s < DIFAT]
            first_difat = words[-1]
        self.fat = [w for s in fat_at[:n_fat] for w in self._words(s)]
        self.minifat = [w for s in self._chain(first_mini) for w in self._words(s)] if n_mini and first_mini < DIFAT else []
        raw = self._join(first_dir)
        self.nodes = [_Node(raw[i : i + 128], self.version) for i in range(0, len(raw) - 127, 128)]
        if not self.nodes or self.nodes[0].type != ROOT:
            raise CompoundError("no root entry")
        root = self.nodes[0]
        self.ministream = self._join(root.start)[: root.size] if root.start < DIFAT else b""
        self._tree = self._walk()

    def _block(self, sector: int) -> bytes:
        at = (sector + 1) * self.sector
        if at >= len(self.data):
            raise CompoundError(f"sector {sector} is missing")
        return self.data[at : at + self.sector]

    def _words(self, sector: int) -> tuple[int, ...]:
        block = self._block(sector)
        return struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4])

    def _chain(self, sector: int, table: list[int] | None = None) -> list[int]:
        table = self.fat if table is None else table
        out: list[int] = []
        while sector != END:
            if sector >= len(table) or len(out) > len(table):
                raise CompoundError(f"broken chain at sector {sector}")
            out.append(sector)
            sector = table[sector]
        return out

    def _join(self, sector: int) -> bytes:
        return b"".join(self._block(s) for s in self._chain(sector))

    def _siblings(self, first: int) -> list[int]:
        out, stack, seen = [], [first], set()
        while stack:
            i = stack.pop()
            if i >= DIFAT:
                continue
            if i >= len(self.nodes) or i in seen:
                raise CompoundError("broken directory")
            seen.add(i)
            out.append(i)
            stack += [self.nodes[i].left, self.nodes[i].right]
        return out

    def _walk(self) -> list[tuple[str, _Node, int]]:
        """(path, node, direct children) of every node but the root: of each directory first its directories with all below, then its streams, by lower-cased name."""
        out: list[tuple[str, _Node, int]] = []

        def visit(node: _Node, path: str, depth: int) -> int:
            if depth > 512:
                raise CompoundError("directory too deep")
            below = [self.nodes[i] for i in self._siblings(node.child)]
            below.sort(key=lambda n: (n.type != STORAGE, n.name.lower(), n.name))
            for n in below:
                here = f"{path}/{n.name}"
                if n.type == STORAGE:
                    at = len(out)
                    out.append((here, n, 0))
                    out[at] = (here, n, visit(n, here, depth + 1))
                elif n.type == STREAM:
                    out.append((here, n, 0))
            return len(below)

        visit(self.nodes[0], "", 0)
        return out

    def entries(self) -> list[Entry]:
        return [Entry("DIR", p, -1, k) if n.type == STORAGE else Entry("DOC", p, n.size) for p, n, k in self._tree]

    def streams(self) -> list[str]:
        return [p for p, n, _ in self._tree if n.type == STREAM]

    def read(self, path: str, most: int = MAX_STREAM) -> bytes | None:
        """A stream's bytes; None if there is no such stream. Raises CompoundError if it is damaged or too large."""
        for p, node, _ in self._tree:
            if p == path and node.type == STREAM:
                return self._read(node, most)
        return None

    def _read(self, node: _Node, most: int) -> bytes:
        if node.size > most:
            raise CompoundError(f"stream of {node.size} bytes is above {most}")
        if node.size == 0:
            return b""
        if node.size < self.cutoff:
            body = b"".join(self.ministream[s * self.mini : (s + 1) * self.mini] for s in self._chain(node.start, self.minifat))
        else:
            body = self._join(node.start)
        if len(body) < node.size:
            raise CompoundError("stream ends early")
        return body[: node.size]


def write_compound(streams: dict[str, bytes]) -> bytes:
    """A compound file (version 3) of {path: bytes}; directories are made as needed."""
    tree: dict = {}
    for path, body in streams.items():
        *folders, name = path.strip("/").split("/")
        at = tree
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = body
    nodes: list[list] = [["Root Entry", ROOT, FREE, FREE, FREE, END, 0]]  # name, type, left, right, child, start, size
    bodies: dict[int, bytes] = {}

    def add(children: dict) -> int:
        """The first of the siblings, each the left node of a chain to the right."""
        ids = []
        for name in sorted(children, key=lambda n: (len(n), n.upper())):
            i = len(nodes)
            ids.append(i)
            inner = children[name]
            nodes.append([name, STORAGE if isinstance(inner, dict) else STREAM, FREE, FREE, FREE, END if not isinstance(inner, dict) else 0, 0])
            if isinstance(inner, dict):
                nodes[i][4] = add(inner)
            else:
                bodies[i] = inner
        for a, b in zip(ids, ids[1:]):
            nodes[a][3] = b
        return ids[0] if ids else FREE

    nodes[0][4] = add(tree)
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(body: bytes) -> int:
        parts = [body[i : i + 512].ljust(512, b"\0") for i in range(0, len(body), 512)]
        first = len(sectors)
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), END] if parts else [])
        return first if parts else END

    mini, minifat = bytearray(), []
    for i, body in bodies.items():
        nodes[i][6] = len(body)
        if len(body) >= 4096:
            nodes[i][5] = put(body)
        elif body:
            first, count = len(minifat), -(-len(body) // 64)
            nodes[i][5] = first
            minifat += [*range(first + 1, first + count), END]
            mini += body.ljust(count * 64, b"\0")
    nodes[0][5], nodes[0][6] = put(bytes(mini)), len(mini)
    table = struct.pack(f"<{len(minifat)}I", *minifat)
    first_mini = put(table.ljust(-(-len(table) // 512) * 512, b"\xff")) if minifat else END
    raw = b""
    for name, kind, left, right, child, start, size in nodes:
        label = name.encode("utf-16-le")
        raw += (label + b"\0\0").ljust(64, b"\0") + struct.pack("<HBBIII", len(label) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<III", start, size, 0)
    while len(raw) % 512:
        raw += bytes(68) + struct.pack("<III", FREE, FREE, FREE) + bytes(48)
    first_dir = put(raw)
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise CompoundError("too large for the small writer")
    first_fat = len(sectors)
    fat += [FAT] * n_fat
    fat += [FREE] * (n_fat * 128 - len(fat))
    sectors.append(struct.pack(f"<{len(fat)}I", *fat))
    head = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, n_fat, first_dir, 0, 4096, first_mini, -(-len(table) // 512), END, 0)
    head += struct.pack("<109I", *range(first_fat, first_fat + n_fat), *[FREE] * (109 - n_fat))
    return head + b"".join(sectors)
