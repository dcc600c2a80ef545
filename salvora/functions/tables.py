"""Blocks from flow events: paragraphs, and ruled tables with their rows, cells and spans.

One document is one fold over its events. A row of cells goes, by what it holds and what is open, to the table, to the rows that wait for a
table, or to the text; no text is ever lost. Geometry follows when a table closes: anchors, rule fragments and block columns are
folded, empty edge columns trimmed, and the left edges that remain are the slots of the grid.

Parts are pairs: ("text", s), ("wrap", "") for a break of the stream, ("seam", "") where two rows became one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from salvora.functions.flow import Event
from salvora.functions.words import SPACE

WRAP, SEAM = ("wrap", ""), ("seam", "")
#: Widths, in coordinate units: of a strip at the border, of a rule fragment or phantom column, and of a block column at most.
STRIP, FRAGMENT, BLOCK_COLUMN = 4, 8, 16
PLAIN_FLAGS, CLOSED_BIT, ANCHOR = 0xFF, 1, 2
DIGIT_ROW_CELLS, DIGIT_ROW_WORDS = 8, 2
_SPACES = re.compile(f"[{SPACE}]*")


def is_space(text: str) -> bool:
    return _SPACES.fullmatch(text) is not None


@dataclass
class Cell:
    left: int
    right: int
    parts: list = field(default_factory=list)
    flags: int = PLAIN_FLAGS
    flags2: int = 0
    open: bool = field(default=False, compare=False)  # its last word was a wrap: it goes on below

    @property
    def span(self) -> tuple[int, int]:
        return self.left, self.right

    @property
    def width(self) -> int:
        return self.right - self.left

    @property
    def blank(self) -> bool:
        """Without any text part; a part of white space only is still text."""
        return all(kind != "text" for kind, _ in self.parts)

    @property
    def text(self) -> str:
        return "".join(t for kind, t in self.parts if kind == "text")

    @property
    def solid(self) -> bool:
        return self.width > STRIP or not self.blank


@dataclass
class OutCell:
    left: int
    right: int
    colspan: int = 1
    rowspan: int = 1
    parts: list = field(default_factory=list)


@dataclass
class Block:
    """A paragraph (parts) or a table (rows)."""

    kind: str
    parts: list = field(default_factory=list)
    rows: list[list[OutCell]] = field(default_factory=list)


def trimmed(parts: list, kinds: tuple = ("wrap",)) -> list:
    a, b = 0, len(parts)
    while a < b and parts[a][0] in kinds:
        a += 1
    while b > a and parts[b - 1][0] in kinds:
        b -= 1
    return parts[a:b]


def settle(cell: Cell) -> Cell:
    """A cell at its end: whether it stays open is noted, outer wraps go, inner ones stand alone."""
    cell.open = cell.open or cell.parts[-1:] == [WRAP]
    inner = trimmed(cell.parts)
    cell.parts = [p for i, p in enumerate(inner) if p != WRAP or inner[i - 1] != WRAP]
    return cell


def spans(row: list[Cell]) -> set:
    return {c.span for c in row}


def lefts(row: list[Cell]) -> list[int]:
    return [c.left for c in row]


def any_open(row: list[Cell]) -> bool:
    return any(c.open for c in row)


def numbers_columns(row: list[Cell]) -> bool:
    """A row of many cells of which hardly any has words without a digit."""
    worded = sum(1 for c in row if not is_space(c.text) and not any(ch.isdecimal() for ch in c.text))
    return len(row) >= DIGIT_ROW_CELLS and worded <= DIGIT_ROW_WORDS


def goes_on(row: list[Cell], before: bool) -> bool:
    """Whether the next row may continue this one."""
    if any(c.open and not c.blank for c in row):
        return True
    return before and any_open(row) and all(c.open or is_space(c.text) for c in row)


class Assembler:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.loose: list = []  # parts of the paragraph in the making
        self.cells: list[Cell] = []
        self.cell: Cell | None = None
        self.headed = False
        self.table: list[list[Cell]] | None = None
        self.waiting: list[list[Cell]] = []  # rows before a table is sure
        self.logical: list[Cell] | None = None  # the last row, while others may join it
        self.living = False
        self.band: list[list[Cell]] | None = None  # rows of a vertical run
        self.forced: dict[tuple[int, int], int] = {}

    # -------------------------------------------------------------- events

    def feed(self, e: Event) -> None:
        if e.kind == "Text":
            (self.loose if self.cell is None else self.cell.parts).append(("text", e.text))
        elif e.kind == "Wrap":
            if self.cell is not None:
                self.cell.parts.append(WRAP)
            elif self.loose:
                self.loose.append(WRAP)
        elif e.kind == "SpanDeclaration":
            if self.cell is None or self.cell.span != (e.left, e.right):
                self._close_cell()
                self.cell = Cell(e.left, e.right, [], e.flags, e.flags2)
        elif e.kind == "RowAdvance":
            self.end_row()
            self.end_paragraph()
        elif e.kind == "RowHeader":
            self._end_open_row()
            self.headed = True
            self.end_paragraph()
        elif e.kind == "ParagraphHeader":
            self._end_open_row()
            if self.table is not None:
                self._release()
            self.end_paragraph()
        elif e.kind == "SectionTransition":
            self.finish()

    def finish(self) -> None:
        self.end_row()
        self.end_table()
        self._release()
        self.end_paragraph()

    def _close_cell(self) -> None:
        if self.cell is not None:
            self.cells.append(settle(self.cell))
            self.cell = None

    def _end_open_row(self) -> None:
        if self.cell is not None or self.cells:
            self.end_row()

    # -------------------------------------------------------------- rows

    def end_row(self) -> None:
        self._close_cell()
        row, headed = self.cells, self.headed
        self.cells, self.headed = [], False
        solid = [c for c in row if c.solid]
        if not solid:
            self._flush()
            self._close_band()
            if self.table is not None:
                self._release()
        elif len(solid) == 1:
            self._single(solid)
        elif self.table is not None:
            self._into_table(row, headed)
        elif headed:
            self._open_by_header(row, solid)
        elif self.waiting and lefts(self.waiting[-1]) == lefts(solid):
            self._open_by_grid(row)
        else:
            self.waiting.append(solid)

    def _single(self, solid: list[Cell]) -> None:
        if self.table is not None:
            self._flush()
            if not solid[0].blank:
                self.table.append(solid)
            return
        self._release()
        self.loose += solid[0].parts
        self.end_paragraph()

    def _into_table(self, row: list[Cell], headed: bool) -> None:
        top = self.logical
        same = top is not None and headed and spans(top) >= spans(row)
        if self.band is not None and (headed or not any_open(row)):
            self._flush()
            self._close_band()
        if same and ((self.living and not self._conflict(top, row)) or self._indented(top, row)):
            self._merge(top, row)
            self.living = goes_on(row, self.living)
        elif self.band is not None and any_open(row):
            self.band.append(row)
        elif all(c.blank for c in row):
            self._flush()
        elif not headed and any_open(row):
            self._flush()
            self.band = [row]
        else:
            self._flush()
            self._start(row, headed)

    def _start(self, row: list[Cell], headed: bool) -> None:
        self.logical = list(row)
        self.living = headed and goes_on(row, self.living)

    def _open_by_header(self, row: list[Cell], solid: list[Cell]) -> None:
        here = set(lefts(solid))
        above = set(lefts(self.waiting[-1])) if self.waiting else None
        adopted = above is not None and (above <= here or above >= here or numbers_columns(self.waiting[-1]))
        if not adopted:
            self._release()
        self.end_paragraph()
        self.table, self.waiting = self.waiting, []
        self._start(row, True)

    def _open_by_grid(self, row: list[Cell]) -> None:
        self.end_paragraph()
        rows, self.waiting = self.waiting, []
        if any_open(row):
            self.table = [r for r in rows if not any_open(r)]
            self.band = [*(r for r in rows if any_open(r)), row]
        else:
            self.table = rows
            self._start(row, False)

    @staticmethod
    def _conflict(top: list[Cell], row: list[Cell]) -> bool:
        """A finished cell that has words already meets one that says it is complete."""
        by_span = {c.span: c for c in top}
        done = [c for c in row if c.flags != PLAIN_FLAGS and c.flags & CLOSED_BIT and not c.blank and c.span in by_span]
        return any(not by_span[c.span].blank and not by_span[c.span].open for c in done)

    @staticmethod
    def _indented(top: list[Cell], row: list[Cell]) -> bool:
        """Every cell with words begins with white space and continues words above."""
        first: dict = {}
        for c in top:
            first.setdefault(c.span, c)
        worded = [c for c in row if not is_space(c.text)]
        return bool(worded) and all(c.span in first and not is_space(first[c.span].text) and is_space(c.text[0]) for c in worded)

    @staticmethod
    def _merge(top: list[Cell], row: list[Cell]) -> None:
        by_span = {c.span: c for c in top}
        for c in row:
            if c.span not in by_span:
                top.append(c)
                continue
            to = by_span[c.span]
            if not c.blank:
                to.parts[:] = c.parts if to.blank else [*to.parts, SEAM, *c.parts]
            to.open = c.open

    def _flush(self) -> None:
        if self.logical is None:
            return
        solid = [c for c in self.logical if c.solid]
        if solid and self.table is not None:
            self.table.append(solid)
        self.logical, self.living = None, False

    def _close_band(self) -> None:
        band, self.band = self.band, None
        if band is None or self.table is None:
            return
        base = len(self.table)
        rows, tall = visual_rows(band)
        self.table += rows
        self.forced.update({(base + r, c): n for (r, c), n in tall.items()})

    # -------------------------------------------------------------- blocks

    def _release(self) -> None:
        self.loose += [p for row in self.waiting for c in row for p in c.parts]
        self.waiting = []

    def end_table(self) -> None:
        if self.table is None:
            return
        self._flush()
        self._close_band()
        if self.table:
            self.blocks.append(Block("table", rows=build(self.table, self.forced)))
        self.table, self.forced = None, {}

    def end_paragraph(self) -> None:
        parts, self.loose = trimmed(self.loose, ("wrap", "seam")), []
        texts = [t for kind, t in parts if kind == "text"]
        if not texts:
            return
        if not is_space("".join(texts)):
            self.end_table()
        self.blocks.append(Block("paragraph", parts))


def assemble(events: list[Event]) -> list[Block]:
    out = Assembler()
    for e in events:
        out.feed(e)
    out.finish()
    return out.blocks


# ------------------------------------------------------------------ vertical bands


def _join_down(into: list, parts: list) -> None:
    """Add what stands below to a vertical run of text."""
    rest = list(parts)
    while rest[:1] == [WRAP]:
        del rest[0]
    text = "".join(t for kind, t in rest if kind == "text")
    if is_space(text):
        if WRAP in (rest or parts) and into and into[-1] != WRAP:
            into.append(WRAP)
    elif text.isdecimal():
        into += [("text", " ")] * bool(into) + [("text", text)]
    elif all(" " <= ch <= "~" for ch in text):
        spaced = any(kind == "text" and t.endswith(" ") for kind, t in into)
        into += [("text", " ")] * (bool(into) and not spaced) + [("text", text), ("text", " ")]
    else:
        into += [SEAM] * (bool(into) and len(text) > 1) + [("text", text)]


def visual_rows(band: list[list[Cell]]) -> tuple[list[list[Cell]], dict[tuple[int, int], int]]:
    """The rows one sees of the physical rows of a band, and rowspans by (row, cell).

    A new row begins where a closed span comes back with words after it was away, or where words come in a part of a
    closed span that has not come back.
    """
    present = [spans(row) for row in band]
    closed: dict[tuple[int, int], int] = {}  # the row in which a span closed, -1 while it is open
    runs: list[tuple[tuple[int, int], list[int], list]] = []  # span, [first row, last row], parts
    latest: dict[tuple[int, int], int] = {}
    visual: list[int] = []

    def breaks(i: int, c: Cell) -> bool:
        if is_space(c.text):
            return False
        if c.span in closed:
            at = closed[c.span]
            return at >= 0 and any(c.span not in p for p in present[at + 1 : i])
        return any(at >= 0 and l <= c.left and c.right <= r and all((l, r) not in p for p in present[at + 1 : i + 1]) for (l, r), at in closed.items())

    for i, row in enumerate(band):
        visual.append((visual[-1] if visual else 0) + any(breaks(i, c) for c in row))
        for c in row:
            if c.span not in latest or (i > 0 and c.span not in present[i - 1]):
                latest[c.span] = len(runs)
                runs.append((c.span, [i, i], []))
            run = runs[latest[c.span]]
            run[1][1] = i
            _join_down(run[2], c.parts)
        closed.update({c.span: -1 if c.open else i for c in row})
    rows: list[list[Cell]] = [[] for _ in range(visual[-1] + 1)]
    tall: list[dict[int, int]] = [{} for _ in rows]
    for (left, right), (first, last), parts in runs:
        rows[visual[first]].append(Cell(left, right, trimmed(parts)))
        if visual[last] > visual[first]:
            tall[visual[first]][left] = visual[last] - visual[first] + 1
    rows = [sorted(row, key=lambda c: c.left) for row in rows]
    return rows, {(r, k): tall[r][c.left] for r, row in enumerate(rows) for k, c in enumerate(row) if c.left in tall[r]}


# ------------------------------------------------------------------ geometry


def absorb_anchors(rows: list[list[Cell]]) -> list[list[Cell]]:
    """A row of fragments of one span joins the anchor of that span in the row above it."""
    out, at = [], 0
    while at < len(rows):
        row, below = rows[at], rows[at + 1] if at + 1 < len(rows) else []
        anchors: dict = {}
        for c in row:
            if c.flags2 == ANCHOR and not c.blank:
                anchors.setdefault(c.span, c)
        worded = [c for c in below if not c.blank]
        one = {c.span for c in worded}
        out.append(row)
        at += 1
        if anchors and len(one) == 1 and one <= set(anchors):
            for c in worded:
                if parts := trimmed(c.parts):
                    anchors[c.span].parts += [SEAM, *parts]
            at += 1
    return out


def fold_fragments(rows: list[list[Cell]]) -> list[list[Cell]]:
    """Runs of narrow empty cells become the narrowest wider span about them that is declared anywhere in the table."""
    declared = [c for row in rows for c in row]
    covers: dict = {}

    def narrow(c: Cell) -> bool:
        return c.blank and c.width <= FRAGMENT

    def cover(c: Cell) -> Cell | None:
        if c.span not in covers:
            about = (d for d in declared if d.left <= c.left and c.right <= d.right and d.width > c.width)
            covers[c.span] = min(about, key=lambda d: d.width, default=None)
        return covers[c.span]

    out = []
    for row in rows:
        folded, inside = [], None
        for c in row:
            if inside is not None and narrow(c) and inside.left <= c.left and c.right <= inside.right:
                continue
            inside = cover(c) if narrow(c) else None
            folded.append(c if inside is None else Cell(inside.left, inside.right, [], c.flags))
        out.append(folded)
    return out


def _find(row: list[Cell], span: tuple[int, int], blank: bool = False) -> Cell | None:
    return next((c for c in row if c.span == span and (c.blank or not blank)), None)


def fold_columns(rows: list[list[Cell]]) -> tuple[list[list[Cell]], dict[tuple[int, int], int]]:
    """Words under an empty open cell of a narrow column move up into it, as one tall cell; empty wide cells beside it that other rows divide grow with it."""
    rows = [list(row) for row in rows]
    edges = sorted({c.left for row in rows for c in row})
    tall: dict[tuple[int, int], int] = {}
    for r, row in enumerate(rows):
        for head in [c for c in row if c.blank and c.open and STRIP < c.width <= BLOCK_COLUMN]:
            if head not in row:
                continue
            moved, words, end = [], [], r + 1
            while end < len(rows) and (c := _find(rows[end], head.span)) is not None and c.blank != c.open:
                parts = trimmed(c.parts)
                if c.blank or parts:
                    moved.append((end, c))
                if not c.blank and parts:
                    words += [SEAM] * bool(words) + parts
                end += 1
            if not words or end - r < 2:
                continue
            place = row.index(head)
            head.parts[:] = words
            tall[r, place] = end - r
            for at, c in moved:
                rows[at].remove(c)
            for side in [c for c in row if c is not head and c.blank and c.width > STRIP]:
                below = [_find(rows[at], side.span, blank=True) for at in range(r + 1, end)]
                if any(side.left < x < side.right for x in edges) and all(c is not None for c in below):
                    tall[r, row.index(side)] = end - r
                    for at, c in zip(range(r + 1, end), below):
                        rows[at].remove(c)
    return rows, tall


def trim_edges(rows: list[list[Cell]]) -> tuple[list[list[Cell]], dict[int, int]]:
    """Without narrow, empty first and last columns that every row declares; how many cells each row lost at its head."""
    lost: dict[int, int] = {}

    def phantom(x: int) -> bool:
        at = [[c for c in row if c.left == x] for row in rows]
        return all(at) and all(c.blank and c.width <= FRAGMENT for cells in at for c in cells)

    while True:
        xs = sorted({c.left for row in rows for c in row})
        if len(xs) < 2:
            return rows, lost
        first, last = phantom(xs[0]), False
        if first:
            for r, row in enumerate(rows):
                lost[r] = lost.get(r, 0) + sum(c.left == xs[0] for c in row)
            rows = [[c for c in row if c.left != xs[0]] for row in rows]
        if len(xs) - first >= 2 and phantom(xs[-1]):
            last = True
            rows = [[c for c in row if c.left != xs[-1]] for row in rows]
        if not first and not last:
            return rows, lost


def build(rows: list[list[Cell]], forced: dict[tuple[int, int], int] | None = None) -> list[list[OutCell]]:
    """The rows of a table with all spans, and an empty cell in each slot that nothing covers."""
    forced = forced or {}
    rows, tall = fold_columns(fold_fragments(absorb_anchors(rows)))
    rows, lost = trim_edges(rows)
    tall = {(r, c - lost.get(r, 0)): n for (r, c), n in tall.items() if c >= lost.get(r, 0)}
    grid = sorted({c.left for row in rows for c in row})
    rows = [sorted(row, key=lambda c: c.left) for row in rows]

    def slots(c: Cell) -> set[int]:
        return {i for i, x in enumerate(grid) if c.left <= x <= c.right}

    taken = [set().union(*map(slots, row)) for row in rows]
    held: list[set[int]] = [set() for _ in rows]  # slots under a cell from above
    high: dict[tuple[int, int], int] = {}
    for r, row in enumerate(rows):
        for k, c in enumerate(row):
            n = tall.get((r, k)) or forced.get((r, k + lost.get(r, 0)))
            if n is None:
                if c.blank:
                    continue
                # a cell that begins in one of the slots also covers it, unless its right edge lies before its left
                stops = (q for q in range(r + 1, len(rows)) if taken[q] & slots(c) or any(grid.index(d.left) in slots(c) for d in rows[q]))
                n = next(stops, len(rows)) - r
                if n < 2:
                    continue
            high[r, k] = n
            for q in range(r + 1, min(r + n, len(rows))):
                held[q] |= slots(c)
    out = []
    for r, row in enumerate(rows):
        line: list[OutCell] = []
        at = 0

        def pad(to: float) -> None:
            nonlocal at
            while at < len(grid) and grid[at] < to:
                if at not in held[r]:
                    line.append(OutCell(grid[at], grid[at] + STRIP))
                at += 1

        for k, c in enumerate(row):
            pad(c.left)
            wide = 1 if len(row) == 1 and c.open else max(1, len(slots(c)))
            line.append(OutCell(c.left, c.right, min(wide, len(grid) - at), high.get((r, k), 1), list(c.parts)))
            while at < len(grid) and grid[at] <= c.right:
                at += 1
        pad(float("inf"))
        out.append(line)
    return out
