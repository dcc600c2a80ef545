"""Tables of a printed page from its ruled lines and text spans.

Lines near each other are one axis, of solid rules and of dots. A cell lies between two axes each way that cover an edge of it both ways, with no axis through it; cells inside
larger ones go. Cells that share an edge are a table; spans go to the smallest cell about them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np

# Fixed values, in points: lines that are one axis; what an edge may fall short of a rule; the length from which a line is solid; dots that make an axis and the
# distance they span; what an edge may fall short of dots; what a span's middle or a cell may stand out of a cell.
SNAP, COVER, SOLID, LEAST_DOTS, LEAST_EXTENT, DOT_END, HOLD = 1.5, 2.0, 6.0, 3, 12.0, 6.0, 1.0


@dataclass(frozen=True)
class Rule:
    """A horizontal (axis 'h', at = y) or vertical (axis 'v', at = x) line from low to high."""

    axis: str
    at: float
    low: float
    high: float


@dataclass
class Axis:
    """Lines at one place: the first line's."""

    at: float
    solid: list[tuple[float, float]] = field(default_factory=list)
    dots: list[tuple[float, float]] = field(default_factory=list)

    @property
    def stands(self) -> bool:
        """Whether it is a structural axis: a solid rule, or enough dots over enough distance."""
        return bool(self.solid) or (len(self.dots) >= LEAST_DOTS and max(b for _, b in self.dots) - min(a for a, _ in self.dots) >= LEAST_EXTENT)

    def covers(self, low: float, high: float) -> bool:
        if any(a <= low + COVER and b >= high - COVER for a, b in self.solid):
            return True
        near = [(a, b) for a, b in self.dots if b >= low - DOT_END and a <= high + DOT_END]
        return len(near) >= LEAST_DOTS and min(a for a, _ in near) <= low + DOT_END and max(b for _, b in near) >= high - DOT_END


@dataclass
class GridCell:
    x0: float
    y0: float
    x1: float
    y1: float
    row: int = 0
    col: int = 0
    rowspan: int = 1
    colspan: int = 1
    texts: list[str] = field(default_factory=list)

    @property
    def area(self) -> float:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    def holds(self, other: GridCell) -> bool:
        return self.x0 <= other.x0 + HOLD and self.y0 <= other.y0 + HOLD and other.x1 <= self.x1 + HOLD and other.y1 <= self.y1 + HOLD

    @property
    def text(self) -> str:
        return " ".join(self.texts)


def cluster(values: list[float], tolerance: float = SNAP) -> list[float]:
    """Means of runs of values of which each is at most tolerance above the one before."""
    ordered = sorted(values)
    cuts = [0, *(i + 1 for i, (a, b) in enumerate(pairwise(ordered)) if b - a > tolerance), len(ordered)]
    return [sum(ordered[a:b]) / (b - a) for a, b in pairwise(cuts) if b > a]


def axes(rules: list[Rule]) -> list[Axis]:
    """The structural axes of lines of one direction, in order of place; a line joins the first axis near it."""
    out: list[Axis] = []
    for r in rules:
        home = next((a for a in out if abs(a.at - r.at) <= SNAP), None)
        if home is None:
            home = Axis(r.at)
            out.append(home)
        (home.solid if r.high - r.low >= SOLID else home.dots).append((min(r.low, r.high), max(r.low, r.high)))
    return sorted((a for a in out if a.stands), key=lambda a: a.at)


def _index(across: list[Axis], places: list[float]) -> np.ndarray:
    """[k, i, j]: whether axis k covers places i to j, for i < j."""
    table = np.zeros((len(across), len(places), len(places)), dtype=bool)
    for k, axis in enumerate(across):
        for i, low in enumerate(places):
            table[k, i, i + 1 :] = [axis.covers(low, high) for high in places[i + 1 :]]
    return table


def cells(rules: list[Rule]) -> list[GridCell]:
    """Cells in the order of size, the largest first.

    For every pair of places on one side only stretches between neighbouring covering axes of the other side can be cells, and an edge of these must be one of them: of n axes each way
    some n cubed stretches are looked at.
    """
    upright, level = axes([r for r in rules if r.axis == "v"]), axes([r for r in rules if r.axis == "h"])
    xs, ys = [a.at for a in upright], [a.at for a in level]
    walls, floors = _index(upright, ys), _index(level, xs)
    # how many of the first m level axes cover a stretch: none between two of them if the counts agree
    seen = np.concatenate([np.zeros((1, len(xs), len(xs)), dtype=np.int64), np.cumsum(floors, axis=0)]) if ys else np.zeros((1, len(xs), len(xs)), dtype=np.int64)
    found: list[GridCell] = []
    for top in range(len(ys)):
        for bottom in range(top + 1, len(ys)):
            standing = np.flatnonzero(walls[:, top, bottom])
            bounds = [-1, *standing.tolist(), len(xs)]
            stretches = {(a, b) for wall, after in pairwise(bounds[1:]) for a, b in ((wall, x) for x in range(wall + 1, min(after, len(xs) - 1) + 1))}
            stretches |= {(x, wall) for before, wall in pairwise(bounds[:-1]) for x in range(max(before, 0), wall)}
            for left, right in sorted(stretches):
                clear = seen[bottom, left, right] == seen[top + 1, left, right]
                if clear and (floors[top, left, right] or floors[bottom, left, right]):
                    found.append(GridCell(xs[left], ys[top], xs[right], ys[bottom]))
    kept: list[GridCell] = []
    for cell in sorted(found, key=lambda c: -c.area):
        if not any(other.holds(cell) for other in kept):
            kept.append(cell)
    return kept


def touch(a: GridCell, b: GridCell) -> bool:
    """Whether two cells share an edge: they meet on one axis and overlap on the other."""
    over_x, over_y = a.x0 < b.x1 and b.x0 < a.x1, a.y0 < b.y1 and b.y0 < a.y1
    if over_x == over_y:  # one in the other, or at a corner at most
        return False
    ends = ((a.x1, b.x0), (b.x1, a.x0)) if over_y else ((a.y1, b.y0), (b.y1, a.y0))
    return any(abs(p - q) <= SNAP for p, q in ends)


def groups(found: list[GridCell]) -> list[list[GridCell]]:
    """Cells that share edges, directly or through others, in the order of their first cells."""
    home = list(range(len(found)))
    for i, a in enumerate(found):
        for j in range(i):
            if home[i] != home[j] and touch(a, found[j]):
                least, other = sorted((home[i], home[j]))
                home = [least if h == other else h for h in home]
    return [[c for c, h in zip(found, home) if h == g] for g in sorted(set(home))]


def page_tables(rules: list[Rule], spans: list[tuple[float, float, str]]) -> tuple[list[list[GridCell]], list[str]]:
    """(tables, texts that no cell took); spans: middle x, middle y, text."""
    every = cells(rules)
    tables = groups(every)
    loose = []
    for x, y, text in spans:
        about = [c for c in every if c.x0 - HOLD <= x <= c.x1 + HOLD and c.y0 - HOLD <= y <= c.y1 + HOLD]
        if about:
            min(about, key=lambda c: c.area).texts.append(text)
        else:
            loose.append(text)
    for t in tables:
        xs, ys = cluster(list({v for c in t for v in (c.x0, c.x1)})), cluster(list({v for c in t for v in (c.y0, c.y1)}))
        place = lambda axis, v: min(range(len(axis)), key=lambda i: abs(axis[i] - v))
        for c in t:
            c.col, c.row = place(xs, c.x0), place(ys, c.y0)
            c.colspan, c.rowspan = max(1, place(xs, c.x1) - c.col), max(1, place(ys, c.y1) - c.row)
        t.sort(key=lambda c: (c.row, c.col))
    return tables, loose


def pipe(table: list[GridCell]) -> str:
    """A table as a pipe table; what a merged cell covers beside its own place is left out."""
    rows, cols = max(c.row + c.rowspan for c in table), max(c.col + c.colspan for c in table)
    at = {(c.row, c.col): c.text for c in table}
    hidden = {(r, k) for c in table for r in range(c.row, c.row + c.rowspan) for k in range(c.col, c.col + c.colspan)} - {(c.row, c.col) for c in table}
    lines = ["| " + " | ".join(at.get((r, k), "") for k in range(cols) if (r, k) not in hidden) + " |" for r in range(rows)]
    return "\n".join([lines[0], "|" + "---|" * cols, *lines[1:]])
