"""Table geometry as relations. cells: (tbl, row_idx, lft, rgt, ...).

A table's cells are gathered once by its key, one shuffle, and slots, spans and padding are array expressions inside the row; a table is part of one
document and so of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salvora.functions.page_grid import COVER, DOT_END, HOLD, LEAST_DOTS, LEAST_EXTENT, SNAP


def _gathered(cells: DataFrame, *columns: str) -> DataFrame:
    return cells.groupBy("tbl").agg(F.collect_list(F.struct(*columns)).alias("cells"))


def _grid(cells: str = "cells") -> Column:
    return F.array_sort(F.array_distinct(F.transform(cells, lambda c: c["lft"])))


def slots(cells: DataFrame) -> DataFrame:
    """(tbl, grid): the sorted distinct left edges of each table."""
    return cells.groupBy("tbl").agg(F.array_sort(F.collect_set("lft")).alias("grid"))


def padding(cells: DataFrame) -> DataFrame:
    """(tbl, row_idx, slot) of the slots that no cell of the row covers. One shuffle; a row looks at its own cells only."""
    dealt = cells.select("tbl", "row_idx", "lft", "rgt").repartition("tbl")
    rows = dealt.withColumn("grid", F.collect_set("lft").over(Window.partitionBy("tbl"))).groupBy("tbl", "row_idx").agg(F.collect_list(F.struct("lft", "rgt")).alias("own"), F.first("grid").alias("grid"))
    free = F.filter("grid", lambda g: ~F.exists("own", lambda c: (c["lft"] <= g) & (g <= c["rgt"])))
    return rows.select("tbl", "row_idx", F.explode(free).alias("slot"))


def colspans(cells: DataFrame) -> DataFrame:
    """cells with colspan: the slots from the left to the right edge, at least one."""
    extra = [c for c in cells.columns if c != "tbl"]
    tables = _gathered(cells, *extra).withColumn("grid", _grid())
    span = lambda c: F.greatest(F.lit(1), F.size(F.filter("grid", lambda g: (c["lft"] <= g) & (g <= c["rgt"])))).cast("bigint")
    out = tables.select("tbl", F.explode(F.transform("cells", lambda c: F.struct(*(c[x].alias(x) for x in extra), span(c).alias("colspan")))).alias("c"))
    return out.select("tbl", "c.*")


def rowspans(cells: DataFrame) -> DataFrame:
    """(tbl, row_idx, lft, rgt, rowspan): rows down to the next one with a cell over one of the same slots, or to the end.

    Two cells share a slot just if their intervals meet, for the larger left edge of the two is a slot.
    """
    tables = _gathered(cells, "row_idx", "lft", "rgt")
    past = F.array_max(F.transform("cells", lambda c: c["row_idx"])) + 1
    below = lambda c: F.array_min(F.transform(F.filter("cells", lambda o: (o["row_idx"] > c["row_idx"]) & (o["lft"] <= c["rgt"]) & (c["lft"] <= o["rgt"])), lambda o: o["row_idx"]))
    spans = F.transform("cells", lambda c: F.struct(c["row_idx"].alias("row_idx"), c["lft"].alias("lft"), c["rgt"].alias("rgt"), (F.coalesce(below(c), past) - c["row_idx"]).cast("int").alias("rowspan")))
    return tables.select("tbl", F.explode(spans).alias("s")).select("tbl", "s.*")


def narrowest_cover(cells: DataFrame) -> DataFrame:
    """(tbl, lft, rgt, cover_lft, cover_rgt): the narrowest wider span about each distinct span, the leftmost of equals; spans without one are left out."""
    tables = cells.groupBy("tbl").agg(F.collect_set(F.struct("lft", "rgt")).alias("spans"))
    wider = lambda s: F.filter("spans", lambda o: (o["lft"] <= s["lft"]) & (s["rgt"] <= o["rgt"]) & (o["rgt"] - o["lft"] > s["rgt"] - s["lft"]))
    best = lambda s: F.array_min(F.transform(wider(s), lambda o: F.struct((o["rgt"] - o["lft"]).alias("width"), o["lft"].alias("lft"), o["rgt"].alias("rgt"))))
    out = tables.select("tbl", F.explode(F.transform("spans", lambda s: F.struct(s["lft"].alias("lft"), s["rgt"].alias("rgt"), best(s).alias("cover")))).alias("s"))
    return out.filter("s.cover is not null").select("tbl", "s.lft", "s.rgt", F.col("s.cover.lft").alias("cover_lft"), F.col("s.cover.rgt").alias("cover_rgt"))


def cluster_axis(points: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """(key, cluster, n, centre): values of which each is at most tolerance above the one before."""
    w = Window.partitionBy(*key).orderBy(value)
    fresh = F.when(F.col(value) - F.lag(value).over(w) <= tolerance, 0).otherwise(1)
    marked = points.select(*key, value, fresh.alias("__fresh"))
    clustered = marked.withColumn("cluster", F.sum("__fresh").over(w).cast("bigint"))  # equal values are peers and share the sum
    return clustered.groupBy(*key, "cluster").agg(F.count("*").alias("n"), F.avg(value).alias("centre"))


def accept_axes(dots: DataFrame, key: list[str], at: Column, solid: Column, least: int = LEAST_DOTS, extent: float = LEAST_EXTENT) -> DataFrame:
    """(key, dots, solid) of axes with a solid rule, or with enough dots over enough distance."""
    axes = dots.groupBy(*key).agg(F.count("*").alias("dots"), F.bool_or(solid).alias("solid"), (F.max(at) - F.min(at)).alias("__extent"))
    return axes.filter(F.col("solid") | ((F.col("dots") >= least) & (F.col("__extent") >= extent))).drop("__extent")


def axis_covers(solid: Column, dots: Column, low: Column, high: Column) -> Column:
    """Whether an axis, array<struct<low, high>> of solid rules and of dots, covers [low, high]: one solid rule does, or three dots at least about it from end to end."""
    whole = F.exists(solid, lambda s: (s["low"] <= low + COVER) & (s["high"] >= high - COVER))
    near = F.filter(dots, lambda s: (s["high"] >= low - DOT_END) & (s["low"] <= high + DOT_END))
    first, last = F.array_min(F.transform(near, lambda s: s["low"])), F.array_max(F.transform(near, lambda s: s["high"]))
    return whole | ((F.size(near) >= LEAST_DOTS) & (first <= low + DOT_END) & (last >= high - DOT_END))


def smallest_cells(cells: DataFrame, spans: DataFrame, slack: float = HOLD) -> DataFrame:
    """(page, span_id, cell_id): the smallest cell that holds the middle of each span, give or take a point, the first of equals; spans without one have none.

    cells: (page, cell_id, x0, y0, x1, y1); spans: (page, span_id, x, y). Joined by page, of which each is small.
    """
    boxes = cells.groupBy("page").agg(F.collect_list(F.struct("cell_id", "x0", "y0", "x1", "y1")).alias("boxes"))
    inside = F.filter("boxes", lambda b: (b["x0"] - slack <= F.col("x")) & (F.col("x") <= b["x1"] + slack) & (b["y0"] - slack <= F.col("y")) & (F.col("y") <= b["y1"] + slack))
    best = F.array_min(F.transform(inside, lambda b: F.struct(((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).alias("area"), b["cell_id"].alias("cell_id"))))
    return spans.join(boxes, "page", "left").select("page", "span_id", best["cell_id"].alias("cell_id"))


def unassigned(spans: DataFrame, assigned: DataFrame) -> DataFrame:
    """Spans that no cell took."""
    return spans.join(assigned.filter("cell_id is not null"), ["page", "span_id"], "left_anti")


def numbers_columns(cells: Column, least: int = 8, words: int = 2) -> Column:
    """Whether a row, array<string> of its cells, numbers the columns: it has many cells, and at most two of them have text without a digit."""
    return (F.size(cells) >= least) & (F.size(F.filter(cells, lambda c: F.regexp_like(c, F.lit(r"^[^0-9]+$")))) <= words)


def touching(cells: DataFrame, slack: float = SNAP) -> DataFrame:
    """(src, dst) of cells of one page that share an edge: apart on one axis by no more than slack, and overlapping on the other. connected_components of these edges are the tables."""
    a, b = cells.alias("a"), cells.alias("b")
    over = lambda lo, hi: (F.col(f"a.{lo}") < F.col(f"b.{hi}")) & (F.col(f"b.{lo}") < F.col(f"a.{hi}"))
    meet = lambda lo, hi: (F.abs(F.col(f"a.{hi}") - F.col(f"b.{lo}")) <= slack) | (F.abs(F.col(f"b.{hi}") - F.col(f"a.{lo}")) <= slack)
    x, y = over("x0", "x1"), over("y0", "y1")
    edge = ~(x & y) & ((meet("x0", "x1") & y) | (meet("y0", "y1") & x))
    return a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.cell_id") < F.col("b.cell_id")) & edge).select(F.col("a.cell_id").alias("src"), F.col("b.cell_id").alias("dst"))


def anchor_diff(left: DataFrame, right: DataFrame, anchor: str) -> DataFrame:
    """(anchor, state) of the distinct non-empty anchors: match, missing (left only) or extra (right only). One shuffle for both sides."""
    marked = left.select(anchor, F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select(anchor, F.lit(False).alias("l"), F.lit(True).alias("r")))
    sides = marked.filter(F.col(anchor) != "").groupBy(anchor).agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    return sides.select(anchor, F.when(F.col("l") & F.col("r"), "match").when(F.col("l"), "missing").otherwise("extra").alias("state"))


def anchor_share(diff: DataFrame) -> DataFrame:
    """One row (matched, expected, percent) of an anchor_diff: how many of the left side's anchors the right has, percent rounded down."""
    matched, expected = F.count_if(F.col("state") == "match"), F.count_if(F.col("state") != "extra")
    return diff.agg(matched.alias("matched"), expected.alias("expected"), F.floor(matched * 100 / F.greatest(expected, F.lit(1))).cast("bigint").alias("percent"))


def band_widths(rows: DataFrame) -> DataFrame:
    """(tbl, ord, width): the widths of the middle spans of each table's rows of three spans or more, each once, in the order of first sight from 0.

    rows: (tbl, row_idx, spans), spans an array of structs with w, in order.
    """
    middle = F.element_at("spans", (F.floor(F.size("spans") / 2) + 1).cast("int"))["w"]
    some = rows.filter(F.size("spans") >= 3).select("tbl", F.struct("row_idx", middle.alias("w")).alias("r"))
    widths = some.groupBy("tbl").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["w"])).alias("widths"))
    return widths.select("tbl", F.posexplode("widths").alias("ord", "width"))
