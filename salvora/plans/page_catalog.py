"""Queries over ruled pages and scraped tables: rules and spans made from the tables' rows, with SQL that says which cells they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvora.operators import alignment, corpus, grids
from salvora.operators.components import connected_components
from salvora.plans.registry import query
from salvora.session import load

# ------------------------------------------------------------------ rules to cells

# A page for each supplier: a table of 2 to 4 columns of 50 points and 2 or 3 rows of 20. Where the key is odd the first row is one cell. Every third page has dotted rules between its rows,
# and every fourth a second table beyond the first one's corner. Each cell's text is two spans; one more stands beside the tables.
_PAGES = "p AS (SELECT s_suppkey AS k, s_name AS n, 2 + s_suppkey % 3 AS cols, 2 + s_suppkey // 3 % 2 AS rws FROM supplier)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    k, cols, rws = F.col("s_suppkey"), F.col("s_suppkey") % 3 + 2, F.floor(F.col("s_suppkey") / 3) % 2 + 2
    rule = lambda axis, at, low, high: F.struct(F.lit(axis).alias("axis"), at.cast("double").alias("at"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    upto = lambda n: F.sequence(F.lit(0), n.cast("int"))
    level = F.transform(upto(rws), lambda r: rule("h", r * 20 + 0.5 * (r % 2), F.lit(1), cols * 50 - 1))
    dots = F.flatten(F.transform(upto(rws), lambda r: F.transform(F.sequence(F.lit(0), (cols * 10 - 1).cast("int")), lambda i: rule("h", r * 20, i * 5, i * 5 + 2))))
    inner = (k % 3 == 0) & F.lit(True)
    edges = F.array(rule("h", F.lit(0), F.lit(0), cols * 50), rule("h", rws * 20, F.lit(0), cols * 50))
    walls = F.transform(upto(cols), lambda c: rule("v", c * 50, F.when((k % 2 == 1) & (c > 0) & (c < cols), 20).otherwise(0), rws * 20))
    far = F.array(*(rule("h", rws * 20 + y, cols * 50 + 20, cols * 50 + 60) for y in (20, 35)), *(rule("v", cols * 50 + x, rws * 20 + 20, rws * 20 + 35) for x in (20, 60)))
    rules = F.concat(F.when(inner, F.concat(dots, edges)).otherwise(level), walls, F.when(k % 4 == 0, far).otherwise(F.array().cast("array<struct<axis:string,at:double,low:double,high:double>>")))
    span = lambda x, y, text: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), text.alias("text"))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), (rws - 1).cast("int")), lambda r: F.flatten(F.transform(F.sequence(F.lit(0), (cols - 1).cast("int")), lambda c: F.array(span(c * 50 + 20, r * 20 + 9, F.col("s_name")), span(c * 50 + 30, r * 20 + 11, F.concat(r.cast("string"), F.lit("-"), c.cast("string"))))))))
    spans = F.concat(cells, F.array(span(F.lit(-5), F.lit(5), F.concat(F.lit("beside "), "s_name")), span(F.lit(-0.5), F.lit(5), F.lit("half a point out"))))
    return load(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), rules.alias("rules"), spans.alias("spans"))


_GRID_CELLS = f"""{_PAGES},
g AS (SELECT k, n, cols, r, c FROM p, range(0, 3) x(r), range(0, 4) y(c) WHERE r < rws AND c < cols),
h AS (SELECT k, r AS row, CASE WHEN k % 2 = 1 AND r = 0 THEN 0 ELSE c END AS col, CASE WHEN k % 2 = 1 AND r = 0 THEN cols ELSE 1 END AS colspan, string_agg(n || ' ' || r || '-' || c, ' ' ORDER BY c) AS text FROM g GROUP BY ALL),
t AS (SELECT k, 0 AS tbl, row, col, 1 AS rowspan, colspan, text || CASE WHEN row = 0 AND col = 0 THEN ' half a point out' ELSE '' END AS text FROM h UNION ALL SELECT k, 1, 0, 0, 1, 1, '' FROM p WHERE k % 4 = 0)"""


@query(f"WITH {_GRID_CELLS} SELECT CAST(k AS VARCHAR) AS doc_id, row, col, rowspan, colspan, text FROM t")
def ruled_cells(spark: SparkSession, d: str) -> DataFrame:
    """Solid and dotted rules, merged cells, a second table, spans within a point of a cell."""
    return alignment.page_cells(_pages(spark, d)).select("doc_id", "row", "col", "rowspan", "colspan", "text")


@query(f"WITH {_PAGES} SELECT CAST(k AS VARCHAR) AS doc_id, 1 + (k % 4 = 0)::INT AS tables FROM p")
def ruled_tables(spark: SparkSession, d: str) -> DataFrame:
    """Q22: cells that share no edge are two tables."""
    return alignment.page_cells(_pages(spark, d)).groupBy("doc_id").agg(F.count_distinct("table_idx").cast("int").alias("tables"))


@query(f"WITH {_PAGES} SELECT CAST(k AS VARCHAR) AS doc_id, 'beside ' || n AS text FROM p")
def loose_spans(spark: SparkSession, d: str) -> DataFrame:
    """Q23: spans that no cell took."""
    return alignment.page_loose(_pages(spark, d)).select("doc_id", "text")


_PIPES = f"""{_GRID_CELLS}, l AS (SELECT k, tbl, row, string_agg(text, ' | ' ORDER BY col) AS line, max(col + colspan) AS width FROM t GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS doc_id, string_agg('| ' || line || ' |' || CASE WHEN row = 0 THEN chr(10) || '|' || repeat('---|', CAST(width AS INTEGER)) ELSE '' END, chr(10) ORDER BY row) AS pipe FROM l GROUP BY k, tbl"""


@query(f"WITH {_PIPES}")
def ruled_pipes(spark: SparkSession, d: str) -> DataFrame:
    """A grid as a pipe table; what a merged cell covers is left out."""
    return alignment.page_pipes(_pages(spark, d)).select("doc_id", "pipe")


# ------------------------------------------------------------------ the same as relations


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of order lines on a page for each order: columns of 30 by line number, rows of 10 by quantity."""
    row = (F.col("l_quantity") % 3).cast("int")
    boxes = load(spark, d, "lineitem").filter("l_linenumber <= 6").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("c"), row.alias("r")).distinct()
    at = lambda x: x.cast("double")
    return boxes.select("page", (F.col("page") * 100 + F.col("c") * 10 + F.col("r")).alias("cell_id"), at(F.col("c") * 30).alias("x0"), at(F.col("r") * 10).alias("y0"), at(F.col("c") * 30 + 30).alias("x1"), at(F.col("r") * 10 + 10).alias("y1"))


_BOXES = "b AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS c, CAST(l_quantity AS INTEGER) % 3 AS r, l_orderkey * 100 + l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 3 AS id FROM lineitem WHERE l_linenumber <= 6)"


@query(
    f"""WITH RECURSIVE {_BOXES}, e AS (SELECT x.id AS src, y.id AS dst FROM b x JOIN b y ON x.page = y.page AND abs(x.c - y.c) + abs(x.r - y.r) = 1),
    w AS (SELECT id, id AS seen FROM b UNION SELECT w.id, e.dst FROM w JOIN e ON e.src = w.seen)
    SELECT id AS cell_id, min(seen) AS table_id FROM w GROUP BY id"""
)
def touching_cells(spark: SparkSession, d: str) -> DataFrame:
    """Q22: cells that share an edge, directly or through others; corners do not count."""
    cells = _cells(spark, d)
    found = connected_components(grids.touching(cells)).select(F.col("node").alias("cell_id"), F.col("component").alias("table_id"))
    return cells.select("cell_id").join(found, "cell_id", "left").select("cell_id", F.coalesce("table_id", "cell_id").alias("table_id"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").filter("l_linenumber <= 6").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_suppkey").cast("int").alias("s"), "l_partkey")
    return lines.select(F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey", "s", "q").alias("span_id"), (F.col("l_linenumber") * 30 + F.col("s") % 40 - 4.5).alias("x"), (F.col("q") % 3 * 10 + 5.0).alias("y"))


_HELD = f"""{_BOXES}, s AS (SELECT l_orderkey AS page, l_linenumber AS ln, l_partkey AS pk, CAST(l_suppkey AS INTEGER) AS s, CAST(l_quantity AS INTEGER) AS q, l_linenumber * 30 + CAST(l_suppkey AS INTEGER) % 40 - 4.5 AS x FROM lineitem WHERE l_linenumber <= 6),
a AS (SELECT s.page, ln, pk, s.s, q, min(b.id) AS cell_id FROM s LEFT JOIN b ON b.page = s.page AND b.c * 30 - 1 <= x AND x <= b.c * 30 + 31 AND b.r = q % 3 GROUP BY ALL)"""


@query(f"WITH {_HELD} SELECT page, ln, pk, s, q, cell_id FROM a")
def span_cells(spark: SparkSession, d: str) -> DataFrame:
    """Q21: the smallest cell about the middle of each span, give or take a point; of equals the first."""
    took = grids.smallest_cells(_cells(spark, d), _spans(spark, d)).distinct()
    return took.select("page", *(F.col(f"span_id.{c}").alias(o) for c, o in (("l_linenumber", "ln"), ("l_partkey", "pk"), ("s", "s"), ("q", "q"))), "cell_id")


@query(f"WITH {_HELD} SELECT DISTINCT page, ln, pk, s, q FROM a WHERE cell_id IS NULL")
def span_leftovers(spark: SparkSession, d: str) -> DataFrame:
    """Q23: spans that no cell took, as an anti join."""
    spans = _spans(spark, d)
    left = grids.unassigned(spans, grids.smallest_cells(_cells(spark, d), spans)).distinct()
    return left.select("page", *(F.col(f"span_id.{c}").alias(o) for c, o in (("l_linenumber", "ln"), ("l_partkey", "pk"), ("s", "s"), ("q", "q"))))


@query(
    """WITH s AS (SELECT user_id, value AS low, value + event_id % 12 AS high, event_id % 12 >= 6 AS solid FROM events), t AS (SELECT user_id, 20.0 AS a, 26.0 + user_id % 20 AS b FROM events GROUP BY user_id),
    d AS (SELECT t.user_id, count(*) FILTER (NOT solid AND high >= a - 6 AND low <= b + 6) AS n, min(low) FILTER (NOT solid AND high >= a - 6 AND low <= b + 6) AS f, max(high) FILTER (NOT solid AND high >= a - 6 AND low <= b + 6) AS l,
    bool_or(solid AND low <= a + 2 AND high >= b - 2) AS whole, a, b FROM t JOIN s USING (user_id) GROUP BY t.user_id, a, b)
    SELECT user_id, coalesce(whole OR (n >= 3 AND f <= a + 6 AND l >= b - 6), false) AS covered FROM d"""
)
def axis_cover(spark: SparkSession, d: str) -> DataFrame:
    """Q19: whether an axis covers an interval: one solid rule, or three dots from end to end."""
    line = F.struct(F.col("value").alias("low"), (F.col("value") + F.col("event_id") % 12).alias("high"))
    solid = F.col("event_id") % 12 >= 6
    axes = load(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.when(solid, line)).alias("solid"), F.collect_list(F.when(~solid, line)).alias("dots"))
    return axes.select("user_id", grids.axis_covers(F.col("solid"), F.col("dots"), F.lit(20.0), F.col("user_id") % 20 + 26.0).alias("covered"))


@query(
    """WITH x AS (SELECT l_orderkey % 50 AS tbl, l_orderkey AS row_idx, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_quantity) AS w FROM lineitem GROUP BY l_orderkey),
    y AS (SELECT tbl, row_idx, w[len(w) // 2 + 1] AS width FROM x WHERE len(w) >= 3), z AS (SELECT tbl, width, min(row_idx) AS first FROM y GROUP BY ALL)
    SELECT tbl, CAST(row_number() OVER (PARTITION BY tbl ORDER BY first) - 1 AS INTEGER) AS ord, width FROM z"""
)
def band_widths(spark: SparkSession, d: str) -> DataFrame:
    """Q14: widths of the middle spans of rows with at least three, each once, in the order of first sight."""
    rows = load(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("tbl"), F.col("l_orderkey").alias("row_idx")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("w")))).alias("spans"))
    return grids.band_widths(rows)


# ------------------------------------------------------------------ scraped tables


def _html(k: Column, name: Column) -> Column:
    """A page with a table: cells with spans, blank ones, white space, entities, line breaks, a row in no table and a cell that is not closed."""
    return F.concat(F.lit("<tr><td>no table</td></tr><table class='x'><tr><td rowspan=\"2\">"), name, F.lit(" \n &amp;&nbsp;co</td><td> </td><th colspan='"), k.cast("string"), F.lit("'>a<br>b</th></tr><tr><td>open<td>"), k.cast("string"), F.lit("</td></tr></table><p>x</p><table><tr></tr><tr><td rowspan=''>"), (k % 5).cast("string"), F.lit("</td></tr></table>"))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS key, 0 AS row_idx, replace(s_name, ' ', '') || '&co|ab' AS anchor, s_name || ' & co' || ':2:1,:1:1,ab:1:' || greatest(1, s_suppkey) AS cells FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 1, CAST(s_suppkey AS VARCHAR), s_suppkey || ':1:1' FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 2, '', '' FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 3, CAST(s_suppkey % 5 AS VARCHAR), s_suppkey % 5 || ':1:1' FROM supplier"""
)
def scraped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Q15: rows of all tables of a page; texts with single spaces, anchors without the blank cells."""
    pages = load(spark, d, "supplier").select("s_suppkey", _html(F.col("s_suppkey"), F.col("s_name")).alias("html"))
    rows = alignment.table_rows(pages, "s_suppkey", "html")
    return rows.select("key", "row_idx", "anchor", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["text"], c["rowspan"], c["colspan"])), ",").alias("cells"))


@query(
    """WITH a AS (SELECT DISTINCT unnest([replace(s_name, ' ', '') || '&co|ab', CAST(s_suppkey AS VARCHAR), CAST(s_suppkey % 5 AS VARCHAR)]) AS x FROM supplier WHERE s_suppkey % 3 <> 1),
    b AS (SELECT DISTINCT unnest([replace(s_name, ' ', '') || '&co|ab', CAST(s_suppkey AS VARCHAR), CAST(s_suppkey % 5 AS VARCHAR)]) AS x FROM supplier WHERE s_suppkey % 3 <> 2)
    SELECT count(*) FILTER (x IN (SELECT x FROM b)) AS matched, count(*) AS expected, count(*) FILTER (x IN (SELECT x FROM b)) * 100 // greatest(1, count(*)) AS percent FROM a"""
)
def anchor_match(spark: SparkSession, d: str) -> DataFrame:
    """Q16: the share of one set of scraped rows that the other has."""
    pages = load(spark, d, "supplier").select("s_suppkey", _html(F.col("s_suppkey"), F.col("s_name")).alias("html"))
    side = lambda part: alignment.table_rows(pages.filter(F.col("s_suppkey") % 3 != part), "s_suppkey", "html")
    return grids.anchor_share(grids.anchor_diff(side(1), side(2), "anchor"))


# ------------------------------------------------------------------ events


@query("SELECT user_id, list(event_type ORDER BY event_id) AS path, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def event_paths(spark: SparkSession, d: str) -> DataFrame:
    """M8: the events of a document in order, nested."""
    return corpus.nested(load(spark, d, "events"), "user_id", "event_id", "event_type", "path")
