"""The registered queries over the input tables, each with its SQL.

Every query runs an operator of the engine over whole tables; the SQL says the same in another engine's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salvora.operators import corpus, flow_relational, grids, streams
from salvora.plans import byte_catalog, harness_catalog, page_catalog, samples  # noqa: F401  the other parts register their queries
from salvora.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from salvora.session import load
from salvora.sources import documents

# ------------------------------------------------------------------ corpus analytics

_IGNORED = r"[\s\x{{3000}}\x{{0000}}-\x{{001f}}\x{{007f}}-\x{{009f}}\x{{200b}}\x{{00a0}}\x{{2500}}-\x{{259f}}]"
_NORMAL = r"regexp_replace(replace(regexp_replace(regexp_replace({}, '&#[0-9]+;', '', 'g'), '\\+[-–—][0-9]+\\+[-–—]', '', 'g'), '**', ''), '" + _IGNORED + "', '', 'g')"
_PLAIN = "regexp_replace({}, '" + _IGNORED + "', '', 'g')"
_PAIRS = f"""
p AS (SELECT d.doc_id, d.lang, {_NORMAL.format('b.text')} AS truth, {_PLAIN.format('d.text')} AS made
      FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
a AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(truth, '')) AS ch FROM p) WHERE ch <> '' GROUP BY ALL),
m AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(made, '')) AS ch FROM p) WHERE ch <> '' GROUP BY ALL),
c AS (SELECT doc_id, sum(a.n) AS total, sum(least(a.n, coalesce(m.n, 0))) AS shared FROM a LEFT JOIN m USING (doc_id, ch) GROUP BY doc_id),
s AS (SELECT p.doc_id, p.lang, CASE WHEN total IS NULL THEN 1.0 ELSE CAST(shared AS DOUBLE) / CAST(total AS DOUBLE) END AS coverage FROM p LEFT JOIN c USING (doc_id))
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every document with one of all benchmark items, in turn."""
    docs, bench = load(spark, d, "documents"), load(spark, d, "benchmark")
    items = max(1, bench.count())
    return docs.join(bench.select("item_id", F.col("text").alias("truth")), F.col("doc_id") % items == F.col("item_id")).select("doc_id", "lang", "truth", F.col("text").alias("made"))


@query(f"WITH {_PAIRS} SELECT doc_id, lang, round(coverage, 9) AS coverage, coverage >= 0.95 AS passed FROM s")
def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Q5-Q7: share of the truth's characters that the extracted text has, as multisets."""
    scored = corpus.coverage(_pairs(spark, d), "doc_id", "truth", "made", keep=("lang",))
    return scored.select("doc_id", "lang", F.round("coverage", 9).alias("coverage"), (F.col("coverage") >= 0.95).alias("passed"))


@query(
    f"""WITH {_PAIRS} SELECT coalesce(lang, '(all)') AS category, count(*) AS files, count(*) FILTER (coverage >= 0.95) AS passed,
    round(CAST(count(*) FILTER (coverage >= 0.95) AS DOUBLE) / count(*), 9) AS pass_rate, round(avg(coverage), 9) AS mean_coverage
    FROM s GROUP BY GROUPING SETS ((lang), ())"""
)
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Q8: files, passes and mean coverage by category and over all."""
    scored = corpus.coverage(_pairs(spark, d), "doc_id", "truth", "made", keep=("lang",))
    return corpus.summary(scored.withColumnRenamed("lang", "category"))


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS normal FROM documents")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    """Q5 without Unicode composition, which SQL lacks."""
    return load(spark, d, "documents").select("doc_id", corpus.strip_for_comparison(F.col("text"), export=True).alias("normal"))


_BARE = r"regexp_replace({0}, '[\p{{Z}}\x09-\x0d\x1c-\x1f]', '', 'g')"
_LINE = "(length(" + _BARE + ") > 0 AND length(regexp_replace(" + _BARE + r", '[^!-~\x{{3000}}-\x{{30FF}}\x{{31F0}}-\x{{31FF}}\x{{3200}}-\x{{33FF}}\x{{4E00}}-\x{{9FFF}}\x{{FF00}}-\x{{FFEF}}→←↑↓…◎○●◆☆★※]', '', 'g')) * 100 >= 80 * length(" + _BARE + "))"


@query(f"SELECT doc_id, count(*) AS lines, count(*) FILTER ({_LINE.format('line')}) AS plausible FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def plausible_lines(spark: SparkSession, d: str) -> DataFrame:
    """lines of which at least 80 % are plausible characters."""
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(corpus.plausible_line(F.col("line"))).alias("plausible"))


@query(
    f"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    k AS (SELECT * FROM l WHERE {_LINE.format('line')} QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) = 1)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS salvaged FROM k GROUP BY doc_id"""
)
def salvage_text(spark: SparkSession, d: str) -> DataFrame:
    """Plausible lines of a document, each once, in the order of first sight."""
    return load(spark, d, "documents").select("doc_id", corpus.salvaged_lines(F.col("text")).alias("salvaged")).filter("salvaged is not null")


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Digest and length of every text."""
    return corpus.manifest(load(spark, d, "documents"), "doc_id", "text")


@query("SELECT sha256(text) AS payload, count(DISTINCT source) AS containers, count(*) AS files FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def roundtrip_groups(spark: SparkSession, d: str) -> DataFrame:
    """Q11: equal payloads in at least two containers."""
    return corpus.roundtrip_groups(load(spark, d, "documents"), F.sha2("text", 256), F.col("source"))


@query(
    """WITH a AS (SELECT doc_id, md5(text) AS digest FROM documents WHERE source <> 'src1'),
    b AS (SELECT doc_id, md5(lower(text)) AS digest FROM documents WHERE source <> 'src2')
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.digest IS DISTINCT FROM b.digest"""
)
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """Q10: what differs between two manifests."""
    docs = load(spark, d, "documents")
    old = docs.filter("source <> 'src1'").select("doc_id", F.md5("text").alias("digest"))
    new = docs.filter("source <> 'src2'").select("doc_id", F.md5(F.lower("text")).alias("digest"))
    return corpus.manifest_diff(old, new, "doc_id", "digest")


# ------------------------------------------------------------------ streams as relations


@query("SELECT conv_id, string_agg(role || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS combined FROM conversations GROUP BY conv_id")
def sheet_concat(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of a document under their names, in order."""
    return corpus.combined_text(load(spark, d, "conversations"), "conv_id", "turn", F.col("role"), F.trim("text"), "combined")


@query(
    """WITH x AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS label_turn,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT conv_id, turn, label_turn, before = 'user' AS labelled FROM x WHERE role = 'assistant' AND label_turn IS NOT NULL"""
)
def label_pairing(spark: SparkSession, d: str) -> DataFrame:
    """A label goes to the next run."""
    return streams.pair_labels(load(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")


@query(
    """WITH x AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chapter FROM events),
    y AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, chapter ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM x)
    SELECT event_id, CAST(chapter AS BIGINT) AS chapter, CAST(section AS BIGINT) AS section, CASE WHEN event_type = 'purchase' THEN '第' || chapter || '章 ' WHEN event_type = 'click' THEN chapter || '.' || section || ' ' END AS prefix FROM y"""
)
def numbering(spark: SparkSession, d: str) -> DataFrame:
    """Chapter and section numbers as running counters that begin anew under each chapter."""
    return streams.numbered(load(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "click", "event_id")


@query(
    """WITH x AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events),
    y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cell FROM x)
    SELECT user_id, CAST(cell AS BIGINT) AS cell, min(event_type) AS event_type, count(*) AS parts, min(event_id) AS first_event FROM y GROUP BY user_id, cell"""
)
def span_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours with the same span are one cell."""
    return flow_relational.coalesce_spans(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).groupBy("user_id", "cell").agg(F.min("event_type").alias("event_type"), F.count("*").alias("parts"), F.min("event_id").alias("first_event"))


@query(
    """WITH x AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_idx FROM events)
    SELECT user_id, CAST(row_idx AS BIGINT) AS row_idx, count(*) AS n, bool_or(event_type = 'view') AS closed FROM x GROUP BY user_id, row_idx"""
)
def row_segments(spark: SparkSession, d: str) -> DataFrame:
    """A row ends with its advance."""
    rows = flow_relational.row_segments(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")
    return rows.groupBy("user_id", "row_idx").agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "view").alias("closed"))


# ------------------------------------------------------------------ table grids

# rows: suppliers of an order are the columns' left edges, line numbers the rows
_CELLS = "cells AS (SELECT DISTINCT l_orderkey AS tbl, l_linenumber AS row_idx, CAST(l_suppkey % 8 * 10 AS INTEGER) AS lft, CAST(l_suppkey % 8 * 10 + l_quantity AS INTEGER) AS rgt FROM lineitem)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    base = (F.col("l_suppkey") % 8 * 10).cast("int")
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").alias("row_idx"), base.alias("lft"), (base + F.col("l_quantity")).cast("int").alias("rgt")).distinct()


@query(f"WITH {_CELLS} SELECT tbl, list_sort(list(DISTINCT lft)) AS grid FROM cells GROUP BY tbl")
def grid_slots(spark: SparkSession, d: str) -> DataFrame:
    """The slots of a table are its distinct left edges."""
    return grids.slots(_cells(spark, d))


@query(
    f"""WITH {_CELLS}, s AS (SELECT DISTINCT tbl, lft AS slot FROM cells), r AS (SELECT DISTINCT tbl, row_idx FROM cells)
    SELECT tbl, row_idx, slot FROM r JOIN s USING (tbl) WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.tbl = r.tbl AND c.row_idx = r.row_idx AND c.lft <= slot AND slot <= c.rgt)"""
)
def grid_padding(spark: SparkSession, d: str) -> DataFrame:
    """Slots of a row that no cell covers."""
    return grids.padding(_cells(spark, d))


@query(f"WITH {_CELLS}, s AS (SELECT DISTINCT tbl, lft AS slot FROM cells) SELECT c.tbl, row_idx, lft, rgt, greatest(1, count(slot)) AS colspan FROM cells c JOIN s ON s.tbl = c.tbl AND slot BETWEEN lft AND rgt GROUP BY ALL")
def colspan_cover(spark: SparkSession, d: str) -> DataFrame:
    """A cell spans the slots from its left to its right edge."""
    return grids.colspans(_cells(spark, d)).select("tbl", "row_idx", "lft", "rgt", "colspan")


@query(
    f"""WITH {_CELLS}, n AS (SELECT tbl, max(row_idx) + 1 AS past FROM cells GROUP BY tbl), s AS (SELECT DISTINCT tbl, lft AS slot FROM cells),
    k AS (SELECT DISTINCT c.tbl, c.row_idx, c.lft, c.rgt, slot FROM cells c JOIN s ON s.tbl = c.tbl AND slot BETWEEN c.lft AND c.rgt)
    SELECT a.tbl, a.row_idx, a.lft, a.rgt, CAST(coalesce(min(b.row_idx), any_value(past)) - a.row_idx AS INTEGER) AS rowspan
    FROM k a JOIN n USING (tbl) LEFT JOIN k b ON a.tbl = b.tbl AND a.slot = b.slot AND b.row_idx > a.row_idx GROUP BY a.tbl, a.row_idx, a.lft, a.rgt"""
)
def rowspan_drop(spark: SparkSession, d: str) -> DataFrame:
    """A cell reaches down to the next row that covers one of its slots."""
    return grids.rowspans(_cells(spark, d))


@query(
    f"""WITH {_CELLS}, u AS (SELECT DISTINCT tbl, lft, rgt FROM cells)
    SELECT a.tbl, a.lft, a.rgt, arg_min(b.lft, (b.rgt - b.lft) * 1000 + b.lft) AS cover_lft, arg_min(b.rgt, (b.rgt - b.lft) * 1000 + b.lft) AS cover_rgt
    FROM u a JOIN u b ON a.tbl = b.tbl AND b.lft <= a.lft AND a.rgt <= b.rgt AND b.rgt - b.lft > a.rgt - a.lft GROUP BY a.tbl, a.lft, a.rgt"""
)
def narrowest_cover(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest span of the table that strictly holds another."""
    return grids.narrowest_cover(_cells(spark, d))


@query(
    """WITH x AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) <= 2.0 THEN 0 ELSE 1 END AS fresh FROM events),
    y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY value) AS c FROM x)
    SELECT user_id, CAST(c AS BIGINT) AS cluster, count(*) AS n, round(avg(value), 6) AS centre FROM y GROUP BY user_id, c"""
)
def axis_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Q17: coordinates closer than a tolerance are one axis."""
    return grids.cluster_axis(load(spark, d, "events"), ["user_id"], "value", 2.0).select("user_id", "cluster", "n", F.round("centre", 6).alias("centre"))


@query(
    """WITH a AS (SELECT user_id, event_type, count(*) AS dots, max(value) - min(value) AS extent, bool_or(value > 90) AS solid FROM events GROUP BY ALL)
    SELECT user_id, event_type, dots, solid FROM a WHERE solid OR (dots >= 3 AND extent >= 12)"""
)
def axis_accept(spark: SparkSession, d: str) -> DataFrame:
    """Q18: an axis is a solid rule, or at least three dots over a distance."""
    return grids.accept_axes(load(spark, d, "events"), ["user_id", "event_type"], F.col("value"), F.col("value") > 90)


@query(
    """WITH b AS (SELECT DISTINCT trim(line) AS line, 'left' AS side FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'src1')),
    c AS (SELECT DISTINCT trim(line) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'src2'))
    SELECT line, 'missing' AS state FROM b WHERE line NOT IN (SELECT line FROM c) AND line <> '' UNION ALL SELECT line, 'extra' FROM c WHERE line NOT IN (SELECT line FROM b) AND line <> ''
    UNION ALL SELECT line, 'match' FROM b WHERE line IN (SELECT line FROM c) AND line <> ''"""
)
def row_anchor_diff(spark: SparkSession, d: str) -> DataFrame:
    """Q16: rows of two tables, matched, missing and extra."""
    docs = load(spark, d, "documents")
    lines = lambda s: docs.filter(F.col("source") == s).select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line"))
    return grids.anchor_diff(lines("src1"), lines("src2"), "line")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY lower(l_returnflag), l_linenumber) AS idx FROM lineitem WHERE l_quantity > 5)
    SELECT l_orderkey, l_linenumber, CAST(idx AS INTEGER) AS idx FROM r WHERE idx <= 3"""
)
def embedded_rank_cap(spark: SparkSession, d: str) -> DataFrame:
    """Accepted objects are numbered in order, up to a cap."""
    return streams.rank_cap(load(spark, d, "lineitem").filter("l_quantity > 5"), ["l_orderkey"], [F.lower("l_returnflag"), F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "idx")


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS total FROM lineitem)
    SELECT l_orderkey, l_linenumber, total, total <= 100 AS granted FROM x"""
)
def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """A document's running total against its budget."""
    return streams.budget(load(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity"), 100.0).select("l_orderkey", "l_linenumber", "total", "granted")


@query(
    """SELECT page_id, CASE WHEN html = '' THEN 'EMPTY' WHEN starts_with(html, 'METAFILE') THEN 'METAFILE' WHEN instr(substr(html, 1, 512), 'PNG') > 0 THEN 'PNG'
    WHEN instr(substr(html, 1, 512), 'JFIF') > 0 THEN 'JPEG' WHEN instr(substr(html, 1, 512), 'GIF8') > 0 THEN 'GIF' WHEN instr(substr(html, 1, 512), '%PDF') > 0 THEN 'PDF' ELSE 'UNKNOWN' END AS label FROM pages"""
)
def magic_label(spark: SparkSession, d: str) -> DataFrame:
    """F16 in small: the first magic of a window, by priority."""
    marks = (("PNG", b"PNG"), ("JPEG", b"JFIF"), ("GIF", b"GIF8"), ("PDF", b"%PDF"))
    return load(spark, d, "pages").select("page_id", corpus.first_magic(F.encode("html", "UTF-8"), marks).alias("label"))


@query(
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS p, CAST(len(regexp_extract_all(html, '<table[ >]')) AS BIGINT) AS tables, CAST(len(regexp_extract_all(html, '<t[dh][ >]')) AS BIGINT) AS cells,
    CAST(len(regexp_extract_all(html, '<br ?/?>')) AS BIGINT) AS br, CAST(len(regexp_extract_all(html, 'colspan=')) AS BIGINT) AS colspans, CAST(len(regexp_extract_all(html, 'rowspan=')) AS BIGINT) AS rowspans FROM pages"""
)
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Q12: the skeleton of a page in counts."""
    return corpus.skeleton(load(spark, d, "pages"), "page_id", "html")


@query(
    """SELECT l_orderkey, '| ' || string_agg(l_linenumber || ' | ' || l_returnflag, ' |' || chr(10) || '| ' ORDER BY l_linenumber, l_returnflag) || ' |' AS pipe FROM lineitem GROUP BY l_orderkey"""
)
def pipe_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table as a pipe table."""
    return corpus.pipe_table(load(spark, d, "lineitem"), "l_orderkey", "l_linenumber", [F.col("l_linenumber").cast("string"), F.col("l_returnflag")], "pipe")


@query(
    """WITH x AS (SELECT page_id, list_aggregate(list_sort(regexp_extract_all(html, '<([a-z0-9]+)', 1)), 'string_agg', ',') AS f FROM pages)
    SELECT page_id, min(page_id) OVER (PARTITION BY f) AS class_id FROM x"""
)
def skeleton_classes(spark: SparkSession, d: str) -> DataFrame:
    """Q13: pages whose counts of tags are equal."""
    return corpus.same_skeleton(load(spark, d, "pages"), "page_id", "html")


@query("SELECT source AS category FROM documents GROUP BY source HAVING bool_or(lang = 'en') AND bool_or(lang = 'de')")
def category_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Folders that hold both kinds of files."""
    return corpus.discover_categories(load(spark, d, "documents"), F.col("source"), F.col("lang") == "en", F.col("lang") == "de")


# ------------------------------------------------------------------ bytes


@query("SELECT doc_id, text FROM documents")
def body_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text through a body stream and the token machine."""
    bodies = load(spark, d, "documents").select("doc_id", samples.text_stream(F.col("text")).alias("content"))
    runs = documents.elements(bodies).filter("kind in ('run', 'inline')").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"]), "").alias("text"))
    return runs.select(F.col("doc_id").cast("bigint").alias("doc_id"), corpus.trim_tail(F.col("text")).alias("text"))


@query(
    """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS INTEGER) AS row_idx, l_returnflag AS head, l_linestatus || '行' AS tail, 1 AS colspan, 1 AS rowspan FROM lineitem"""
)
def flow_tables(spark: SparkSession, d: str) -> DataFrame:
    """A stream of rows for every order, through events, assembly and geometry."""
    line = samples.row_hex([(8, 40, F.col("l_returnflag")), (41, 80, F.concat("l_linestatus", F.lit("行")))])
    rows = load(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_returnflag", "l_linestatus", line.alias("line")).alias("r"))
    bodies = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.unhex(F.concat(F.lit(samples.MAGIC_HEX), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), ""))).alias("content"))
    cells = documents.cells(bodies).filter("kind = 'table'")
    put = lambda i: F.max(F.when(F.col("cell_idx") == i, F.col("text")))
    return cells.groupBy(F.col("doc_id").cast("bigint").alias("l_orderkey"), "row_idx").agg(put(0).alias("head"), put(1).alias("tail"), F.max("colspan").alias("colspan"), F.max("rowspan").alias("rowspan"))


@query(
    """SELECT * FROM (VALUES ('a-plain', 'cfb-document-text', 'ok', NULL, '/DocumentText', '銀河鉄道の夜'), ('b-packed', 'cfb-just-compressed-document', 'ok', NULL, '/DocumentText', '銀河鉄道の夜'),
    ('c-table', 'cfb-document-text', 'ok', NULL, '/DocumentText', '銀河帯けぶった天上白い野原'), ('d-numbers', 'cfb-document-text', 'ok', NULL, '/DocumentText', '第1章 項1.1 項(1) 項(2) 項① 項'),
    ('e-objects', 'cfb-document-text', 'ok', NULL, '/DocumentText', 'x'), ('f-broken', 'unknown', 'error', 'Unsupported', NULL, ''), ('g-loose', 'cfb-embedded-document-text', 'ok', NULL, '/EmbeddedDocumentText', 'こぼれた本文'))
    v(doc_id, format, status, error_kind, source, text)"""
)
def decoded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each format."""
    return documents.documents(samples.files(spark)).select("doc_id", "format", "status", "error_kind", "source", "text")


@query(
    """SELECT 'c-table' AS doc_id, '<table><tbody><tr><td>銀河帯</td><td>けぶった</td></tr><tr><td colspan="2">天上</td></tr><tr><td>白い</td><td>野原</td></tr></tbody></table>' || chr(10) || chr(10) || '<p>注</p>' AS xhtml,
    '| 銀河帯 | けぶった |' || chr(10) || '| --- | --- |' || chr(10) || '| 天上 |' || chr(10) || '| 白い | 野原 |' || chr(10) || chr(10) || '注' AS markdown"""
)
def rendered_table(spark: SparkSession, d: str) -> DataFrame:
    """A document as XHTML and Markdown."""
    return documents.documents(samples.files(spark).filter("doc_id = 'c-table'")).select("doc_id", "xhtml", "markdown")


@query(
    """SELECT * FROM (VALUES ('a-plain', 'DOC', '/DocumentText'), ('b-packed', 'DOC', '/JSCompDocument'), ('c-table', 'DOC', '/DocumentText'), ('c-table', 'DOC', '/Footnote'), ('d-numbers', 'DOC', '/DocumentText'),
    ('e-objects', 'DIR', '/Box'), ('e-objects', 'DIR', '/Box/Embedding 1'), ('e-objects', 'DOC', '/Box/Embedding 1/Contents'), ('e-objects', 'DOC', '/Box/Embedding 1/Workbook'), ('e-objects', 'DOC', '/Box/Notes'), ('e-objects', 'DOC', '/DocumentText'), ('g-loose', 'DOC', '/other')) v(doc_id, kind, path)"""
)
def container_entries(spark: SparkSession, d: str) -> DataFrame:
    """The tree of each container."""
    return documents.entries(samples.files(spark)).filter("error is null").select("doc_id", "kind", "path")


@query("SELECT * FROM (VALUES ('e-objects', 1, 'embedded-1.xls', 'application/vnd.ms-excel', '/Box/Embedding 1/Workbook'), ('e-objects', 2, 'embedded-2.gif', 'image/gif', '/Box/Embedding 1/Contents')) v(doc_id, idx, name, content_type, rel_path)")
def embedded_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects of a document, numbered."""
    return documents.objects(samples.files(spark)).drop("payload")


@query(
    """SELECT doc_id, path, replace(replace(path, '/', '_'), ' ', '_') AS file, magic FROM (VALUES ('e-objects', '/Box/Embedding 1/Contents', 'GIF'), ('e-objects', '/Box/Embedding 1/Workbook', 'UNKNOWN'), ('e-objects', '/Box/Notes', 'UNKNOWN'), ('e-objects', '/DocumentText', 'UNKNOWN')) v(doc_id, path, magic)"""
)
def stream_dump(spark: SparkSession, d: str) -> DataFrame:
    """Streams with file names and magics."""
    found = documents.streams(samples.files(spark).filter("doc_id = 'e-objects'"))
    return found.select("doc_id", F.col("stream_path").alias("path"), documents.file_name(F.col("stream_path")).alias("file"), documents.stream_magic(F.col("content")).alias("magic"))
