"""Queries of the harness: which files there are, which belong together, what is reported; each with its SQL, written from the published rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salvora.functions.limits import Limits
from salvora.operators import alignment, corpus, flow_relational, grids, streams
from salvora.plans.registry import query
from salvora.session import load
from salvora.sources import documents, sinks

# ------------------------------------------------------------------ files

_LIMIT = 3000


@query(f"SELECT CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS length, CASE WHEN strlen(text) <= {_LIMIT} THEN 'ok' ELSE 'ResourceLimit' END AS state, CASE WHEN strlen(text) <= {_LIMIT} THEN md5(text) END AS digest FROM documents")
def input_limit(spark: SparkSession, d: str) -> DataFrame:
    """Files up to the limit with their content, the rest as errors without."""
    found = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))
    files, rejected = documents.within_limit(found, Limits(input_bytes=_LIMIT))
    return files.select(F.col("doc_id").alias("path"), "length", F.lit("ok").alias("state"), F.md5("content").alias("digest")).unionByName(rejected.select(F.col("doc_id").alias("path"), F.col("limit_actual").alias("length"), F.col("error_kind").alias("state"), F.lit(None).cast("string").alias("digest")))


_PATH = "'/' || lang || '/' || chr(CAST(doc_id % 30 + 2 AS INTEGER)) || source || ' of' || chr(9) || doc_id"


@query(
    f"""SELECT doc_id, CASE WHEN strlen(text) > {_LIMIT} THEN {_PATH} ELSE
    '_' || lang || '_' || CASE WHEN doc_id % 30 + 2 IN (9, 10, 11, 12, 13, 28, 29, 30, 31) THEN '_' ELSE printf('%%%02X', doc_id % 30 + 2) END || source || '_of_' || doc_id END AS name, strlen(text) > {_LIMIT} AS skipped FROM documents"""
)
def stream_files(spark: SparkSession, d: str) -> DataFrame:
    """Streams up to a size under file names without slashes, white space and controls; larger ones are skipped."""
    path = F.concat(F.lit("/"), "lang", F.lit("/"), F.chr(F.col("doc_id") % 30 + 2), "source", F.lit(" of\t"), F.col("doc_id").cast("string"))
    found = load(spark, d, "documents").select("doc_id", path.alias("stream_path"), F.encode("text", "UTF-8").alias("content")).withColumn("size", F.octet_length("content").cast("bigint"))
    written, skipped = documents.dump(found, _LIMIT)
    return written.select("doc_id", F.col("file").alias("name"), F.lit(False).alias("skipped")).unionByName(skipped.select("doc_id", F.col("stream_path").alias("name"), F.lit(True).alias("skipped")))


_SUFFIX = "'a/' || c_custkey || CASE c_custkey % 7 WHEN 0 THEN '.jtd' WHEN 1 THEN '.JTD' WHEN 2 THEN '.jtt' WHEN 3 THEN '.jttc' WHEN 4 THEN '.jtdx' WHEN 5 THEN '.jtd.doc' ELSE 'jtd' END"


@query(f"SELECT c_custkey, {_SUFFIX} AS path FROM customer WHERE c_custkey % 7 IN (0, 2, 3)")
def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """Files by suffix, in small letters only."""
    paths = load(spark, d, "customer").select("c_custkey", F.expr(_SUFFIX.replace("'a/' || c_custkey || CASE", "'a/' || cast(c_custkey as string) || CASE")).alias("path"))
    return documents.with_suffix(paths)


@query(
    """SELECT 'Category ' || n_name AS category, CASE n_nationkey % 4 WHEN 0 THEN '/corpus/' || n_nationkey WHEN 1 THEN '/root/' || n_nationkey WHEN 2 THEN '/abs/' || n_nationkey ELSE '/' || n_nationkey END AS folder
    FROM nation WHERE n_regionkey <> 3"""
)
def category_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a configuration with comments, blanks and short lines; each path is looked for below the corpus, the root and its parent, and left out where it is nowhere."""
    nation = load(spark, d, "nation")
    line = F.concat(F.lit("　Category "), "n_name", F.lit(" \t "), F.when(F.col("n_nationkey") % 4 == 2, F.lit("/abs/")).otherwise(F.lit("")), F.col("n_nationkey").cast("string"), F.lit("\tmore"))
    lines = nation.select(F.explode(F.array(line, F.concat(F.lit("# "), line), F.lit(" \t "), F.col("n_name"))).alias("value"))
    # a folder of the root is also there below its parent where the root comes first, and none in one region
    where = F.expr("CASE n_nationkey % 4 WHEN 0 THEN array('/corpus/', '/root/', '/') WHEN 1 THEN array('/root/', '/') WHEN 2 THEN array('/abs/', '/corpus/') ELSE array('/') END")
    folders = nation.filter("n_regionkey <> 3").select(F.explode(where).alias("base"), "n_nationkey").select(F.concat("base", F.col("n_nationkey").cast("string")).alias("folder"))
    return corpus.category_folders(corpus.configured_categories(lines), folders, "/corpus", "/root")


@query(
    """SELECT 'application/vnd.justsystems.ichitaro' AS type, page_id FROM pages WHERE page_id % 12 IN (0, 1, 2, 3, 4, 5, 6) OR page_id % 12 = 11
    UNION ALL SELECT 'application/octet-stream', page_id FROM pages WHERE page_id % 12 BETWEEN 7 AND 10"""
)
def sniffed_type(spark: SparkSession, d: str) -> DataFrame:
    """six marks in compound files, suffixes in small and capital letters; marks that come too early, too late or in no compound file do not count."""
    hexa = lambda b: F.lit(b.hex())
    head, gap = F.lit("d0cf11e0a1b11ae1"), F.expr("repeat('20', 504 + cast(page_id as int) * 7 % 65025)")
    case = F.col("page_id") % 12
    marks = documents.MARKS
    content = F.when(case == 7, F.concat(hexa(b"no compound file " * 40), hexa(marks[0]))).when(case == 8, F.concat(head, hexa(marks[1]), F.expr("repeat('20', 600)"))).when(case == 9, F.concat(head, F.expr("repeat('20', 65529)"), hexa(marks[2]))).when(case == 10, F.concat(head, F.expr("repeat('20', 600)")))
    for i, mark in enumerate(marks):
        content = content.when(case == i, F.concat(head, gap, hexa(mark), F.hex(F.encode("url", "UTF-8"))))
    content = content.when(case == 6, F.concat(head, F.expr("repeat('20', 65528)"), hexa(marks[5]))).otherwise(F.lit("00"))
    name = F.when(case == 11, F.element_at(F.array(*map(F.lit, ("x.jtd", "x.JTD", "x.jtt", "x.JTTC"))), (F.col("page_id") % 4 + 1).cast("int"))).otherwise(F.lit("x.bin"))
    return load(spark, d, "pages").select("page_id", documents.sniffed(name, F.unhex(content)).alias("type"))


# ------------------------------------------------------------------ names that belong together

_BASE = "CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'e' || chr(769) || n_name ELSE n_name || '_' || n_regionkey END"


@query(
    """WITH d AS (SELECT n_regionkey AS folder, n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN chr(233) || n_name ELSE n_name || '_' || n_regionkey END AS base FROM nation),
    x AS (SELECT n_regionkey AS folder, n_nationkey, unnest([n_name, chr(233) || n_name || '_sheet', n_name || '_' || n_regionkey || '_b', n_name || 'x']) AS export FROM nation)
    SELECT d.n_nationkey, x.export FROM d JOIN x ON x.folder = d.folder AND (x.export = d.base OR starts_with(x.export, d.base || '_'))"""
)
def pairing(spark: SparkSession, d: str) -> DataFrame:
    """Q1: documents and exports of one folder by equal names, or the document's with an underscore in front; names are compared in NFC."""
    nation = load(spark, d, "nation")
    docs = nation.select(F.col("n_regionkey").alias("folder"), F.expr(_BASE.replace("chr(769)", "'́'")).alias("base"), "n_nationkey")
    exports = nation.select(F.col("n_regionkey").alias("folder"), F.explode(F.array("n_name", F.concat(F.lit("é"), "n_name", F.lit("_sheet")), F.concat_ws("_", "n_name", "n_regionkey", F.lit("b")), F.concat("n_name", F.lit("x")))).alias("base"))
    pairs = corpus.pair_by_name(docs, exports)
    return pairs.join(docs.select("folder", "base", "n_nationkey"), ["folder", "base"]).select("n_nationkey", "export")


# Of each region a document whose sheets are its nations; exports by nation: none, the plain name, the name with the word for sheet, a name that has another's in it. The exports
# of a nation come in the order of keys, but every third first.
_SHEETS = """
s AS (SELECT n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_nationkey AS k, 'S' || n_nationkey || 'E' AS sheet FROM nation),
e AS (SELECT r, k, CASE k % 4 WHEN 1 THEN 'doc' || r || '_' || sheet WHEN 2 THEN 'doc' || r || '_' || sheet || 'シート' WHEN 3 THEN 'other ' || sheet || ' too' END AS export FROM s WHERE k % 4 > 0 UNION ALL SELECT r, 1000 + k, 'left ' || k FROM s WHERE k % 5 = 0)
"""


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    nation, k, doc = load(spark, d, "nation"), F.col("n_nationkey"), F.concat(F.lit("doc"), "n_regionkey")
    sheet = F.concat(F.lit("S"), k, F.lit("E"))
    sheets = nation.select(F.col("n_regionkey").cast("string").alias("doc_id"), doc.alias("base"), k.cast("int").alias("sheet_idx"), sheet.alias("sheet"))
    name = F.when(k % 4 == 1, F.concat_ws("_", doc, sheet)).when(k % 4 == 2, F.concat(doc, F.lit("_"), sheet, F.lit("シート"))).when(k % 4 == 3, F.concat(F.lit("other "), sheet, F.lit(" too")))
    exports = nation.select("n_regionkey", F.explode(F.array(F.struct(k.alias("i"), name.alias("export")), F.struct((k + 1000).alias("i"), F.when(k % 5 == 0, F.concat(F.lit("left "), k)).alias("export")))).alias("e"))
    exports = exports.filter("e.export is not null").select(F.col("n_regionkey").cast("string").alias("doc_id"), F.col("e.i").alias("export_idx"), "e.export")
    return alignment.align(sheets, exports)


@query(
    f"""WITH {_SHEETS} SELECT CAST(s.r AS VARCHAR) AS doc_id, s.sheet, e.export FROM s LEFT JOIN e ON e.r = s.r AND e.k = s.k
    UNION ALL SELECT CAST(r AS VARCHAR), NULL, export FROM e WHERE k >= 1000"""
)
def sheet_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Q2: sheets and exports by three kinds of names; exports that are left come last."""
    return _aligned(spark, d).select("doc_id", "sheet", "export")


@query(f"WITH {_SHEETS} SELECT CAST(r AS VARCHAR) AS doc_id, 'sheet' AS side, sheet AS name FROM s WHERE k % 4 = 0 UNION ALL SELECT CAST(r AS VARCHAR), 'export', export FROM e WHERE k >= 1000")
def sheet_missing(spark: SparkSession, d: str) -> DataFrame:
    """Q3: sheets without an export and exports without a sheet."""
    no_export, no_sheet = alignment.missing(_aligned(spark, d))
    return no_export.select("doc_id", F.lit("sheet").alias("side"), F.col("sheet").alias("name")).unionByName(no_sheet.select("doc_id", F.lit("export").alias("side"), F.col("export").alias("name")))


@query(
    f"""WITH {_SHEETS}, c AS (SELECT r, count(*) AS total, count(*) FILTER (k % 4 > 0) AS matched FROM s GROUP BY r)
    SELECT CAST(r AS VARCHAR) AS doc_id, CASE WHEN matched = total THEN 'full' WHEN matched > 0 THEN 'partial' ELSE 'none' END AS status, matched, total FROM c"""
)
def sheet_status(spark: SparkSession, d: str) -> DataFrame:
    """Q4: whether all sheets, some or none have an export."""
    return alignment.status(_aligned(spark, d))


@query(
    """WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS truth, max(turn) AS last FROM conversations GROUP BY conv_id), m AS (SELECT t.conv_id, truth, text AS made FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.last),
    a AS (SELECT conv_id, ch, count(*) AS n FROM (SELECT conv_id, unnest(string_split(regexp_replace(truth, '[\\s\\x{00a0}\\x{0000}-\\x{001f}\\x{007f}-\\x{009f}\\x{200b}\\x{2500}-\\x{259f}\\x{3000}]', '', 'g'), '')) AS ch FROM m) WHERE ch <> '' GROUP BY ALL),
    b AS (SELECT conv_id, ch, count(*) AS n FROM (SELECT conv_id, unnest(string_split(made, '')) AS ch FROM m) GROUP BY ALL)
    SELECT conv_id, round(CAST(sum(least(a.n, coalesce(b.n, 0))) AS DOUBLE) / sum(a.n), 9) AS coverage FROM a LEFT JOIN b USING (conv_id, ch) GROUP BY conv_id""".replace("\\\\", "\\")
)
def coverage_of_joined(spark: SparkSession, d: str) -> DataFrame:
    """Q9, Q6: several exports, joined by new lines, against one text: the last turn of a conversation against all."""
    turns = load(spark, d, "conversations")
    truth = corpus.joined_exports(turns, "conv_id", "turn", "text", "truth")
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("made"))
    return corpus.coverage(truth.join(last, "conv_id"), "conv_id", "truth", "made").withColumn("coverage", F.round("coverage", 9))


# ------------------------------------------------------------------ sinks


@query("SELECT CAST(doc_id AS VARCHAR) AS relpath, 'text' AS cmd, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS exit, sha256(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END) AS sha256, CAST(strlen(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END) AS INTEGER) AS bytes FROM documents")
def golden_rows(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of extracted texts; a document that failed has an exit code and an empty text."""
    failed = F.col("doc_id") % 9 == 0
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(failed, "error").otherwise("ok").alias("status"), F.when(~failed, F.col("text")).alias("text"))
    return sinks.golden(docs)


_PAGE = "CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN replace(html, '</head>', '') WHEN 2 THEN replace(replace(html, '</head>', ''), '<body', '<div') ELSE url END"


@query(
    f"""WITH p AS (SELECT page_id, {_PAGE} AS x FROM pages), i AS (SELECT *, '<style>c{{}}</style>' AS s FROM p)
    SELECT page_id, md5(CASE WHEN contains(x, '</head>') THEN substr(x, 1, instr(x, '</head>') - 1) || s || substr(x, instr(x, '</head>')) WHEN contains(x, '<body>') THEN substr(x, 1, instr(x, '<body>') - 1) || s || substr(x, instr(x, '<body>'))
    WHEN contains(x, '<html>') THEN substr(x, 1, instr(x, '<html>') + 5) || s || substr(x, instr(x, '<html>') + 6) ELSE s || x END) AS digest FROM i"""
)
def styled_pages(spark: SparkSession, d: str) -> DataFrame:
    """A style element put in one of four places."""
    pages = load(spark, d, "pages").select("page_id", F.expr(_PAGE).alias("x"))
    return pages.select("page_id", F.md5(sinks.styled(F.col("x"), "c{}")).alias("digest"))


@query(
    """WITH s AS (SELECT source AS category, count(*) AS files, round(CAST(count(*) FILTER (doc_id % 3 > 0) AS DOUBLE) / count(*), 9) AS rate, avg(CASE WHEN doc_id % 3 > 0 THEN 1.0 ELSE 0.5 END) AS mean FROM documents GROUP BY source
    UNION ALL SELECT '(all)', count(*), round(CAST(count(*) FILTER (doc_id % 3 > 0) AS DOUBLE) / count(*), 9), avg(CASE WHEN doc_id % 3 > 0 THEN 1.0 ELSE 0.5 END) FROM documents)
    SELECT 2 AS ord, printf('| %s | %d | %.1f%% | %.3f |', category, files, rate * 100, mean) AS line FROM s
    UNION ALL VALUES (0, '| category | files | pass rate | mean coverage |'), (1, '| --- | ---: | ---: | ---: |')"""
)
def summary_report(spark: SparkSession, d: str) -> DataFrame:
    """The summary as lines of Markdown."""
    scored = load(spark, d, "documents").select(F.col("source").alias("category"), F.when(F.col("doc_id") % 3 > 0, 1.0).otherwise(0.5).alias("coverage"))
    return corpus.report(corpus.summary(scored))


# ------------------------------------------------------------------ predicates and small functions


@query(
    r"""SELECT doc_id, CAST(length(regexp_replace(text, '[^\x{3000}-\x{9fff}\x{ff01}-\x{ff5e}\x{20}-\x{7e}]', '', 'g')) AS BIGINT) AS visible,
    CAST(length(regexp_replace(text, '[^\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]', '', 'g')) AS BIGINT) AS controls FROM documents"""
)
def character_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Visible characters and control boundaries of each text."""
    return load(spark, d, "documents").select("doc_id", corpus.count_visible(F.col("text")).alias("visible"), corpus.count_controls(F.col("text")).alias("controls"))


@query(
    r"""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text || ' ' WHEN 1 THEN regexp_replace(text, '[\p{Z}\x09-\x0d\x1c-\x1f]+$', '') ELSE text || 'Ѐx' END) AS digest FROM documents"""
)
def trimmed_tails(spark: SparkSession, d: str) -> DataFrame:
    """A tail of white space goes only if an end mark stands in it."""
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 3 == 1, F.lit(" Ѐ　︔\nҐ ")).otherwise(F.lit("Ѐx"))
    return load(spark, d, "documents").select("doc_id", F.md5(corpus.trim_tail(F.concat("text", tail))).alias("digest"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 1 AND 20 THEN chr(9311 + CAST(l_quantity AS INTEGER)) ELSE '(' || CAST(l_quantity AS INTEGER) || ')' END AS circled,
    CASE WHEN l_quantity BETWEEN 1 AND 26 THEN '(' || chr(96 + CAST(l_quantity AS INTEGER)) || ')' ELSE '(' || CAST(l_quantity AS INTEGER) || ')' END AS lettered,
    CASE WHEN l_quantity >= 3 AND (CAST(l_quantity AS INTEGER) - 3) % 4 = 0 THEN (CAST(l_quantity AS INTEGER) - 3) // 4 + 1 END AS declared FROM lineitem"""
)
def list_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Circled and lettered numbers, and how many spans a row header declares."""
    n = F.col("l_quantity").cast("int")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", streams.circled(n).alias("circled"), streams.lettered(n).alias("lettered"), flow_relational.declared_spans(n).alias("declared"))


@query(
    """SELECT o_orderkey, CASE WHEN o > 262144 THEN 'LH5 decompressed bytes' WHEN o > greatest(65536, p * 4) THEN 'LH5 expansion ratio output' END AS resource
    FROM (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS o, o_orderkey % 30000 AS p FROM orders)"""
)
def size_guards(spark: SparkSession, d: str) -> DataFrame:
    """The first limit that a packed size and an original size go beyond; the limit itself is allowed."""
    limits = Limits(member_bytes=262144, ratio=4, ratio_floor=65536)
    return load(spark, d, "orders").select("o_orderkey", documents.exceeded(F.col("o_orderkey") % 30000, F.rint("o_totalprice").cast("bigint"), limits).alias("resource"))


@query("WITH x AS (SELECT l_orderkey, list(CAST(l_suppkey % 11 AS VARCHAR) ORDER BY l_linenumber, l_suppkey) AS c FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(c) >= 4 AND len([x for x in c if x IN ('3', '7')]) <= 2 AS numbers FROM x")
def digit_rows(spark: SparkSession, d: str) -> DataFrame:
    """a row of many cells of which at most two have text without a digit; here of four, and words stand for two of the numbers."""
    word = F.element_at(F.create_map(F.lit("3"), F.lit("three"), F.lit("7"), F.lit("seven")), (F.col("l_suppkey") % 11).cast("string"))
    cells = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.coalesce(word, (F.col("l_suppkey") % 11).cast("string"))).alias("cells"))
    return cells.select("l_orderkey", grids.numbers_columns(F.col("cells"), 4).alias("numbers"))
