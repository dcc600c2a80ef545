"""Queries over bytes: streams that are made from the tables' rows, read by the decoders; the SQL says what they must give, from the published layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from salvora.operators import corpus
from salvora.plans import samples
from salvora.plans.registry import query
from salvora.session import load
from salvora.sources import documents

ADVANCE, WRAP, RUN, REGION = 0x0E, 0x0A, 0x1F, 0xFE01
_SHOWN, _HIDDEN = (0x1C, 1, 7, 0, 0, 1, 0x1D), (0x1C, 1, 7, 0, 1, 2, 0x1D)
_PARAGRAPH = samples.record(0x10, 0, 0x10, 1, 1, 0xFFFF, 0)


def _bytes(*parts) -> Column:
    """Binary of words (int), constant text (str), constant bytes and text columns."""
    return F.unhex(F.concat(*(F.lit(p.hex()) if isinstance(p, bytes) else F.lit(samples.units(p).hex()) if isinstance(p, (int, str)) else F.hex(F.encode(p, "UTF-16BE")) for p in parts)))


def _by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("seq")


def _segment(count: int, words: Column, *parts) -> Column:
    """A stream with a named segment of so many words; the count says whether it is the only one."""
    head = F.concat(F.lit((b"SsmgV.01" + bytes(10) + samples.units(count) + b"TextV.01" + bytes(2)).hex()), F.lpad(F.hex(words.cast("bigint")), 4, "0"))
    return F.unhex(F.concat(head, F.hex(_bytes(*parts))))


_TURN = "conv_id * 1000 + turn"


@query(
    f"""SELECT {_TURN} AS doc_id, (conv_id + turn) % 10 AS shape, CASE (conv_id + turn) % 10
    WHEN 0 THEN text WHEN 1 THEN text || '見える' || '後' WHEN 2 THEN text || '後' WHEN 3 THEN text WHEN 4 THEN '前置' || text WHEN 5 THEN 'あいう' || text
    WHEN 6 THEN text || text WHEN 7 THEN text || '。。' WHEN 8 THEN text ELSE regexp_replace(text, '[\\p{{Z}}\\x09-\\x0d\\x1c-\\x1f]+$', '') END AS text FROM conversations"""
)
def body_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of ten shapes: a run, shown and hidden inlines, a raw segment, a prologue, a rule region, records, a stray run mark, a declared end, and a tail of end marks."""
    t, size = F.col("text"), F.length("text")
    magic = b"SsmgV.01"
    shapes = (
        _bytes(magic, RUN, t),
        _bytes(magic, RUN, t, *_SHOWN, "見える", 0x1E, RUN, "後"),
        _bytes(magic, RUN, t, *_HIDDEN, "ルビ", 0x1E, RUN, "後"),
        _segment(1, size, t, 0, "のこり"),
        _segment(3, size + 2 + len(_PARAGRAPH) // 2, "前置", _PARAGRAPH, t),
        _bytes(magic, RUN, "あ", REGION, 3, 2, "いう", t),
        _bytes(magic, _PARAGRAPH, t, ADVANCE, _PARAGRAPH, t, ADVANCE),
        _bytes(magic, RUN, t, "。。", 0x0B, "z" * 20, RUN, "尾"),
        _segment(3, size + 1, RUN, t, "余り"),
        _bytes(magic, RUN, t, " \u0400\u3000\ufe14\u0490 "),
    )
    turns = load(spark, d, "conversations").select(F.expr(_TURN).alias("doc_id"), ((F.col("conv_id") + F.col("turn")) % 10).alias("shape"), F.col("text"))
    bodies = turns.select("doc_id", "shape", F.element_at(F.array(*shapes), (F.col("shape") + 1).cast("int")).alias("content"))
    shown = documents.elements(bodies).filter("kind in ('run', 'inline')").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"]), "").alias("text"))
    return shown.select(F.col("doc_id").cast("bigint").alias("doc_id"), corpus.trim_tail(F.col("text")).alias("text")).join(bodies.select("doc_id", "shape"), "doc_id")


@query(
    f"""SELECT {_TURN} AS doc_id, i AS seq, kind, selector, code FROM conversations, (VALUES (0, 'run', NULL, NULL), (1, 'inline', 3, NULL), (2, 'skipped', 2, NULL), (3, 'run', NULL, NULL), (4, 'boundary', NULL, 11)) v(i, kind, selector, code)"""
)
def body_elements(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of elements, selectors of inlines and the code of a control."""
    shown = (*_SHOWN[:5], 3, 0x1D)
    bodies = load(spark, d, "conversations").select(F.expr(_TURN).alias("doc_id"), _bytes(b"SsmgV.01", RUN, F.col("text"), *shown, "見", 0x1E, *_HIDDEN, "ルビ", 0x1E, RUN, "後", 0x0B).alias("content"))
    found = documents.elements(bodies).filter("kind <> 'boundary' or code = 11")
    order = F.row_number().over(_by_doc()) - 1
    return found.withColumn("i", order).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("i").alias("seq"), "kind", "selector", "code")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN [2 * length(url) + 2, 2 * length(url) + 18] ELSE [2 * length(url) + 3, 2 * length(url) + 19] END AS every, CASE WHEN page_id % 2 = 0 THEN [length(url) + 1, length(url) + 9] ELSE [] END AS words FROM pages")
def marker_offsets(spark: SparkSession, d: str) -> DataFrame:
    """where the body's mark is, at any byte, and at whole words with words behind it."""
    magic = b"SsmgV.01"
    odd = F.when(F.col("page_id") % 2 == 1, F.lit(b"\x20")).otherwise(F.lit(b""))
    data = F.concat(odd, _bytes(" ", F.col("url")), F.lit(magic + b"12345678" + magic + b"ab"))
    return documents.marker_offsets(load(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), data.alias("content"))).select(F.col("doc_id").cast("bigint").alias("page_id"), "every", "words")


# ------------------------------------------------------------------ packed members


def _compressed(texts: DataFrame) -> DataFrame:
    """(doc_id, content): texts in containers that are packed with copies from near and far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [samples.write_compound({"/JSCompDocument": samples.wrapper(samples.write_compound({"/DocumentText": samples.stream(samples.units(RUN, t))}))}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["doc_id", "content"])

    return texts.mapInArrow(run, "doc_id string, content binary")


@query(f"SELECT CAST({_TURN} AS VARCHAR) AS doc_id, 'cfb-just-compressed-document' AS format, 'ok' AS status, md5(repeat(text || '。', 12)) AS digest FROM conversations WHERE turn < 2")
def packed_documents(spark: SparkSession, d: str) -> DataFrame:
    """LH5 members with literals, copies over the ring's whole width, several blocks and position codes of every length."""
    texts = load(spark, d, "conversations").filter("turn < 2").select(F.expr(f"cast({_TURN} as string)").alias("doc_id"), F.repeat(F.concat("text", F.lit("。")), 12).alias("text"))
    found = documents.documents(_compressed(texts))
    return found.select("doc_id", "format", "status", F.md5("text").alias("digest"))


# ------------------------------------------------------------------ parts of documents


def _files(rows: DataFrame, build, columns: list[str]) -> DataFrame:
    """(doc_id, content): a container for each row, from its first column's name and build(the rest) -> {path: bytes}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [samples.write_compound(build(*values[1:])) for values in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return rows.select(F.col(columns[0]).cast("string").alias("doc_id"), *columns[1:]).mapInArrow(run, "doc_id string, content binary")


def _whole(name: str, key: int, nation: int) -> dict[str, bytes]:
    head = [f"{name} - ? -", " ", "二行目\r\n"][: key % 4]
    boxes = [f"枠{name}", "長" * (20 * (nation % 9)), "<終>"][: key % 3 + 1]
    notes = samples.stream(samples.units(RUN, *_SHOWN, "*1", 0x1E, RUN, f"注{name}", 0x0B, 0x1E, RUN, "続き", *_SHOWN, "*2", 0x1E, RUN, "次"))
    files = {"/DocumentText": samples.stream(samples.units(RUN, f"本文{name}"))}
    if key % 4:
        files["/Header"] = samples.slots(head)
    if key % 5:
        files["/LayoutBoxText"] = samples.slots(boxes) if key % 5 < 4 else samples.slots(boxes)[:-256]
    if key % 2:
        files["/Footnote"] = notes
    return files


_PARTS = """
p AS (SELECT s_suppkey AS k, s_name AS n, s_nationkey AS c FROM supplier),
q AS (SELECT k, n, [x for x in [CASE WHEN k % 4 >= 1 THEN n || ' - 1 -' END, CASE WHEN k % 4 >= 3 THEN '二行目' END] if x IS NOT NULL] AS header,
  CASE WHEN k % 5 IN (0, 4) THEN [] ELSE [x for x in ['枠' || n, CASE WHEN k % 3 >= 1 THEN repeat('長', CAST(20 * (c % 9) AS INTEGER)) END, CASE WHEN k % 3 >= 2 THEN '<終>' END] if x IS NOT NULL] END AS boxes,
  CASE WHEN k % 2 = 1 THEN '*1 注' || n || ' 続き' || chr(10) || '*2 次' END AS notes FROM p),
r AS (SELECT *, [b for b in boxes if b <> ''] AS shown FROM q)
"""


@query(
    f"""WITH {_PARTS} SELECT CAST(k AS VARCHAR) AS doc_id, header, boxes, notes, '本文' || n || CASE WHEN notes IS NULL THEN '' ELSE chr(10) || chr(10) || notes END AS combined,
    CASE WHEN len(header) = 0 THEN '' ELSE array_to_string(header, chr(10)) || chr(10) || chr(10) END || '<p>本文' || n || '</p>' || CASE WHEN notes IS NULL THEN '' ELSE chr(10) || chr(10) || '<p>' || notes || '</p>' END ||
    CASE WHEN len(shown) = 0 THEN '' ELSE chr(10) || '※枠内テキスト' || chr(10) || '<div class="layout-box"><p>' || replace(replace(array_to_string(shown, '</p><p>'), '<終', '&lt;終'), '終>', '終&gt;') || '</p></div>' END AS xhtml FROM r"""
)
def document_parts(spark: SparkSession, d: str) -> DataFrame:
    """Headers with page marks, boxes of one slot and of several, damaged ones, footnotes with labels, and how they are put together."""
    files = _files(load(spark, d, "supplier"), _whole, ["s_suppkey", "s_name", "s_suppkey", "s_nationkey"])
    return documents.documents(files).select("doc_id", "header", "boxes", "notes", "combined", "xhtml")


def _sheets(region: str, names: list[str], keys: list[int]) -> dict[str, bytes]:
    files = {
        "/DocumentText": samples.stream(samples.units(RUN, f"根{region}")), "/ObjectSheets/SheetInfo": samples.root_sheet(region), "/ObjectSheets/DocSheet/DocItemInfo": samples.sheet_list(list(zip(names, keys))),
        "/ObjectSheets/DocSheet/DocItemInfo2": samples.counted_paths([f"C:\\{n}.jtd" for n in names[:-1]]),
    }
    for n, k in zip(names, keys):
        if k % 3:
            files[f"/ObjectSheets/DocSheet/DOCS_{k:04d}/DocumentText"] = samples.stream(samples.units(RUN, f" 枝{n} "))
        if k % 3 == 1:
            files[f"/ObjectSheets/DocSheet/DOCS_{k:04d}/Footnote"] = samples.stream(samples.units(RUN, f"注{n}"))
    return files


def _sheet_files(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("s"))
    rows = load(spark, d, "region").join(own, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "r_name", F.transform("s", lambda x: x["n_name"]).alias("names"), F.transform("s", lambda x: x["n_nationkey"] + 7).alias("keys"))
    return _files(rows, _sheets, ["r_regionkey", "r_name", "names", "keys"])


_SUBS = "s AS (SELECT r_regionkey AS r, r_name, n_name AS n, n_nationkey + 7 AS k, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY r_regionkey) AS c, '/ObjectSheets/DocSheet/DOCS_' || lpad(CAST(n_nationkey + 7 AS VARCHAR), 4, '0') AS p FROM region JOIN nation ON n_regionkey = r_regionkey)"


@query(
    f"""WITH {_SUBS} SELECT CAST(r AS VARCHAR) AS doc_id, i AS idx, n AS name, p AS storage_path, CASE WHEN i < c THEN 'C:\\' || n || '.jtd' END AS original_path, p || '/DocumentText' AS body_path, p || '/Footnote' AS notes_path FROM s
    UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 0, r_name, '', NULL, '/DocumentText', '/Footnote' FROM region"""
)
def sheet_table(spark: SparkSession, d: str) -> DataFrame:
    """The root's name, names and numbers of the sheets below, their paths by place, and where their streams are."""
    return documents.sheet_items(_sheet_files(spark, d))


@query(
    f"""WITH {_SUBS}, t AS (SELECT r, i, n || chr(10) || CASE WHEN k % 3 > 0 THEN '枝' || n ELSE '' END || CASE WHEN k % 3 = 1 THEN chr(10) || chr(10) || '注' || n ELSE '' END AS text,
    '<div class="sheet"><h2>' || n || '</h2>' || CASE WHEN k % 3 > 0 THEN '<p> 枝' || n || ' </p>' ELSE '' END || CASE WHEN k % 3 = 1 THEN '<p>注' || n || '</p>' ELSE '' END || '</div>' AS x FROM s
    UNION ALL SELECT r_regionkey, 0, r_name || chr(10) || '根' || r_name, '<div class="sheet"><h2>' || r_name || '</h2><p>根' || r_name || '</p></div>' FROM region)
    SELECT CAST(r AS VARCHAR) AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS combined, string_agg(x, '' ORDER BY i) AS xhtml FROM t GROUP BY r"""
)
def sheet_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sheets under their names, with their own bodies and footnotes."""
    return documents.documents(_sheet_files(spark, d)).select("doc_id", "combined", "xhtml")


def _boxed(name: str, key: int) -> dict[str, bytes]:
    emf = b"\1\0\0\0" + bytes(36) + b" EMF" + bytes(60) + name.encode()
    files = {"/DocumentText": samples.stream(samples.units(RUN, "x")), "/Objects/Embedding 2/Contents": b"12345" + (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff1", b"GIF89a", b"BM" + bytes(12) + b"\x28\0\0\0", b"none")[key % 5] + name.encode()}
    files["/Objects/ OLEItem/Contents"] = b"GIF89a" + name.encode()
    files["/Objects/embedding 1/\x03EmbeddedPress"] = b"METAFILE" + bytes(2 * (key % 3)) + (b"\1\0\x09\0" + name.encode() if key % 2 else emf)
    files["/Objects/embedding 1/\x01Workbook"] = (b"\x09\x08" + bytes(20), b"no workbook")[key % 4 == 3]
    files["/Plain/Contents"] = b"GIF89a"
    return files


@query(
    """WITH o AS (SELECT n_nationkey AS k, n_name AS n, unnest([1, 2, 3, 4]) AS rank FROM nation),
    a AS (SELECT k, n, rank, CASE rank WHEN 1 THEN CASE WHEN k % 4 < 3 THEN 'xls' END WHEN 2 THEN CASE WHEN k % 2 = 1 THEN 'wmf' ELSE 'emf' END WHEN 3 THEN CASE k % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' END ELSE 'gif' END AS kind FROM o),
    b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN rank = 4 THEN 0 ELSE rank END) AS idx FROM a WHERE kind IS NOT NULL)
    SELECT CAST(k AS VARCHAR) AS doc_id, CAST(idx AS INTEGER) AS idx, 'embedded-' || idx || '.' || kind AS name, CASE rank WHEN 1 THEN '/Objects/embedding 1/' || chr(1) || 'Workbook' WHEN 2 THEN '/Objects/embedding 1/' || chr(3) || 'EmbeddedPress' WHEN 3 THEN '/Objects/Embedding 2/Contents' ELSE '/Objects/ OLEItem/Contents' END AS rel_path,
    rank = 1 OR rank = 4 OR true AS tail FROM b"""
)
def object_slices(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks, presses and contents by storage and kind; what holds no image is no object; each slice ends with the object's own bytes."""
    files = _files(load(spark, d, "nation"), _boxed, ["n_nationkey", "n_name", "n_nationkey"])
    found = documents.objects(files).withColumn("key", F.col("doc_id").cast("int")).join(load(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name"), "key")
    ends = F.endswith("payload", F.encode("n_name", "UTF-8")) | F.endswith("name", F.lit(".xls"))
    return found.select("doc_id", "idx", "name", "rel_path", ends.alias("tail"))


# ------------------------------------------------------------------ walls


@query(
    """WITH m(i, id, side) AS (VALUES (0, 1, 'Trailing'), (1, 3, 'Unknown'), (2, 9, 'Leading'), (3, 12, 'Unknown'), (4, 14, 'Unknown'), (5, 18, 'Unknown'), (6, 150, 'Unknown'), (7, 8, NULL))
    SELECT n_nationkey, v.seq, v.orientation, v.weight, CASE WHEN v.orientation = 'Vertical' THEN side ELSE 'Unknown' END AS side
    FROM nation JOIN m ON m.i = n_nationkey % 8 AND side IS NOT NULL, (VALUES (0, 'Vertical', 'Thick'), (1, 'Horizontal', 'Thin')) v(seq, orientation, weight)"""
)
def wall_rules(spark: SparkSession, d: str) -> DataFrame:
    """A3: rules behind fences, by the byte before; other bytes make none."""
    ids = F.array(*(F.lit(f"{i:02x}") for i in (1, 3, 9, 12, 14, 18, 150, 8)))
    fence = F.concat(F.element_at(ids, (F.col("n_nationkey") % 8 + 1).cast("int")), F.lit("fe020200030302000101020003ff"))
    bodies = load(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(_bytes(b"SsmgV.01", RUN, F.col("n_name")), F.unhex(F.concat(F.lit("00"), fence))).alias("content"))
    found = documents.walls(documents.flow_events(bodies))
    return found.select(F.col("doc_id").cast("int").alias("n_nationkey"), (F.row_number().over(_by_doc()) - 1).alias("seq"), "orientation", "weight", "side")


# ------------------------------------------------------------------ tables

A, B, C = (8, 40), (41, 80), (81, 120)


def _row(*cells, wraps=(), head: int = 0, flags=()) -> bytes:
    """cells: (left, right, text); wraps: places of cells that end with one; head: declared spans, 0 for none."""
    out = [samples.record(0x10, 0, 0x8F, 4 * (head - 1) + 3, 8, *([8, 0x13, 0, 0] * (head - 1)), 0)] if head else []
    for i, (left, right, text) in enumerate(cells):
        out += [samples.record(0x30, 0, left, right, *(flags[i] if i < len(flags) else (0xFF, 0))), samples.units(text), *([samples.units(WRAP)] if i in wraps else [])]
    return b"".join([*out, samples.units(ADVANCE)])


_END = samples.record(0x20, 0, 0x10, 2, 0, 1)
_DIGITS = [(8 + 10 * i, 17 + 10 * i, str(i + 1)) for i in range(8)]


def _table(*rows: str) -> str:
    """Rows of cells parted by |, each with its spans in front: r3c2:text."""
    def cell(x: str) -> str:
        spans, _, text = x.rpartition(":")
        put = "".join(f' {name}="{n}"' for mark, name in (("r", "rowspan"), ("c", "colspan")) for n in [dict(zip(spans[::2], spans[1::2])).get(mark)] if n)
        return f"<td{put}>{text}</td>"

    return "<table><tbody>" + "".join("<tr>" + "".join(map(cell, r.split("|"))) + "</tr>" for r in rows) + "</tbody></table>"


#: Name, stream and the XHTML it must give; @ stands for a name from the table. Which rules of the published decision table they go through is said with each.
SCENARIOS = (
    ("stable grid, committed by a paragraph (A13, A21)", [_PARAGRAPH, "はじめ@", _row((*A, "銀@"), (*B, "けぶった")), _row((*A, "天上"), (*B, "白い")), _PARAGRAPH, "おわり"], "<p>はじめ@</p>" + _table("銀@|けぶった", "天上|白い") + "<p>おわり</p>"),
    ("opened by a row header (A12, A13)", [_row((*A, "甲@"), (*B, "乙"), head=2), _END, _PARAGRAPH, "後"], _table("甲@|乙") + "<p>後</p>"),
    ("one row without a header is no table, and waits to the end (A12, A21)", [_row((*A, "甲"), (*B, "乙@")), _PARAGRAPH, "続き"], "<p>続き甲乙@</p>"),
    ("one cell and no table is a paragraph (A12)", [_PARAGRAPH, "本文@", samples.units(ADVANCE), _row((*A, "ただ一つ")), _PARAGRAPH, "次"], "<p>本文@</p><p>ただ一つ</p><p>次</p>"),
    ("a paragraph's wraps (A10, O4)", [_PARAGRAPH, "一@", samples.units(WRAP), "二", samples.units(ADVANCE), _PARAGRAPH, "三"], "<p>一@<br/>二</p><p>三</p>"),
    ("a cell's wraps are one space, at its ends none (A10, O4)", [samples.record(0x10, 0, 0x8F, 7, 8, 8, 0x13, 0, 0, 0), samples.record(0x30, 0, *A, 0xFF, 0), samples.units(WRAP, "一@", WRAP, WRAP, "二"), samples.record(0x30, 0, *B, 0xFF, 0), "値", samples.units(ADVANCE)], _table("一@ 二|値")),
    ("a tall row goes on with a seam (A15)", [_row((*A, "一"), (*B, "長い@"), wraps=(1,), head=2), _row((*A, ""), (*B, "続き"), head=2), _row((*A, "二"), (*B, "次"), head=2)], _table("一|長い@<br/>続き", "二|次")),
    ("two full rows merge (A15)", [_row((*A, "一@"), (*B, "長い"), wraps=(0, 1), head=2), _row((*A, "目"), (*B, "続き"), head=2), _END], _table("一@<br/>目|長い<br/>続き")),
    ("a closed cell begins a new row (A16)", [_row((*A, "一"), (*B, "済@"), wraps=(0,), head=2), _row((*A, "二"), (*B, "次"), head=2, flags=((0xFF, 0), (3, 0))), _END], _table("一|済@", "二|次")),
    ("an indented row goes on (A17)", [_row((*A, "項@"), (*B, "説明"), head=2), _row((*A, ""), (*B, " 続き"), head=2), _END], _table("項@|説明<br/> 続き")),
    ("strips of four without text go (A11)", [_row((4, 8, ""), (*A, "一@"), (*B, "二"), head=3), _row((4, 8, ""), (*A, "三"), (*B, "四"), head=3), _END], _table("一@|二", "三|四")),
    ("columns of a wider row, and padding (A26, A27, A29, A30)", [_row((*A, "一@"), (*B, "二"), (*C, "三"), head=3), _row((8, 80, "広い"), (*C, "右"), head=2), _row((*A, "左"), (*C, "端"), head=2)], _table("一@|二|三", "c2:広い|右", "左||端")),
    ("rows that a cell reaches down (A28)", [_row((*A, "高い@"), (*B, "一"), (*C, "x"), head=3), _row((*B, "二"), (*C, "y"), head=2), _row((*B, "三"), (*C, "z"), head=2), _END], _table("r3:高い@|一|x", "二|y", "三|z")),
    ("a row of one cell in a table (A12)", [_row((*A, "一@"), (*B, "二"), head=2), _row((8, 80, "全幅")), _row((*A, "三"), (*B, "四"), head=2), _END], _table("一@|二", "c2:全幅", "三|四")),
    ("a head row that waited is adopted (A14)", [_row((*A, "見出し@"), (*B, "列")), _row((*A, "一"), (*B, "二"), head=2), _END], _table("見出し@|列", "一|二")),
    ("a row that waited and does not fit is a paragraph (A14, A21)", [_row((9, 40, "関係@"), (42, 80, "なし")), _row((*A, "一"), (*B, "二"), head=2), _END], "<p>関係@なし</p>" + _table("一|二")),
    ("a row of numbered columns that waited is adopted (A14, F19)", [_row(*_DIGITS), _row((9, 40, "品@"), (42, 80, "年"), head=2), _END], _table("c2:1|2|3|c2:4|5|6|7|8", "|c4:品@|c5:年")),
    ("a band of wrapped rows is one row (A18, A19)", [_row((*A, "時@"), (*B, "一"), head=2), _row((*A, "天"), (*B, "国"), wraps=(0, 1)), _row((*A, "気"), (*B, "語"), wraps=(0,)), _END], _table("時@|一", "天気|国語")),
    ("how a band's texts join (A20)", [_row((*A, "時@"), (*B, "一"), head=2), _row((*A, "12"), (*B, "ab"), wraps=(0, 1)), _row((*A, "34"), (*B, "美術"), wraps=(0,)), _END], _table("時@|一", "12 34|ab <br/>美術")),
    ("a span that opens again parts a band (A19)", [_row((*A, "甲@"), (*B, "乙"), (*C, "丙"), head=3), _row((*A, "天"), (*B, "国"), (*C, "一"), wraps=(0, 2)), _row((*A, "気"), (*C, "二"), wraps=(0, 1)), _row((*A, "輪"), (*B, "語"), (*C, "三"), wraps=(0, 2)), _END], _table("甲@|乙|丙", "r2:天気輪|国|r2:一二三", "語")),
    ("an anchor takes the row below (A22)", [_row((*A, "見出@"), (*B, "値"), head=2, flags=((0xFF, 2), (0xFF, 0))), _row((*A, "続き"), (*B, ""), head=2), _END], _table("見出@<br/>続き|値")),
    ("fragments of a rule are the cell about them (A23)", [_row((*A, "一@"), (*B, "二"), head=2), _row((*A, "三"), (41, 47, ""), (48, 54, ""), head=3), _END], _table("一@|二", "三|")),
    ("a blank column takes the texts below (A24)", [_row((8, 20, ""), (21, 80, "一@"), wraps=(0,), head=2, flags=((0xFF, 0), (3, 0))), _row((8, 20, "縦"), (21, 80, "二"), wraps=(0,), head=2, flags=((0xFF, 0), (3, 0))), _row((8, 20, "書"), (21, 80, "三"), wraps=(0,), head=2, flags=((0xFF, 0), (3, 0))), _END], _table("r3:縦<br/>書|一@", "二", "三")),
    ("a blank column at the edge goes (A25)", [_row((0, 6, ""), (*A, "一@"), (*B, "二"), head=3), _row((0, 6, ""), (*A, "三"), (*B, "四"), head=3), _END], _table("一@|二", "三|四")),
    ("neighbours of one span are one cell (A9)", [samples.record(0x10, 0, 0x8F, 7, 8, 8, 0x13, 0, 0, 0), samples.record(0x30, 0, *A, 0xFF, 0), "一", samples.record(0x30, 0, *A, 0xFF, 0), "@", samples.record(0x30, 0, *B, 0xFF, 0), "値", samples.units(ADVANCE)], _table("一@|値")),
)


def _scenario_bodies(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, content): a stream for each scenario and nation; doc_id is the scenario's place and the nation's key."""
    name, streams = F.hex(F.encode("n_name", "UTF-16BE")), []
    for _, units, _ in SCENARIOS:
        whole = samples.stream(*(u if isinstance(u, bytes) else samples.units(u) for u in units)).hex().upper()
        streams.append(F.replace(F.lit(whole), F.lit("0040"), name))
    rows = load(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(*streams)).alias("i", "hex"))
    return rows.select(F.concat_ws(":", "i", "n_nationkey").alias("doc_id"), F.unhex("hex").alias("content"))


@query(
    "SELECT i || ':' || n_nationkey AS doc_id, replace(x, '@', n_name) AS xhtml FROM nation, (VALUES "
    + ", ".join(f"({i}, '{x}')" for i, (_, _, x) in enumerate(SCENARIOS))
    + ") v(i, x)"
)
def table_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """A stream for each rule by which rows become tables, for every nation, as XHTML."""
    return documents.rendered(_scenario_bodies(spark, d)).select("doc_id", "xhtml")


@query(
    "SELECT i || ':' || n_nationkey AS doc_id, md5(regexp_replace(replace(x, '@', n_name), '<[^>]*>|[ ]', '', 'g')) AS digest FROM nation, (VALUES "
    + ", ".join(f"({i}, '{x}')" for i, (_, _, x) in enumerate(SCENARIOS))
    + ") v(i, x)"
)
def plain_views(spark: SparkSession, d: str) -> DataFrame:
    """The plain view of the same has the same characters, but for white space, in the same order."""
    return documents.rendered(_scenario_bodies(spark, d)).select("doc_id", F.md5(F.regexp_replace("plain", r"\s", "")).alias("digest"))
