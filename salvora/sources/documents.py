"""Documents as DataFrames: files in, and streams, elements, events, blocks, cells, objects and rendered text out.

Files come from Spark's own binaryFile source, so any store that Spark reads will do, and a filter on length keeps what is too large from being read.
Bytes are decoded in Arrow batches, one document at a time; a document that fails is a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from salvora.functions import embedded, flow, render, words
from salvora.functions.document import BODY, DAMAGE, detect_format, read_document
from salvora.functions.errors import DocumentError
from salvora.functions.limits import Limits
from salvora.functions.streams import sheets
from salvora.functions.tables import assemble
from salvora.sources.compound import CompoundFile

# The type of these files and its other names.
CONTENT_TYPE, ALIASES = "application/vnd.justsystems.ichitaro", ("application/x-jtd", "application/x-ichitaro-jtd", "application/jtd")
SUFFIXES = ("jtd", "jtt", "jttc")
# Marks of the type in a compound file, and the bytes where they may begin.
MARKS = (b"SsmgV.01", "DocumentText".encode("utf-16-le"), "JSSlip".encode("utf-16-le"), b"JustCompressedDocument", "JSCompDocument".encode("utf-16-le"), b"-lh5-")
MARK_FROM, MARK_TO = 512, 65536
DOCUMENTS = "doc_id string, format string, status string, error_kind string, error_message string, limit_resource string, limit_value bigint, limit_actual bigint, source string, text string, header array<string>, boxes array<string>, notes string, sheets array<string>, n_objects int, combined string, xhtml string, markdown string"
STREAMS = "doc_id string, ord int, stream_path string, size bigint, content binary, error string"
ENTRIES = "doc_id string, ord int, kind string, path string, size bigint, child_count int, error string"
ELEMENTS = "doc_id string, seq int, kind string, selector int, text string, raw binary, code int"
EVENTS = "doc_id string, seq int, kind string, w4 int, n int, left int, right int, flags int, flags2 int, text string, orientation string, weight string, side string"
CELLS = "doc_id string, block_idx int, kind string, row_idx int, cell_idx int, left int, right int, colspan int, rowspan int, text string, parts array<struct<kind:string,text:string>>"
OBJECTS = "doc_id string, idx int, name string, content_type string, rel_path string, payload binary"


def within_limit(found: DataFrame, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) of (path, length, content): (doc_id, length, content) up to the input limit, and errors for what is above it, without its content."""
    limit = (limits or Limits()).input_bytes
    files = found.filter(F.col("length") <= limit).select(F.col("path").alias("doc_id"), "length", "content")
    rejected = found.filter(F.col("length") > limit).select(F.col("path").alias("doc_id"), F.lit("error").alias("status"), F.lit("ResourceLimit").alias("error_kind"), F.lit("input bytes").alias("limit_resource"), F.lit(limit).cast("bigint").alias("limit_value"), F.col("length").alias("limit_actual"))
    return files, rejected


def exceeded(packed: Column, original: Column, limits: Limits | None = None) -> Column:
    """The first limit that a member's sizes go beyond, null if none."""
    lim = limits or Limits()
    return F.when(original > lim.member_bytes, "LH5 decompressed bytes").when(original > F.greatest(F.lit(lim.ratio_floor), packed * lim.ratio), "LH5 expansion ratio output")


def with_suffix(paths: DataFrame, suffixes: tuple = SUFFIXES) -> DataFrame:
    """Rows whose path ends with one of the suffixes, in small letters as they are."""
    return paths.filter(F.regexp_like("path", F.lit(rf"\.(?:{'|'.join(suffixes)})$")))


def read_files(spark: SparkSession, path: str, suffixes: tuple = SUFFIXES, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, rejected) below path: (doc_id, length, content), and the rows of those above the input limit, which are never read."""
    return within_limit(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path), limits)


def _decoded(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterable[tuple]], batch: int = 64) -> DataFrame:
    """files (doc_id, content) through a decoder; output goes out in batches of bounded numbers of rows."""
    spark_schema: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def put(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for doc_id, content in zip(b.column(0), b.column(1)):
                for row in rows(doc_id.as_py(), content.as_py() or b""):
                    held.append((doc_id.as_py(), *row))
                    if len(held) >= batch:
                        yield put(held)
                        held = []
        if held:
            yield put(held)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, spark_schema)


def documents(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row for each file: format, status, error columns, text, parts and renderings."""

    def rows(doc_id: str, data: bytes) -> Iterator[tuple]:
        d = read_document(data, limits)
        yield (d.format, d.status, d.error_kind, d.error_message, d.limit_resource, d.limit_value, d.limit_actual, d.source, d.text, d.header, d.boxes, d.notes, [s.name for s in d.sheets], len(d.objects), d.combined, d.xhtml, d.markdown)

    return _decoded(files, DOCUMENTS, rows)


def _tree(data: bytes, rows: Callable[[CompoundFile], Iterable[tuple]], empty: tuple) -> Iterable[tuple]:
    try:
        return list(rows(CompoundFile(data)))
    except DAMAGE as e:
        return [(*empty, str(e))]


def streams(files: DataFrame) -> DataFrame:
    """One row for each stream of each container, in tree order; a container that cannot be read is a row with its error."""
    return _decoded(files, STREAMS, lambda _, data: _tree(data, lambda f: ((i, e.path, e.size, f.read(e.path), None) for i, e in enumerate(x for x in f.entries() if x.kind == "DOC")), (0, None, None, None)))


def entries(files: DataFrame) -> DataFrame:
    """One row for each directory and stream."""
    return _decoded(files, ENTRIES, lambda _, data: _tree(data, lambda f: ((i, e.kind, e.path, e.size, e.children, None) for i, e in enumerate(f.entries())), (0, None, None, None, None)))


def elements(bodies: DataFrame) -> DataFrame:
    """Text elements of body streams (doc_id, content)."""
    return _decoded(bodies, ELEMENTS, lambda _, data: ((i, e.kind, e.selector, e.text, e.raw, e.code) for i, e in enumerate(words.elements(data))), 4096)


def flow_events(bodies: DataFrame) -> DataFrame:
    return _decoded(bodies, EVENTS, lambda _, data: ((i, *e) for i, e in enumerate(flow.events(data))), 4096)


def walls(events: DataFrame) -> DataFrame:
    """Rules about cells, of which tables take no notice."""
    return events.filter("kind = 'WallRule'").select("doc_id", "seq", "orientation", "weight", "side")


def cells(bodies: DataFrame) -> DataFrame:
    """Blocks of body streams, flat: a row for each cell, and for each paragraph with row and cell 0."""

    def rows(_: str, data: bytes) -> Iterator[tuple]:
        for b, block in enumerate(assemble(flow.events(data))):
            table = block.rows if block.kind == "table" else [[None]]
            for r, row in enumerate(table):
                for k, c in enumerate(row):
                    parts = block.parts if c is None else c.parts
                    shape = (None, None, 1, 1) if c is None else (c.left, c.right, c.colspan, c.rowspan)
                    yield (b, block.kind, r, k, *shape, "".join(t for _, t in parts), [{"kind": a, "text": t} for a, t in parts])

    return _decoded(bodies, CELLS, rows, 4096)


def rendered(bodies: DataFrame) -> DataFrame:
    """(doc_id, xhtml, markdown, plain) of the blocks of body streams."""

    def rows(_: str, data: bytes) -> list[tuple]:
        blocks = assemble(flow.events(data))
        return [(render.xhtml(blocks), render.markdown(blocks), render.plain(blocks))]

    return _decoded(bodies, "doc_id string, xhtml string, markdown string, plain string", rows)


def marker_offsets(files: DataFrame) -> DataFrame:
    """(doc_id, every, words): where the body's mark is in the bytes, at any place, and counted in words at whole ones with words behind it."""
    return _decoded(files, "doc_id string, every array<int>, words array<int>", lambda _, data: [(words.magic_offsets(data), flow.magic_words(data))])


def sheet_items(files: DataFrame) -> DataFrame:
    """(doc_id, idx, name, storage_path, original_path, body_path, notes_path) of the sheets of each file, the root first; a damaged file has none."""

    def rows(_: str, data: bytes) -> list[tuple]:
        try:
            return [(s.index, s.name, s.storage, s.original, s.body, s.notes) for s in sheets(CompoundFile(data).read)]
        except (*DAMAGE, DocumentError):
            return []

    return _decoded(files, "doc_id string, idx int, name string, storage_path string, original_path string, body_path string, notes_path string", rows)


def objects(files: DataFrame) -> DataFrame:
    def rows(_: str, data: bytes) -> list[tuple]:
        try:
            return [tuple(asdict(o).values()) for o in embedded.objects(CompoundFile(data))]
        except DAMAGE:
            return []

    return _decoded(files, OBJECTS, rows, 1)


def object_texts(found: DataFrame, parsers: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """(doc_id, idx, text) of objects whose content type has a parser; a parser that fails gives a null text and leaves the rest as it is."""

    def rows(_: str, data: bytes) -> list[tuple]:
        kind, idx, payload = data.split(b"\0", 2)
        try:
            return [(int(idx), parsers[kind.decode()](payload))]
        except Exception:  # noqa: BLE001  whatever a foreign parser raises
            return [(int(idx), None)]

    chosen = found.filter(F.col("content_type").isin(list(parsers)))
    joined = F.concat(F.encode("content_type", "UTF-8"), F.lit(b"\0"), F.encode(F.col("idx").cast("string"), "UTF-8"), F.lit(b"\0"), F.col("payload"))
    return _decoded(chosen.select("doc_id", joined.alias("content")), "doc_id string, idx int, text string", rows)


def bodies(all_streams: DataFrame) -> DataFrame:
    """The body streams of a streams table."""
    return all_streams.filter(F.col("stream_path") == BODY).select("doc_id", "content")


def stream_magic(content: Column) -> Column:
    """Label of a stream's magic, in the JVM."""
    out = F.when(F.octet_length(content) == 0, "EMPTY")
    for label, mark in embedded._AT_START:
        out = out.when(F.startswith(content, F.lit(mark)), label)
    first = F.substring(content, 1, 4) == F.lit(b"\x01\0\0\0")
    second = F.hex(F.substring(content, 5, 4))
    size = F.conv(F.concat(*(F.substring(second, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("bigint")
    out = out.when((F.octet_length(content) >= 88) & first & size.between(88, 2**31 - 1), "EMF")
    for label, mark in embedded._ANYWHERE:
        out = out.when((F.position(F.lit(mark), F.substring(content, 1, 512)) > 0) & (F.octet_length(content) >= 8 if label == "WMF" else F.lit(True)), label)
    return out.otherwise("UNKNOWN")


def file_name(stream_path: Column) -> Column:
    """A stream's path as a file name: slashes and white space become underscores, controls are percent-coded."""
    out = stream_path
    for code in (*range(0x01, 0x09), *range(0x0E, 0x1C)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.regexp_replace(out, r"[/\p{Z}\x09-\x0d\x1c-\x1f]", "_")


def dump(all_streams: DataFrame, limit: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(written, skipped): streams up to a size with their file names, and the paths of larger ones."""
    named = all_streams.filter("stream_path is not null")
    return named.filter(F.col("size") <= limit).select("doc_id", file_name(F.col("stream_path")).alias("file"), "content"), named.filter(F.col("size") > limit).select("doc_id", "stream_path", "size")


def formats(files: DataFrame) -> DataFrame:
    """(doc_id, format) of each file."""
    return _decoded(files, "doc_id string, format string", lambda _, data: [(detect_format(data),)])


def sniffed(path: Column, content: Column) -> Column:
    """The type by name or by magic: a suffix of these files, in small or capital letters, or a compound file with one of the marks at bytes 512 to 65,536."""
    compound = F.startswith(content, F.lit(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | (F.position(F.lit(mark), F.substring(content, MARK_FROM + 1, MARK_TO - MARK_FROM + len(mark))) > 0)
    named = F.regexp_like(path, F.lit(rf"\.(?:{'|'.join(SUFFIXES)}|{'|'.join(SUFFIXES).upper()})$"))
    return F.when((compound & marked) | named, F.lit(CONTENT_TYPE)).otherwise(F.lit("application/octet-stream"))


def register(spark: SparkSession) -> None:
    """Table functions for SQL, which give no rows for damaged bytes: cfb_streams(content), text_elements(body), flow_events(body); and nfkc(text)."""
    from salvora.operators.corpus import nfkc

    def table(returns: str, rows: Callable[[bytes], Iterable[tuple]]):
        class Eval:
            def eval(self, data: bytes):
                try:
                    found = list(rows(data or b""))
                except DAMAGE:
                    found = []
                yield from found

        return F.udtf(Eval, returnType=returns)

    spark.udtf.register("cfb_streams", table("stream_path string, size int, content binary", lambda d: ((e.path, e.size, f.read(e.path)) for f in [CompoundFile(d)] for e in f.entries() if e.kind == "DOC")))
    spark.udtf.register("text_elements", table("seq int, kind string, text string", lambda d: ((i, e.kind, e.text) for i, e in enumerate(words.elements(d)))))
    spark.udtf.register("flow_events", table("seq int, kind string, `left` int, `right` int, text string", lambda d: ((i, e.kind, e.left, e.right, e.text) for i, e in enumerate(flow.events(d)))))
    spark.udf.register("nfkc", nfkc)
