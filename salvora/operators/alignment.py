"""Alignment of a document's sheets with exports: greedy, each export once, in the order of sheets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from salvora.functions.page_grid import Rule, page_tables, pipe
from salvora.functions.scrape import anchor, tables

SHEET_WORD = "シート"


def match_names(base: str, sheets: list[str], exports: list[str]) -> list[int | None]:
    """For each sheet, in order, the first export not yet taken whose name, in NFC, is the document's and the sheet's with an underscore between, the same with the word for sheet
    behind it, or has the sheet's name anywhere. Exports are tried in their order, whichever of the three they meet."""
    norm = lambda s: unicodedata.normalize("NFC", s or "")
    base, names, free, out = norm(base), [norm(e) for e in exports], list(range(len(exports))), []
    for sheet in map(norm, sheets):
        hit = next((k for k in free if names[k] in (f"{base}_{sheet}", f"{base}_{sheet}{SHEET_WORD}") or sheet in names[k]), None)
        if hit is not None:
            free.remove(hit)
        out.append(hit)
    return out


def align(sheets: DataFrame, exports: DataFrame) -> DataFrame:
    """(doc_id, ord, sheet_idx, sheet, export): a row for each sheet in order, export null without one, then one for each export that no sheet took, in its order, without a sheet.

    sheets: (doc_id, base, sheet_idx, sheet), base the document's name; exports: (doc_id, export_idx, export), names without suffix. One document is one group.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("sheet_idx"), right.sort_values("export_idx")
        doc = (left if len(left) else right)["doc_id"].iloc[0]
        names = right["export"].tolist()
        hits = match_names(left["base"].iloc[0] if len(left) else "", left["sheet"].tolist(), names)
        rows = [(doc, i, s, None if h is None else names[h]) for i, s, h in zip(left["sheet_idx"], left["sheet"], hits)]
        rows += [(doc, None, None, n) for k, n in enumerate(names) if k not in hits]
        return pd.DataFrame([(d, o, i, s, e) for o, (d, i, s, e) in enumerate(rows)], columns=["doc_id", "ord", "sheet_idx", "sheet", "export"]).astype({"sheet_idx": "Int32"})

    return sheets.groupBy("doc_id").cogroup(exports.groupBy("doc_id")).applyInPandas(run, "doc_id string, ord int, sheet_idx int, sheet string, export string")


def status(aligned: DataFrame) -> DataFrame:
    """(doc_id, status, matched, total): full if every sheet has an export, partial if one has, else none."""
    total, found = F.count("sheet_idx"), F.count_if(F.col("sheet_idx").isNotNull() & F.col("export").isNotNull())
    word = F.when(found == total, "full").when(found > 0, "partial").otherwise("none")
    return aligned.groupBy("doc_id").agg(word.alias("status"), found.alias("matched"), total.alias("total")).filter("total > 0")


def missing(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sheets without an export, exports without a sheet)."""
    return aligned.filter("export is null").select("doc_id", "sheet_idx", "sheet"), aligned.filter("sheet_idx is null").select("doc_id", "export")


def report(aligned: DataFrame) -> DataFrame:
    """(doc_id, line): for each document that is not fully matched, its status and what has no counterpart, as a line of Markdown."""
    no_export, no_sheet = missing(aligned)
    names = lambda df, c, out: df.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(c)), ", ").alias(out))
    rows = status(aligned).filter("status <> 'full'").join(names(no_export, "sheet", "a"), "doc_id", "left").join(names(no_sheet, "export", "b"), "doc_id", "left")
    return rows.select("doc_id", F.format_string("- %s (%s): without export: %s; without sheet: %s", "doc_id", "status", F.coalesce("a", F.lit("-")), F.coalesce("b", F.lit("-"))).alias("line"))


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_idx, anchor, cells array<struct<text, rowspan, colspan>>) of all table rows of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("rowspan", pa.int32()), ("colspan", pa.int32())]))
        for b in batches:
            out = [(k, i, anchor(row), [dict(zip(("text", "rowspan", "colspan"), c)) for c in row]) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, row in enumerate(r for t in tables(h) for r in t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), kind))], names=["key", "row_idx", "anchor", "cells"])

    return pages.select(F.col(key).cast("string").alias("key"), html).mapInArrow(run, "key string, row_idx int, anchor string, cells array<struct<text:string,rowspan:int,colspan:int>>")


GRID = "pages array<struct<page:int, rules:array<struct<axis:string,at:double,low:double,high:double>>, spans:array<struct<x:double,y:double,text:string>>>>"


def _from_pages(pages: DataFrame, schema: str, rows: Callable[[list, list], Iterable[tuple]]) -> DataFrame:
    """(doc_id, page, *schema) of ruled pages (doc_id, page, rules, spans), as read from JSON with the schema GRID; rows makes them from tables and loose texts."""
    kinds = _parse_datatype_string(f"doc_id string, page int, {schema}")
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                made = page_tables([Rule(**x) for x in r["rules"] or []], [(s["x"], s["y"], s["text"]) for s in r["spans"] or []])
                out += [(r["doc_id"], r["page"], *row) for row in rows(*made)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return pages.select("doc_id", "page", "rules", "spans").mapInArrow(run, kinds)


def page_cells(pages: DataFrame) -> DataFrame:
    """(doc_id, page, table_idx, row, col, rowspan, colspan, text) of the cells of ruled pages."""
    return _from_pages(pages, "table_idx int, row int, col int, rowspan int, colspan int, text string", lambda tables, _: [(t, c.row, c.col, c.rowspan, c.colspan, c.text) for t, table in enumerate(tables) for c in table])


def page_loose(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) of the spans that no cell took."""
    return _from_pages(pages, "text string", lambda _, loose: [(text,) for text in loose])


def page_pipes(pages: DataFrame) -> DataFrame:
    """(doc_id, page, table_idx, pipe): the tables of ruled pages as pipe tables."""
    return _from_pages(pages, "table_idx int, pipe string", lambda tables, _: [(t, pipe(table)) for t, table in enumerate(tables)])
