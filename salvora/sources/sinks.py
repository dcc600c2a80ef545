"""Sinks: golden texts with a manifest, styled XHTML, and reports. All are written by executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLE = "table{border-collapse:collapse}td{border:1px solid #888;padding:2px 6px;vertical-align:top}"


def golden(docs: DataFrame) -> DataFrame:
    """(relpath, cmd, exit, sha256, bytes) of documents (doc_id, status, text), in the order of paths."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").alias("relpath"), F.lit("text").alias("cmd"), F.when(F.col("status") == "ok", 0).otherwise(1).alias("exit"), F.sha2(data, 256).alias("sha256"), F.octet_length(data).alias("bytes"))
    return rows.orderBy("relpath", "cmd")


def write_golden(docs: DataFrame, folder: str) -> None:
    """Texts and manifest.tsv below a folder."""
    golden(docs).drop("bytes").write.mode("overwrite").option("sep", "\t").csv(f"{folder}/manifest.tsv")
    docs.select("doc_id", "text").write.mode("overwrite").parquet(f"{folder}/texts")


def styled(xhtml: Column, css: str = STYLE) -> Column:
    """A page with a style element: in its head, else before its body, else after its html tag, else in front."""
    style = F.concat(F.lit("<style>"), F.lit(css), F.lit("</style>"))
    put = lambda anchor, before: F.concat(F.substring(xhtml, F.lit(1), F.instr(xhtml, anchor) - 1), *((style, F.lit(anchor)) if before else (F.lit(anchor), style)), F.substring(xhtml, F.instr(xhtml, anchor) + len(anchor), F.length(xhtml)))
    has = lambda anchor: F.instr(xhtml, anchor) > 0
    return F.when(has("</head>"), put("</head>", True)).when(has("<body>"), put("<body>", True)).when(has("<html>"), put("<html>", False)).otherwise(F.concat(style, xhtml))


def write_report(lines: DataFrame, folder: str) -> None:
    """Lines (ord, line) as one text file in order; a report has a line for each category."""
    lines.orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(folder)


def write_details(scored: DataFrame, folder: str) -> None:
    """Details of each pair as tab-separated values."""
    scored.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(folder)
