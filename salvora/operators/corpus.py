"""Corpus analytics: normal forms, character coverage, summaries, digests, pairing and skeletons. All but NFKC and coverage, in Arrow batches, stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Unicode white space, as the engine understands it everywhere; Spark's trim knows only the ASCII space.
SPACE = r"[\p{Z}\x09-\x0d\x1c-\x1f]"
#: Characters that do not count in comparisons: white space, controls, rules and boxes.
IGNORED = "".join(map(chr, (*range(0x00, 0x21), *range(0x7F, 0xA1), 0x200B, *range(0x2500, 0x25A0), 0x3000)))
# Marks that a word processor's export adds, each with a text that every match has in it.
EXPORT_MARKS = (("&#", "&#[0-9]+;"), ("\\", r"\\+[-–—][0-9]+\\+[-–—]"), ("**", r"\*\*"))
# The characters that salvaged text may have, as a class, but for the white space among them.
PLAUSIBLE = r"!-~\x{3001}-\x{30FF}\x{31F0}-\x{31FF}\x{3200}-\x{33FF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}→←↑↓…◎○●◆☆★※"
PASS_AT = 0.95


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"^{SPACE}*$"))


def trim_tail(text: Column) -> Column:
    """Without a tail of white space and end marks, if there is an end mark in it."""
    mark = r"\x{0400}\x{0490}\x{FE14}"
    return F.regexp_replace(text, f"{SPACE}*[{mark}]({SPACE}|[{mark}])*\\z", "")


def without_marks(text: Column) -> Column:
    """A text without the marks of an export; only texts that may have one are searched."""
    for hint, mark in EXPORT_MARKS:
        text = F.when(F.contains(text, F.lit(hint)), F.regexp_replace(text, mark, "")).otherwise(text)
    return text


def strip_for_comparison(text: Column, export: bool = False) -> Column:
    """A text without the characters that comparisons ignore; export: also without the marks of an export. Stays in the JVM; full-width forms are kept."""
    return F.translate(without_marks(text) if export else text, IGNORED, "")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC, which SQL has no function for."""
    return texts.str.normalize("NFKC")


def normal_form(text: Column, export: bool = False) -> Column:
    """The form in which texts are compared: marks of an export gone, then NFKC, then ignored characters gone."""
    return strip_for_comparison(nfkc(without_marks(text) if export else text))


_IGNORED_UNITS = np.array([ord(c) for c in IGNORED])


def _counts(text: str) -> np.ndarray:
    """How often each UTF-16 unit occurs in the comparable form of a text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    counts = np.bincount(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2"))
    counts[_IGNORED_UNITS[_IGNORED_UNITS < len(counts)]] = 0
    return counts


@F.pandas_udf(DoubleType())
def coverage_of(truth: pd.Series, made: pd.Series) -> pd.Series:
    """Share of the characters of truth that made has too, as multisets and after NFKC; 1.0 for an empty truth. Linear in the texts."""

    def share(a: str, b: str) -> float:
        x, y = _counts(a), _counts(b)
        total, n = int(x.sum()), min(len(x), len(y))
        return int(np.minimum(x[:n], y[:n]).sum()) / total if total else 1.0

    return pd.Series([share(a, b) for a, b in zip(truth, made)], dtype="float64")


def coverage(pairs: DataFrame, key: str, truth: str, made: str, keep: tuple = ()) -> DataFrame:
    """(key, *keep, coverage) for every pair; the truth loses the marks of an export. Null texts count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return pairs.select(key, *keep, coverage_of(without_marks(text(truth)), text(made)).alias("coverage"))


def joined_exports(exports: DataFrame, key: str, order: str, text: str, out: str = "text") -> DataFrame:
    """(key, text): the texts of a document's exports, in order, one after the other on lines of their own."""
    gathered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return exports.groupBy(key).agg(F.array_join(F.transform(gathered, lambda e: e["t"]), "\n").alias(out))


def summary(scored: DataFrame, total: str = "(all)", pass_at: float = PASS_AT) -> DataFrame:
    """(category, files, passed, pass_rate, mean_coverage) by category and over all rows; scored: (category, coverage)."""
    passed = F.count_if(F.col("coverage") >= pass_at)
    grouped = scored.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("files"), passed.alias("passed"), F.round(passed / F.count("*"), 9).alias("pass_rate"), F.round(F.avg("coverage"), 9).alias("mean_coverage"))
    return grouped.withColumn("category", F.when(F.col("g") == 1, total).otherwise(F.col("category"))).drop("g")


def plausible_line(line: Column) -> Column:
    """At least 80 % of the characters other than white space are plausible, and there is one. Each length is taken once."""
    good = F.length(F.regexp_replace(line, f"[^{PLAUSIBLE}]+", ""))
    bare = F.length(F.regexp_replace(line, f"{SPACE}+", ""))
    return good * 100 >= F.greatest(bare * 80, F.lit(1))


def salvaged_lines(text: Column) -> Column:
    """The plausible lines of a text, each once, in the order of first sight; null if there is none."""
    lines = F.array_distinct(F.filter(F.split(text, r"\r\n|\r|\n"), plausible_line))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def count_visible(text: Column) -> Column:
    """Characters that body text shows: CJK, full-width and ASCII."""
    return F.length(F.regexp_replace(text, r"[^\x{3000}-\x{9FFF}\x{FF01}-\x{FF5E}\x20-\x7E]+", "")).cast("bigint")


def count_controls(text: Column) -> Column:
    """Controls that end a run of text: all but tabs and line ends."""
    return F.length(F.regexp_replace(text, r"[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]+", "")).cast("bigint")


def category_folder(name: str, corpus: str, root: str, exists: Callable[[str], bool]) -> str | None:
    """The first folder that exists of a category's path: as it is, below the corpus, below the root, below the root's parent."""
    import posixpath

    tried = [name] if name.startswith("/") else [posixpath.normpath(posixpath.join(base, name)) for base in (corpus, root, posixpath.dirname(root.rstrip("/")))]
    return next((t for t in tried if exists(t)), None)


def manifest(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.sha2(F.col(text), 256).alias("sha256"), F.octet_length(text).cast("bigint").alias("bytes"))


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) of rows that were added, removed or changed."""
    a, b = old.select(F.col(key).alias("k1"), F.col(digest).alias("d1")), new.select(F.col(key).alias("k2"), F.col(digest).alias("d2"))
    joined = a.join(b, F.col("k1") == F.col("k2"), "full").filter(~F.col("d1").eqNullSafe(F.col("d2")))
    change = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "removed").otherwise("changed")
    return joined.select(F.coalesce("k1", "k2").alias(key), change.alias("change"))


def roundtrip_groups(files: DataFrame, payload: Column, container: Column, least: int = 2) -> DataFrame:
    """Payloads that at least so many distinct containers hold."""
    grouped = files.groupBy(payload.alias("payload")).agg(F.count_distinct(container).alias("containers"), F.count("*").alias("files"))
    return grouped.filter(F.col("containers") >= least)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC, by which file names are compared."""
    return texts.str.normalize("NFC")


def pair_by_name(docs: DataFrame, exports: DataFrame, folder: str = "folder", base: str = "base") -> DataFrame:
    """(folder, base, export) where the names, in NFC, are equal or the export's begins with the document's and an underscore.

    The beginnings of an export's name before its underscores are few, so both cases are one equi-join. Names come out as they went in.
    """
    name = F.col("name")
    heads = F.transform(F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)) == "_"), lambda i: F.substring(name, F.lit(1), i - 1))
    right = exports.select(F.col(folder).alias("f2"), F.col(base).alias("export"), nfc(F.col(base)).alias("name")).withColumn("head", F.explode(F.array_distinct(F.concat(F.array("name"), heads)))).drop("name")
    left = docs.select(folder, base, nfc(F.col(base)).alias("own"))
    return left.join(right, (F.col(folder) == F.col("f2")) & (F.col("own") == F.col("head"))).select(folder, base, "export").distinct()


def discover_categories(files: DataFrame, category: Column, is_document: Column, is_export: Column) -> DataFrame:
    """Categories that hold both documents and exports."""
    found = files.groupBy(category.alias("category")).agg(F.bool_or(is_document).alias("d"), F.bool_or(is_export).alias("e"))
    return found.filter("d and e").select("category")


def configured_categories(lines: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(category, folder) from lines of a tab-separated file; comments, blanks and short lines are skipped, and with folders (folder) those whose folder is not there."""
    parts = F.split("value", "\t")
    rows = lines.filter(~F.startswith(F.ltrim("value"), F.lit("#")) & ~is_blank(F.col("value"))).filter(F.size(parts) >= 2)
    named = rows.select(trim(parts[0]).alias("category"), trim(parts[1]).alias("folder"))
    return named if folders is None else named.join(folders.select("folder").distinct(), "folder", "left_semi").select("category", "folder")


def category_folders(categories: DataFrame, folders: DataFrame, corpus: str, root: str) -> DataFrame:
    """(category, folder): of each category's path the first that is among folders (folder): as it is, below the corpus, below the root, below the root's parent."""
    parent = root.rstrip("/").rpartition("/")[0]
    below = [F.concat(F.lit(base.rstrip("/") + "/"), "folder") for base in (corpus, root, parent)]
    tried = F.when(F.startswith("folder", F.lit("/")), F.array("folder")).otherwise(F.array(*below))
    each = categories.select("category", F.posexplode(tried).alias("rank", "folder"))
    found = each.join(folders.select("folder").distinct(), "folder", "left_semi")
    return found.groupBy("category").agg(F.min_by("folder", "rank").alias("folder"))


def combined_text(sheets: DataFrame, key: str, order: str, name: Column, text: Column, out: str = "text") -> DataFrame:
    """The sheets of each document under their names, in order, with an empty line between."""
    part = F.concat(name, F.lit("\n"), text)
    gathered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t"))))
    return sheets.groupBy(key).agg(F.array_join(F.transform(gathered, lambda s: s["t"]), "\n\n").alias(out))


def nested(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """(key, out, n): the values of each key in order, as an array, and how many they are."""
    gathered = F.sort_array(F.collect_list(F.struct(order, value)))
    return rows.groupBy(key).agg(F.transform(gathered, lambda r: r[value]).alias(out), F.count("*").alias("n"))


def first_magic(text: Column, marks: tuple, window: int = 512) -> Column:
    """The first label of marks (label, bytes) found in a window, by priority; EMPTY, METAFILE at the start, else UNKNOWN."""
    head = F.substring(text, 1, window)
    out = F.when(F.octet_length(text) == 0, "EMPTY").when(F.startswith(text, F.lit(b"METAFILE")), "METAFILE")
    for label, mark in marks:
        out = out.when(F.position(F.lit(mark), head) > 0, label)
    return out.otherwise("UNKNOWN")


def skeleton(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Counts of the elements and attributes by which two renderings are compared."""
    counts = {"p": "<p[ >]", "tables": "<table[ >]", "cells": "<t[dh][ >]", "br": "<br ?/?>", "colspans": "colspan=", "rowspans": "rowspan="}
    return pages.select(key, *(F.coalesce(F.regexp_count(html, F.lit(p)), F.lit(0)).cast("bigint").alias(n) for n, p in counts.items()))


def same_skeleton(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, class_id): pages whose counts of all tags are equal share the least key among them."""
    tags = F.array_sort(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("<([a-z0-9]+)"), F.lit(1)))
    rows = pages.select(key, F.xxhash64(F.array_join(tags, ",")).alias("h1"), F.md5(F.array_join(tags, ",")).alias("h2"))
    return rows.join(rows.groupBy("h1", "h2").agg(F.min(key).alias("class_id")), ["h1", "h2"]).select(key, "class_id")


def pipe_table(rows: DataFrame, key: str, order: str, cells: list[Column], out: str = "markdown") -> DataFrame:
    """Rows of each table as lines of a pipe table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    gathered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(gathered, lambda r: r["l"]), "\n").alias(out))


def report(summaries: DataFrame) -> DataFrame:
    """The summary as lines of Markdown, (ord, line): a head, then a line for each category."""
    line = F.format_string("| %s | %d | %.1f%% | %.3f |", "category", "files", F.col("pass_rate") * 100, "mean_coverage")
    head = summaries.sparkSession.createDataFrame([(0, "", "| category | files | pass rate | mean coverage |"), (1, "", "| --- | ---: | ---: | ---: |")], "ord int, category string, line string")
    return head.unionByName(summaries.select(F.lit(2).alias("ord"), "category", line.alias("line"))).orderBy("ord", "category").select("ord", "line")
