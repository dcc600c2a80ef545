"""Order-dependent operators as windows over one document: labels, numbering, caps and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_labels(elements: DataFrame, doc: str, order: str, is_label: Column, is_run: Column) -> DataFrame:
    """(doc, order, label_<order>, labelled) of runs after a label: the last label before each, and whether it came just before."""
    w = Window.partitionBy(doc).orderBy(order)
    label = F.last(F.when(is_label, F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = elements.select(doc, order, label.alias(f"label_{order}"), F.lag(is_label).over(w).alias("labelled"), is_run.alias("__run"))
    return marked.filter(F.col("__run") & F.col(f"label_{order}").isNotNull()).drop("__run")


def numbered(paragraphs: DataFrame, doc: str, order: list[str], is_chapter: Column, is_section: Column, key: str) -> DataFrame:
    """(key, chapter, section, prefix): running chapter numbers, and section numbers that begin anew under each chapter."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chaptered = paragraphs.withColumn("__section", is_section).withColumn("__chapter", is_chapter).withColumn("chapter", F.sum(is_chapter.cast("int")).over(w).cast("bigint"))
    v = Window.partitionBy(doc, "chapter").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sections = chaptered.withColumn("section", F.sum(F.col("__section").cast("int")).over(v).cast("bigint"))
    prefix = F.when(F.col("__chapter"), F.concat(F.lit("第"), "chapter", F.lit("章 "))).when(F.col("__section"), F.concat("chapter", F.lit("."), "section", F.lit(" ")))
    return sections.select(key, "chapter", "section", prefix.alias("prefix"))


def rank_cap(objects: DataFrame, doc: list[str], order: list[Column], cap: int, out: str = "idx") -> DataFrame:
    """objects with a running number from 1 by document, up to cap."""
    w = Window.partitionBy(*doc).orderBy(*order)
    return objects.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= cap)


def budget(members: DataFrame, doc: list[str], order: list[str], size: Column, limit: float) -> DataFrame:
    """members with the running total of a document and whether it is still within the limit."""
    w = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumn("total", F.sum(size).over(w)).withColumn("granted", F.col("total") <= limit)


CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


def circled(n: Column) -> Column:
    """① to ⑳, else the number in parentheses."""
    return F.when(n.between(1, 20), F.substring(F.lit(CIRCLED), n, F.lit(1))).otherwise(F.concat(F.lit("("), n, F.lit(")")))


def lettered(n: Column) -> Column:
    """(a) to (z), else the number in parentheses."""
    return F.concat(F.lit("("), F.when(n.between(1, 26), F.chr(n + 96)).otherwise(n.cast("string")), F.lit(")"))
