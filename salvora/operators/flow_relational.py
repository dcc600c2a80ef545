"""The event stream as relations: physical rows and coalesced spans, by windows over one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_segments(events: DataFrame, doc: list[str], order: list[str], advance: Column, out: str = "row_idx") -> DataFrame:
    """events with the number of row advances before each; an advance ends its own row."""
    before = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(out, F.coalesce(F.sum(advance.cast("int")).over(before), F.lit(0)).cast("bigint"))


def coalesce_spans(events: DataFrame, doc: list[str], order: list[str], span: list[str], out: str = "cell") -> DataFrame:
    """events with a running number that grows where the span differs from the one before."""
    w = Window.partitionBy(*doc).orderBy(*order)
    here = F.struct(*span)
    fresh = F.when(F.lag(here).over(w).eqNullSafe(here), 0).otherwise(1)
    return events.withColumn("__fresh", fresh).withColumn(out, F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__fresh")


def declared_spans(w5: Column) -> Column:
    """Number of spans that a row header declares: w5 = 4 (n - 1) + 3, else null."""
    return F.when((w5 >= 3) & ((w5 - 3) % 4 == 0), ((w5 - 3) / 4).cast("int") + 1)
