"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source asks for its weight's share of all words. A source that would have to repeat its words more than max_epochs
times stops there, and what it leaves goes to the others by weight, until none is above: that is one water level L with
target = least(cap, L * weight), found by a running sum over the sources in order of cap / weight.

Each document is taken as often as the whole part of target / source size; the rest of the words come from the source's
documents in a seeded order, the last of them in part, so that a source's words meet its target to the word. That order is
cut into 65,536 ranges of the seeded digest: whole ranges are settled by their sums alone, and only the one range in
which the words run out is put in order, so a hot source never meets in one task;
the range is found in two steps of 256 sums, and rows meet their source's plan by source and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salvora.session import cut

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text as bigint; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: one row for each source, (source, source_size). Adds weight and target.

    Weights repeat over the sources in code point order, null last. This table has a row for each source and nothing else, and is
    put in order as a whole. Sources without words get the target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    caps = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(full) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    tried = caps.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level of the first source that stays below its cap; null if none does
    final = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tried.withColumn("final", final).select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, weight, target, taken) for every row of docs (doc_id, text, source).

    size: words of the text, 0 for null and empty ones, which are never taken. taken: the words the mix takes of the row, repeats
    counted, at most max_epochs times its size; the sum over a source is its target, rounded. Null and empty sources are sources of their own. Rows are ordered
    by a digest of seed, doc_id and text, so repeated rows are each judged, and reruns agree. An empty table gives no rows.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    rows = cut(docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"), digest.alias("at")).withColumn("range", F.substring("at", 1, 4)).withColumn("salt", F.substring("at", 1, 2)))
    sums = cut(rows.groupBy("source", "salt", "range").agg(F.sum("size").alias("words")))
    salts = sums.groupBy("source", "salt").agg(F.sum("words").alias("words"))
    plan = targets(salts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).cast("bigint")
    plan = cut(plan.withColumn("whole", whole).withColumn("rest", F.round("target").cast("bigint") - F.col("whole") * F.col("source_size")))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))

    def edge_of(parts: DataFrame, by: str) -> DataFrame:
        """The part of each source in which its rest runs out: (source, <by>, before); parts: at most 256 for a source."""
        running = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        offset = parts.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        return offset.filter("before <= rest and rest < before + words").select("source", by, "before")

    by_salt = salts.alias("o").join(plan.alias("p"), same("o", "p")).select("o.*", "p.rest", F.lit(0).cast("bigint").alias("base"))
    salt_edge = edge_of(by_salt, "salt")
    by_range = sums.alias("o").join(salt_edge.alias("e"), same("o", "e") & (F.col("o.salt") == F.col("e.salt"))).join(plan.alias("p"), same("o", "p")).select("o.source", "o.range", "o.words", "p.rest", F.col("e.before").alias("base"))
    edge = edge_of(by_range, "range")
    plan = plan.alias("p").join(edge.alias("e"), same("p", "e"), "left").select("p.*", F.coalesce("range", F.lit("g")).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"))
    # a source's rows are spread over all salts, and its one row of the plan is repeated for each
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))))
    plan = plan.withColumn("salt", every)
    parts = rows.alias("r").join(plan.alias("p"), (F.col("r.salt") == F.col("p.salt")) & same("r", "p")).select("r.*", "p.source_size", "p.weight", "p.target", "p.whole", "p.rest", "p.edge", "p.before")
    settled = parts.filter("range <> edge").withColumn("extra", F.when(F.col("range") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source", "range").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    run_out = parts.filter("range = edge").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    taken = settled.unionByName(run_out)
    return taken.select("doc_id", "source", "size", "source_size", "weight", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"))


def op8_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the row's source for all documents."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mark
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap)), cap) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (
  SELECT d.*, p.source_size, p.target, p.whole, CAST(round(p.target) AS BIGINT) - p.whole * p.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken, source FROM o
"""
