"""Links between members of cells, without comparing all pairs of a cell whose members turn out to be connected.

Every cell first compares its members with a few of them, its hubs: linear in the members. Each member is then judged against the nearest of its hubs, and what that connects
needs no more comparing, nor does what links that are known before connect: only cells that still hold members of several components have the pairs of members of different
components made, in blocks of a bounded number of members. The components of the links are those of all pairs that the cells hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvora.operators.components import connected_components
from salvora.session import cut

#: Hubs of a cell, members of a block, and of a cell from which on more is known of its members before pairs are made.
HUBS, BLOCK, CROWD = 1, 1024, 64


def _open(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with their component, of cells that hold more than one; n tells how many members the cell has."""
    found = connected_components(edges).select(F.col("node").alias("key"), "component")
    known = members.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    several = known.groupBy("cell").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).filter("least <> most").select("cell", "n")
    return known.join(several, "cell")


def links_in_cells(
    members: DataFrame,
    payload: list[str],
    near: Callable[[str, str], Column],
    sift: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    detail: tuple[DataFrame, Callable[[str, str], Column]] | None = None,
    hubs: int = HUBS,
    block: int = BLOCK,
    crowd: int = CROWD,
    known: DataFrame | None = None,
) -> DataFrame:
    """Edges (src, dst): every pair of a cell that near, sift and judge let pass is one, or its ends are connected by others.

    members: (cell, key, *payload), a key once in a cell. near(a, b) is a condition on the payload of two members, named by prefixes. sift takes pairs (src, dst), each once,
    and returns those that may be links, with a number `far` that is less for likelier ones; judge returns those of them that are. detail is a table (key, ...) and another condition on its
    columns, as for near, by which pairs of cells of more than `crowd` members are cut before they are made: a large group may be near each other and yet not linked.
    known: edges found elsewhere, which are among those returned; members that they connect are not compared.
    """
    if known is not None:
        members = cut(_open(members, known).select("cell", "key", *payload))
    side = lambda p: [F.col(c).alias(f"{p}{c}") for c in payload]
    orders = ([F.xxhash64("key", F.lit(r)).alias("order")] if r else [] for r in range(hubs))
    least = members.groupBy("cell").agg(*(F.min(F.struct(*order, "key", *payload)).alias(f"hub{r}") for r, order in enumerate(orders)))
    each = F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"hub{r}.{c}").alias(c) for c in ("key", *payload))) for r in range(hubs)))))
    chosen = least.select("cell", each.alias("hub")).select("cell", F.col("hub.key").alias("src"), *(F.col(f"hub.{c}").alias(f"b_{c}") for c in payload))
    met = members.select("cell", F.col("key").alias("dst"), *side("a_")).join(chosen, "cell").filter((F.col("src") != F.col("dst")) & near("a_", "b_"))
    nearest = sift(met.select("src", "dst").distinct()).groupBy("dst").agg(F.min_by("src", F.struct("far", "src")).alias("src"))
    nearest = nearest.select("src", "dst")
    if known is None:
        edges = cut(judge(nearest))
    else:
        found = connected_components(known)
        end = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}"))
        told = nearest.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
        apart = told.filter(F.coalesce("of_src", "src") != F.coalesce("of_dst", "dst")).select("src", "dst")
        edges = cut(judge(apart).unionByName(known.select("src", "dst")))
    dealt = cut(_open(members, edges).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    def pairs(some: DataFrame, columns: list[str], close: Column) -> DataFrame:
        side = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("component", *columns)]
        a = some.select("cell", F.col("key").alias("src"), *side("a_"), F.col("part").alias("one"), every.alias("two"))
        b = some.select("cell", F.col("key").alias("dst"), *side("b_"), every.alias("one"), F.col("part").alias("two"))
        # a pair of blocks meets twice, once with its keys in order
        apart = (F.col("src") < F.col("dst")) & (F.col("a_component") != F.col("b_component"))
        return a.join(b, ["cell", "one", "two"]).filter(apart & close).select("src", "dst")

    rest = pairs(dealt.filter(F.col("n") <= crowd), payload, near("a_", "b_"))
    large, extra, close = dealt.filter(F.col("n") > crowd), [], near("a_", "b_")
    if detail is not None:
        table, closer = detail
        large, extra, close = large.join(table, "key"), [c for c in table.columns if c != "key"], close & closer("a_", "b_")
    rest = rest.unionByName(pairs(large, [*payload, *extra], close)).distinct()
    return edges.unionByName(cut(judge(sift(rest).select("src", "dst"))))
