"""Exact top-k inner products by pivot-table elimination.

A table of the distances of every vector to many pivots is made once. From its rows, and without the vectors, the distances of two vectors to all pivots
bound how near the two can be: each single pivot p by |d(q, p) - d(x, p)|, all of them together by the positions of both over the
simplex of the pivots, which is the largest lower bound that the table allows and never below that of any one pivot. As
q * x = (|q|^2 + |x|^2 - |q - x|^2) / 2, a lower bound of the distance bounds the score from above. Candidates are evaluated in the order of their bounds, until
no bound reaches the k-th best score: the result is exact.

Queries and candidates meet in blocks of bounded size, dealt by hashes; each pair of blocks is one group. A first block of candidates gives every query a score
that its k best reach at least, so that no other block begins from nothing. The best k of each block are merged with a ranking window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salvora.session import cut

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Pivots of the table. Vectors of no more dimensions are bounded exactly; the table has one number for each pivot and row.
PIVOTS = 56
#: Rows of a block; candidates that give each query its first threshold.
QUERY_BLOCK, CANDIDATE_BLOCK, FIRST_BLOCK = 1024, 8192, 2048
#: Candidates that are evaluated for one query before bounds are compared again, and queries whose bounds are held at once.
STEP, QUERY_SLICE = 64, 64
#: Scores are computed in floats where every sum is below this, else in Python's integers; they stay within the range of a long.
EXACT, LEAST_LONG, MOST_LONG = 2.0**53, -(2**63), 2**63 - 1


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double, which holds it exactly; null if the vector or a component is null or not finite, also once scaled, or the vector is empty."""
    wide = F.transform(vector, lambda x: x.cast("double") * scale)
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor() of a double is a long and ends at its range; from 2^52 on a double has no fraction
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, whole)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as exact integers, at most the ends of a long."""
    if len(x) and np.abs(x).max() * np.abs(q).max() * x.shape[1] < EXACT:
        return (x @ q).astype(np.int64)
    exact = (sum(int(a) * int(b) for a, b in zip(row, q)) for row in x)
    return np.array([min(max(s, LEAST_LONG), MOST_LONG) for s in exact], dtype=np.int64)


class Pivots:
    """Pivots of one dimension and the simplex that they span."""

    def __init__(self, points: list[np.ndarray], least: float = 1e-3):
        self.points = np.stack(points)
        base, self.used, rows = self.points[0], [], []
        axes = np.empty((0, len(base)))
        edges = self.points[1:] - base
        size = max(float(np.abs(edges).max()), float(np.abs(self.points).max()) / 100) if len(edges) else 0.0
        for i, edge in enumerate(edges):
            rest = edge - axes.T @ (axes @ edge)
            rest -= axes.T @ (axes @ rest)
            norm = float(np.linalg.norm(rest))
            if size and np.isfinite(norm) and norm > least * size:  # one that the others nearly span would only add rounding
                axes = np.vstack([axes, rest / norm])
                self.used.append(i + 1)
                rows.append(edge)
        chosen = np.array(rows).reshape(-1, len(base))
        self.squares = (chosen**2).sum(1)
        self.inverse = np.linalg.inv(axes @ chosen.T) if len(rows) else np.empty((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The table's rows: distances of each vector to each pivot."""
        return np.sqrt(np.maximum(((x**2).sum(1)[:, None] + (self.points**2).sum(1)[None]) - 2 * (x @ self.points.T), 0)) if x.size else np.empty((len(x), len(self.points)))

    def places(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of the table: coordinates in the space of the pivots from the first one, and the distance to that space."""
        squared = table**2
        inner = (squared[:, :1] - squared[:, self.used] + self.squares) / 2
        at = inner @ self.inverse
        return at, np.sqrt(np.maximum(squared[:, 0] - (at**2).sum(1), 0))


def search_block(queries: list[tuple[int, np.ndarray, float]], table_q: np.ndarray, ids: np.ndarray, x: np.ndarray, table_x: np.ndarray, pivots: Pivots, k: int = K, step: int = STEP) -> tuple[list[tuple[int, int, int]], int]:
    """[(query_id, vec_id, score)], what one block adds to the best k of each query (query_id, vector, least score of interest), and how many scores were evaluated."""
    out, evaluated = [], 0
    squares = (x**2).sum(1)
    at_x, high_x = pivots.places(table_x)
    for first in range(0, len(queries), QUERY_SLICE):
        part = queries[first : first + QUERY_SLICE]
        at_q, high_q = pivots.places(table_q[first : first + QUERY_SLICE])
        own = np.array([float((q**2).sum()) for _, q, _ in part])
        gaps = (at_q**2).sum(1)[:, None] + (at_x**2).sum(1)[None] - 2 * (at_q @ at_x.T) + (high_q[:, None] - high_x[None]) ** 2
        both = own[:, None] + squares[None]
        bounds = (both - gaps) / 2 + 1 + 1e-7 * both  # what floats may have rounded
        for (query_id, q, least), bound in zip(part, bounds):
            bound[~np.isfinite(bound)] = np.inf
            bound[ids == query_id] = -np.inf
            live = np.flatnonzero(bound >= least) if least > -np.inf else np.flatnonzero(bound > -np.inf)
            order = live[np.argsort(-bound[live], kind="stable")]
            best_s, best_i, done = np.empty(0, np.int64), np.empty(0, np.int64), 0
            while done < len(order) and not (len(best_s) == k and bound[order[done]] < best_s[-1]):
                some = order[done : done + step]
                done += len(some)
                best_s, best_i = np.concatenate([best_s, _scores(x[some], q)]), np.concatenate([best_i, ids[some]])
                top = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[top], best_i[top]
            evaluated += done
            out += [(query_id, int(i), int(s)) for i, s in zip(best_i, best_s)]
    return out, evaluated


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products over vectors (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by query_every; a query's candidates are all rows of the same length with another vec_id. Ties go
    to the smaller vec_id. Null, empty and non-finite vectors and null ids take no part; neither do vectors that scaling makes infinite. Rows equal in id and vector count once; of
    rows that share an id with different vectors each is a candidate, and as queries they answer together (the best k of all). Sums are exact at any size of the components;
    scores beyond a long are the nearest long, and rank as it. An empty table gives no rows, other columns are ignored.
    """
    return _searched(vectors, k, query_every, scale, pivots, query_block, candidate_block)[0]


def evaluated_share(vectors: DataFrame, **how) -> float:
    """Share of all scores of queries with candidates that top_k evaluates after its first block: what elimination leaves."""
    given = dict(k=K, query_every=QUERY_EVERY, scale=SCALE, pivots=PIVOTS, query_block=QUERY_BLOCK, candidate_block=CANDIDATE_BLOCK) | how
    _, parts, n, n_queries = _searched(vectors, *given.values())
    seen = cut(parts).filter("query_id is null").agg(F.coalesce(F.sum("score"), F.lit(0))).first()[0]
    return seen / max(1, n_queries * (n - 1))


def _searched(vectors: DataFrame, k: int, query_every: int, scale: int, pivots: int, query_block: int, candidate_block: int) -> tuple[DataFrame, DataFrame, int, int]:
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")).filter("vec_id is not null and v is not null")
    rows = rows.dropDuplicates(["vec_id", "v"])
    # pivots and first candidates: the vectors with the least hashes, fixed numbers of rows; equal vectors make one pivot
    hashed = cut(rows.withColumn("h", F.xxhash64("v")))
    sample = hashed.orderBy("h", "vec_id").limit(FIRST_BLOCK).collect()
    points: dict[int, list[np.ndarray]] = {}
    for r in sample:
        own, v = points.setdefault(len(r.v), []), np.array(r.v, dtype=np.float64)
        if len(own) <= pivots and not any(np.array_equal(v, p) for p in own):
            own.append(v)
    tables = {size: Pivots(own) for size, own in points.items()}
    early = {size: ([r.vec_id for r in sample if len(r.v) == size], np.array([r.v for r in sample if len(r.v) == size], dtype=np.float64)) for size in points}
    zero = lambda size: tables.get(size) or Pivots([np.zeros(size)])

    def first(v: np.ndarray, vec_id: int) -> float | None:
        """A score that the k best of a query reach at least; None if its first candidates are fewer."""
        if len(v) not in early:
            return None
        ids, x = early[len(v)]
        scores = np.sort(_scores(x, v)[np.array(ids) != vec_id])
        return float(scores[-k]) if len(scores) >= k else None

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = batch.column(0).to_pylist(), [np.array(v, dtype=np.float64) for v in batch.column(1).to_pylist()]
            far: list = [None] * len(vs)
            for size in {len(v) for v in vs}:
                own = [i for i, v in enumerate(vs) if len(v) == size]
                for i, d in zip(own, zero(size).distances(np.stack([vs[i] for i in own])).tolist()):
                    far[i] = d
            least = [first(v, i) if i % query_every == 0 else None for i, v in zip(ids, vs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.list_(pa.float64())), pa.array(least, pa.float64())], names=["vec_id", "v", "far", "least"])

    rows = cut(hashed.select("vec_id", "v").mapInArrow(table, "vec_id bigint, v array<double>, far array<double>, least double"))
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % query_every == 0)).first()
    columns, lanes = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(n_queries / query_block))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = rows.drop("least").withColumn("block", deal(columns, 1)).withColumn("lane", every(lanes))
    queries = rows.filter(F.col("vec_id") % query_every == 0).withColumn("lane", deal(lanes, 2)).withColumn("block", every(columns))

    def run(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out, seen = [], 0
        for size, group in x.groupby(x["v"].map(len)):
            same = q[q["v"].map(len) == size]
            if len(same):
                asked = [(int(i), np.asarray(v, dtype=np.float64), -np.inf if pd.isna(s) else float(s)) for i, v, s in zip(same["vec_id"], same["v"], same["least"])]
                got, evaluated = search_block(asked, _matrix(same["far"]), group["vec_id"].to_numpy(np.int64), _matrix(group["v"]), _matrix(group["far"]), zero(size), k)
                out, seen = out + got, seen + evaluated
        rows = pd.DataFrame([*out, (None, None, seen)], columns=["query_id", "vec_id", "score"])
        return rows.assign(query_id=rows["query_id"].astype("Int64"), vec_id=rows["vec_id"].astype("Int64"), score=pd.Series([*(s for *_, s in out), seen], dtype="int64"))

    parts = queries.groupBy("lane", "block").cogroup(candidates.groupBy("lane", "block")).applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = parts.filter("query_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return best, parts, n, n_queries


def op4_topk(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of the 5 highest scores of each query."""
    return top_k(vectors)


OP4_SQL = f"""
WITH x AS (
  SELECT DISTINCT vec_id, [CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, x.v)]) AS BIGINT) AS score
  FROM x q JOIN x ON q.vec_id % {QUERY_EVERY} = 0 AND x.vec_id <> q.vec_id AND len(x.v) = len(q.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
