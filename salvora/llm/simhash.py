"""SimHash near-duplicates: fingerprints, links within a Hamming radius, and their components.

Links are found in a segment-popcount embedding. A fingerprint maps to the bit counts of its 32 two-bit
segments; the Manhattan distance of two such vectors is never above the Hamming distance of the fingerprints.
The vectors are joined on a grid: their axes form radius + 2 groups, and vectors within the radius agree in at
least least two whole groups, so a grid cell is a pair of groups with its coordinates. Candidates of one cell
are cut by the Manhattan bound and then verified on the fingerprints themselves.

A cell of very many fingerprints is not joined with itself, as they may well be near each other and yet not linked. For the radius of two, its members go through an exact star instead: two
fingerprints differ in at most two bits just if both lie within one bit of a common word, so each
member is tied to the least member about each of its 65 words. That is linear in the members and keeps every component. For other radii crowded cells are cut finer: the axes that
a cell leaves open form radius + 2 groups again, of which two agree; members that are connected already are not compared (see cells.py).

Fingerprints of three words and two bits are the contract of op1. keep_one, which takes documents out of a corpus, links sets of five-word
shingles at Jaccard similarity 0.8 or more. Their fingerprints meet on the same grid, and what is within the radius is verified on the sets. No radius of
fingerprints has every pair of that similarity (those of 0.8 are some ten bits apart), so an exact join follows for what this leaves unconnected. Sets so similar share one of their first n - ceil(0.8 n) + 1 shingles in any one order of all
shingles; shingles that are common in a sample come last, so that few sets meet by them. The order never decides what is found. Sets that meet in a
cell are cut by the overlap that their places in it allow and by sketches, both of which only drop pairs that cannot be similar, and verified on the whole sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvora.llm.cells import links_in_cells
from salvora.operators.components import connected_components
from salvora.session import cut, tidy

SHINGLE_WORDS = 3
HASH_SEED = 42
RADIUS = 2
#: Fingerprints in a cell from which on the star, or a finer grid, replaces the self-join.
CELL_LIMIT = 64
#: Words of a shingle, and Jaccard similarity of two sets of them, from which one of two documents is dropped.
COPY_WORDS, SIMILARITY = 5, 0.8
#: About so many documents tell which shingles are common; at most so many of these are kept (16 bytes each).
SAMPLE_DOCS, COMMON_LIMIT = 16_384, 200_000
#: Bits of a set's sketch; slots of text hashes, of which those in use are broadcast.
SKETCH_BITS, TEXT_SLOTS = 1024, 1 << 20
#: Slots of shingles, a bit each, by which those that one set alone has are left out early.
CELL_SLOTS = 1 << 25

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_FIELD = 0x5555555555555555


def shingle_hashes(text: str | None, words: int, seed: int = HASH_SEED) -> np.ndarray:
    """The hashes of all shingles of a whole text in their order; of fewer words than a shingle has, the one of all of them."""
    tokens = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not tokens:
        return np.empty(0, dtype="<u8")
    shingles = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The 64-bit SimHash of a whole text; 0 for null and for texts without words."""
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingles; 0 for none."""
    if not len(hashes):
        return 0
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, b], minlength=256) @ _BITS for b in range(8)])
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) for every row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def embed(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in unary code: the bits in which two codes differ are the Manhattan distance."""
    right = F.shiftrightunsigned(fp, 1)
    field = F.lit(_FIELD)
    return fp.bitwiseOR(right).bitwiseAND(field).bitwiseOR(F.shiftleft(fp.bitwiseAND(right).bitwiseAND(field), 1))


def _split(axes: list[int], parts: int) -> list[int]:
    """Masks of the codes of consecutive two-bit segments, in so many groups of about the same number of them."""
    cuts = [i * len(axes) // parts for i in range(parts + 1)]
    return [sum(3 << 2 * axis for axis in axes[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def grids(radius: int) -> list[tuple[int, list[int]]]:
    """(mask, finer masks) of every grid: codes of at most radius differing bits agree on the mask of at least one grid, and on one of its finer masks."""
    out = []
    groups = _split(list(range(32)), radius + 2)
    for i in range(radius + 2):
        for j in range(i):
            mask = groups[i] | groups[j]
            rest = _split([axis for axis in range(32) if not mask >> 2 * axis & 3], radius + 2)
            out.append((mask, sorted({mask | rest[a] | rest[b] for a in range(radius + 2) for b in range(a)})))
    return out


def _cells(fps: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Of fps (key, e, ...): (grid, cell, ...), the cells of the grids that each is in, and (grid, cell, n) of those with several."""
    named = lambda grid, mask: F.xxhash64(F.lit(grid), F.lit(-1), F.col("e").bitwiseAND(_signed(mask)))
    coarse = fps.select("*", F.posexplode(F.array(*(named(g, mask) for g, (mask, _) in enumerate(grids(radius))))).alias("grid", "cell"))
    return coarse, cut(coarse.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1"))


def links(fps: DataFrame, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (src, dst) between the distinct values of fps.fp; those at most `radius` (0 to 30) bits apart, and only those, are connected by them.

    fps: one row for each distinct fingerprint. Pairs that share only crowded cells may be joined by a path of links instead of an edge of their own. Cells are named by hashes; a clash only adds
    candidates.
    """
    if not 0 <= radius <= 30:
        raise ValueError("a radius is of 0 to 30 bits")
    fps = fps.select(F.col("fp").alias("key"), embed(F.col("fp")).alias("e"))
    named = lambda grid, finer, mask: F.xxhash64(F.lit(grid), F.lit(finer), F.col("e").bitwiseAND(_signed(mask)))
    bits = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    every = grids(radius)
    coarse, shared = _cells(fps, radius)
    thin = coarse.join(shared.filter(F.col("n") <= cell_limit).select("grid", "cell"), ["grid", "cell"])
    a, b = thin.alias("a"), thin.alias("b")
    near = (
        a.join(b, (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.key") < F.col("b.key")))
        .filter((bits("a.e", "b.e") <= radius) & (bits("a.key", "b.key") <= radius))
        .select(F.col("a.key").alias("src"), F.col("b.key").alias("dst"))
    )
    crowded = coarse.join(shared.filter(F.col("n") > cell_limit).select("grid", "cell"), ["grid", "cell"], "left_semi")
    if radius == 2:
        return near.unionByName(star(crowded.select(F.col("key").alias("fp")).distinct())).distinct()
    finer = F.lit(None)
    for g, (_, masks) in enumerate(every):
        finer = F.when(F.col("grid") == g, F.array(*(named(g, f, m) for f, m in enumerate(masks)))).otherwise(finer)
    members = cut(crowded.select(F.explode(finer).alias("cell"), "key", "e"))
    rest = links_in_cells(members, ["e"], lambda a, b: bits(f"{a}e", f"{b}e") <= radius, lambda pairs: pairs.withColumn("far", bits("src", "dst")), lambda pairs: pairs.filter(bits("src", "dst") <= radius))
    return near.unionByName(rest).distinct()


def star(fps: DataFrame) -> DataFrame:
    """Edges that connect just those fingerprints that paths of steps of at most two bits connect, linear in the rows."""
    masks = F.array(F.lit(0).cast("bigint"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint") for i in range(64)))
    about = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
    least = about.groupBy("word").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1").select("word", "m")
    return about.join(least, "word").filter("fp <> m").select(F.col("m").alias("src"), F.col("fp").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id among the rows reachable over links, the row itself included. Null and empty texts have
    fingerprint zero and link like others. Rows with a null doc_id take part and never name a component; one made only of
    them has a null component_id. Repeated rows and doc_ids each give a row; other columns are ignored; an empty table gives no rows.
    """
    fps = cut(fingerprints(docs, doc_id, text))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = connected_components(links(distinct.select("fp"), radius, cell_limit))
    named = distinct.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of documents."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _set_key(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), HASH_SEED)], dtype="<u8").view("<i8")[0])


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    """array<bigint> of arrays of 64-bit numbers."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype="<u8"), *arrays]).view("<i8")))


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, in order, and in how many; the sample goes by the hash of a text."""
    step = max(1, round(texts.count() / SAMPLE_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_longs([np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(0)])], names=["h"])

    with tidy(texts.sparkSession):
        sample = texts.filter(F.pmod("t", F.lit(step)) == 0).dropDuplicates(["t"]).select("text").mapInArrow(run, "h array<bigint>")
        seen = sample.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON_LIMIT).toPandas()
    h, n = seen["h"].to_numpy(dtype="<i8").view("<u8"), seen["n"].to_numpy(dtype="<i8")
    order = np.argsort(h)
    return h[order], n[order]


def _sketch(hashes: np.ndarray) -> bytes:
    """Parities of the shingles in SKETCH_BITS places: two sketches differ in no more bits than their sets in shingles."""
    return np.packbits(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def _shared(marks: DataFrame) -> DataFrame:
    """(cell, key, size, i) of the shingles in the prefixes of several sets; marks: (key, size, prefix), where a key may recur."""
    ends = marks.select("key", F.explode("prefix").alias("cell")).groupBy("cell").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    several = cut(ends.filter("lo <> hi").select("cell"))
    # most shingles are of one set only: a bit for each slot of those of several, of a fixed number, spares them the shuffle. The bits come packed, a few kilobytes a row
    page = CELL_SLOTS // 512

    def packed(table: pa.Table) -> pa.Table:
        slots = table["slot"].to_numpy()
        bits = np.zeros(page, dtype=np.uint8)
        bits[slots % page] = 1
        return pa.table({"page": pa.array([int(slots[0]) // page], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slot = F.pmod("cell", F.lit(CELL_SLOTS))
    with tidy(marks.sparkSession):
        pages = several.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / page)).applyInArrow(packed, "page bigint, bits binary").collect()
    held = np.zeros(CELL_SLOTS // 8, dtype=np.uint8)
    for r in pages:
        held[r.page * (page // 8) : (r.page + 1) * (page // 8)] = np.frombuffer(bytes(r.bits), dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, cells = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
            cells = cells[ends[0] : ends[-1]]
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            at = cells % CELL_SLOTS
            some = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row, i = row[some], some - (ends[:-1] - ends[0])[row[some]]
            yield pa.RecordBatch.from_arrays([pa.array(cells[some]), *(batch.column(c).take(pa.array(row)) for c in range(2)), pa.array(i.astype(np.int32))], names=["cell", "key", "size", "i"])

    likely = marks.select("key", "size", "prefix").mapInArrow(run, "cell bigint, key bigint, size int, i int")
    return likely.join(several, "cell").dropDuplicates(["cell", "key"])


def similar_links(marks: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float, words: int, radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) between keys of sets: pairs of the similarity or more, and only those, are connected by them.

    marks: (key, size, prefix), where a set may recur; sets: (key, doc_id, t, size, fp, sketch), each once, with the row of texts (doc_id, t, text) that has it.
    Links of fingerprints within the radius, by the grid join, come first; by prefixes come those that these leave.
    """
    members = cut(_shared(marks))
    share = similarity / (1 + similarity)
    # after the first shingle that two sets share, no more can follow than the shorter rest has
    most = lambda a, b: F.least(F.col(f"{a}size") - F.col(f"{a}i"), F.col(f"{b}size") - F.col(f"{b}i"))
    both = lambda a, b: F.col(f"{a}size") + F.col(f"{b}size")
    near = lambda a, b: most(a, b) >= share * both(a, b) - 1e-9

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH_BITS // 8) for c in (3, 4))
            total, bits = batch.column(2).to_numpy(), np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            good = pa.array(bits <= (1 - similarity) / (1 + similarity) * total + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits / np.maximum(total, 1))], names=["src", "dst", "far"]).filter(good)

    parts = [f"s{k}" for k in range(SKETCH_BITS // 64)]
    sketched = sets.select("key", *(F.conv(F.hex(F.substring("sketch", 8 * k + 1, 8)), 16, -10).cast("bigint").alias(c) for k, c in enumerate(parts)))
    closer = lambda a, b: sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in parts), F.lit(0)) <= (1 - similarity) / (1 + similarity) * both(a, b) + 1e-6

    def sift(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("key").alias(k), F.col("size").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in ("src", "dst"))
        told = pairs.join(one, "src").join(two, "dst").select("src", "dst", (F.col("n_src") + F.col("n_dst")).alias("n"), "s_src", "s_dst")
        return told.mapInArrow(close, "src bigint, dst bigint, far double")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), _longs([np.unique(shingle_hashes(text.as_py(), words))])], names=["src", "h"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for h, text in zip(batch.column(2), batch.column(3)):
                x, y = h.values.to_numpy().view("<u8"), np.unique(shingle_hashes(text.as_py(), words))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def judge(pairs: DataFrame) -> DataFrame:
        """The sets of one side, most often the few hubs, go to the pairs, and these to the texts of the other."""
        row = lambda k: sets.select(F.col("key").alias(k), F.struct("doc_id", "t").alias(f"row_{k}"))
        named = cut(pairs.join(row("src"), "src").join(row("dst"), "dst"))
        slot = lambda r: F.pmod(F.xxhash64(r["doc_id"], r["t"]), F.lit(TEXT_SLOTS))
        wanted = named.select(F.explode(F.array("row_src", "row_dst")).alias("row")).select(slot(F.col("row")).alias("slot")).distinct()
        some = texts.select(F.struct("doc_id", "t").alias("row"), "text").withColumn("slot", slot(F.col("row"))).join(F.broadcast(wanted), "slot", "left_semi").drop("slot")  # spares most texts the shuffle
        own = lambda k: F.col(f"row_{k}").eqNullSafe(F.col("row"))
        first = named.select("src", "row_src").distinct().join(some, own("src")).dropDuplicates(["src"]).select("src", "text").mapInArrow(hashed, "src bigint, h array<bigint>")
        met = named.select("src", "dst", "row_dst").join(cut(first), "src").join(some, own("dst")).select("src", "dst", "h", "text")
        return met.mapInArrow(verified, "src bigint, dst bigint").distinct()

    coarse, shared = _cells(sets.select("key", "size", "fp", embed(F.col("fp")).alias("e")), radius)
    bits = lambda a, b, c: F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) <= radius
    within = lambda a, b: bits(a, b, "e") & bits(a, b, "fp") & (F.least(f"{a}size", f"{b}size") >= share * both(a, b) - 1e-9)
    alike = links_in_cells(cut(coarse.join(shared, ["grid", "cell"]).select("cell", "key", "size", "fp", "e")), ["size", "fp", "e"], within, sift, judge, (sketched, closer))
    return links_in_cells(members, ["size", "i"], near, sift, judge, (sketched, closer), known=cut(alike))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t, component_id, first_t) for every row of docs; t is a hash of its text, first_t that of the class's first row by doc_id and t.

    component_id is the smallest doc_id among the rows reachable over pairs of at least the similarity, null where none of them has one. Texts without words are alike.
    """
    body = F.col(text).cast("string")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("t"), body.alias("text"))
    common, often = _common(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, sketches, firsts = [], [], [], [], []
            for x in batch.column(2):
                h = np.unique(shingle_hashes(x.as_py(), words))
                at = np.searchsorted(common, h)
                n = np.where(common[np.minimum(at, len(common) - 1)] == h, often[np.minimum(at, len(common) - 1)], 0) if len(common) else np.zeros(len(h), dtype=np.int64)
                keys.append(_set_key(h))
                sizes.append(len(h))
                prints.append(fingerprint_of(h))
                sketches.append(_sketch(h))
                firsts.append(h[np.argsort(n, kind="stable")][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), _longs(firsts)], names=["doc_id", "t", "key", "size", "fp", "sketch", "prefix"])

    marks = cut(texts.mapInArrow(run, "doc_id bigint, t bigint, key bigint, size int, fp bigint, sketch binary, prefix array<bigint>"))
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")  # rows with a doc_id come first
    firsts = cut(marks.groupBy("key").agg(F.min(lead).alias("lead")))
    own = firsts.select(F.col("key").alias("k"), "lead")
    sets = cut(marks.join(own, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("t") == F.col("lead.t"))).select("key", "doc_id", "t", "size", "fp", "sketch").dropDuplicates(["key"]))
    comp = connected_components(similar_links(marks, sets, texts, similarity, words))
    named = firsts.select("key", "lead").join(comp.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "lead", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("lead").alias("first"))
    classes = named.join(least, "component").select("key", F.col("first.doc_id").alias("component_id"), F.col("first.t").alias("first_t"))
    return marks.select("doc_id", "t", "key").join(classes, "key").select("doc_id", "t", "component_id", "first_t")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near copies, with all columns: the first by doc_id and a hash of the text, any one of rows that share both.

    Rows that share a doc_id are judged by their own texts. Null and empty texts, and those without words, are one class. Rows without a doc_id take no part and
    all stay. An empty table gives none; columns of any name are kept.
    """
    named = near_copies(docs.filter(F.col(doc_id).isNotNull()), doc_id, text)
    keep = cut(named.filter("doc_id = component_id and t = first_t").groupBy("doc_id", "t").agg(F.count("*").alias("n")))
    taken = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in taken else free(f"{name}_")
    k, h = free("keep_id"), free("keep_t")
    keep = keep.select(F.col("doc_id").alias(k), F.col("t").alias(h), "n")
    marked = docs.filter(F.col(doc_id).isNotNull()).withColumn(k, F.col(doc_id).cast("bigint")).withColumn(h, F.xxhash64(F.col(text).cast("string")))
    once = marked.join(keep.filter("n = 1").drop("n"), [k, h], "left_semi")
    again = marked.join(keep.filter("n > 1").drop("n"), [k, h], "left_semi").dropDuplicates([k, h])
    return once.unionByName(again).select(*docs.columns).unionByName(docs.filter(F.col(doc_id).isNull()))
