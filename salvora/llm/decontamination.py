"""Benchmark decontamination: pigeonhole edit matching.

An item may differ from its copy in a document by up to k edits, a share of its length. Cut into k + 1 pieces, at least one piece
is unchanged in the copy; an Aho-Corasick automaton finds the exact hits of all pieces in a text, each hit says where the whole
item would begin, and the window about it is verified with Myers' bit-parallel edit distance. Texts and items are compared in lower case
with runs of space as one space. An item too short for an edit is looked for as it is, between characters that are no letters or digits.

Items go through in blocks of bounded size, so the automaton's size does not depend on the benchmark's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One edit for so many characters of an item.
CHARS_PER_EDIT = 20
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id bigint, item_id bigint, start bigint, distance int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces that make up the item, with their offsets; none is empty as an item is longer than its edits."""
    cuts = [i * len(item) // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def whole(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] ends no word within it."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def myers(item: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of item to a substring of text, and where the first such substring ends; (most + 1, -1) if above most."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """Items (id, text) ready to be found in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(self.items):
            for at, piece in pieces(item, budget(item)):
                owners.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, start, distance) of the closest copy of every item within its budget, the first of equals; start is in the normal form of text, exact for exact copies and else within the budget."""
        if self.empty or not text:
            return []
        text = normal(text)
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[int]] = {}
        for end, (size, own) in self.automaton.iter(text):
            for n, offset in own:
                if n in best and best[n][0] == 0:
                    continue
                item = self.items[n][1]
                start, k = end - size + 1 - offset, budget(item)
                if not k:
                    if whole(text, start, end + 1):
                        best[n] = (0, start)
                    continue
                if text.startswith(item, max(start, 0)) and start >= 0:
                    best[n] = (0, start)
                    continue
                done = tried.setdefault(n, [])
                at = bisect_left(done, start)
                if at < len(done) and done[at] == start:
                    continue
                done.insert(at, start)
                low = max(0, start - k)
                distance, stop = myers(item, text[low : start + len(item) + k], k)
                if distance <= k and (n not in best or distance < best[n][0]):
                    best[n] = (distance, max(0, low + stop - len(item)))
        return sorted((self.items[n][0], start, distance) for n, (distance, start) in best.items())


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items (item_id, text) in blocks of about block_chars characters, dealt by a hash of the text; texts that recur come once, with their least id."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-total // block_chars)
    for b in range(blocks):
        yield [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, distance): every item that a row of docs holds within its edit budget, once for a row.

    Null and empty texts hold nothing, nor do items that are null or of white space only; all others are looked for, of any length. Texts are searched whole, in time that grows with
    their length and the places where a piece of an item stands. Repeated rows each give theirs, also of equal ids; of items with equal texts the least id counts. Of equally close
    copies the first is given. Other columns of docs and benchmark play no part; an empty table of either gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for items in item_blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in batches:
                out = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in matcher.find(t.as_py())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "start", "distance"])

        part = texts.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def _leaks(items: list[tuple[int, str]]):
    made: list[Matcher] = []  # one for each worker

    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(items))
        return pd.Series([bool(made[0].find(t)) for t in texts], dtype=bool)

    return leaks


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever their names; one pass for each block of items.

    What holds an item is defined as for matches: a benchmark with an item of one common word takes out all texts that have the word. Null and empty texts stay.
    """
    for items in item_blocks(benchmark, block_chars):
        docs = docs.filter(~_leaks(items)(F.col("text").cast("string")))
    return docs


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, distance of every benchmark item found in documents."""
    return matches(docs, benchmark)
