"""Language-model scores by stupid backoff, computed relationally from n-gram count tables of the corpus itself.

S(w2 | w1) = c(w1 w2) / c(w1) where the pair occurs at least min_count times in the corpus, else backoff * c(w2) / N; a text's first word has
c(w) / N. All counts are over all documents. A document's score is the sum of ln S over its words.

N-grams are 64-bit hashes. Documents are taken in chunks of bounded numbers of words. A chunk counts its words and pairs first, and sends each distinct one once, with its count, to the
bucket its hash names; a bucket sums the counts of all chunks, which are its part of the n-gram tables, and answers every chunk with the totals of
what that asked for. What a frequent word or pair puts into one task is one number for each chunk, however often it occurs. The chunk's documents wait where the answers meet them,
as places in the chunk's list of pairs; there every pair is scored and summed for its document. All of it travels as packed columns, as a row for each n-gram would cost several times the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COUNT, BACKOFF = 2, 0.4
#: Words of one chunk of documents, documents of one chunk, words that a worker remembers hashes of, words of a bucket.
CHUNK_WORDS, CHUNK_DOCUMENTS, KNOWN_WORDS, BUCKET_WORDS = 1_000_000, 60_000, 300_000, 1_000_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CODEC = "zstd"


class Hasher:
    """Words of texts as hashes; those of frequent words are remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for word in _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
            h = known.get(word)
            if h is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                h = known[word] = xxhash.xxh64_intdigest(word)
            out.append(h)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def pack(*columns: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(c).tobytes() for c in columns]
    head = np.array([len(r) for r in raw], dtype="<u4").tobytes()
    body = head + b"".join(raw)
    return len(body).to_bytes(4, "little") + pa.compress(body, codec=_CODEC, asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    body = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec=_CODEC, asbytes=True)
    sizes = np.frombuffer(body, "<u4", len(kinds))
    at, out = 4 * len(kinds), []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(body, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


class Chunk:
    """Words and pairs of some texts: distinct ones in the order of their buckets, and where the texts have them."""

    def __init__(self, texts: list[list[int]]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        words = np.concatenate([np.array(t, dtype=np.uint64) for t in texts] or [np.empty(0, np.uint64)])
        self.words, at = np.unique(words, return_inverse=True)
        self.word_counts = np.bincount(at, minlength=len(self.words))
        starts = np.cumsum(sizes) - sizes
        self.firsts = at[starts[sizes > 0]]  # of texts that have a word
        doc = np.repeat(np.arange(len(texts)), sizes)
        follows = np.ones(len(words), dtype=bool)
        follows[starts[sizes > 0]] = False
        second = np.flatnonzero(follows)
        code, which = np.unique(at[second - 1].astype(np.int64) * len(self.words) + at[second], return_inverse=True)
        self.first, self.second = np.divmod(code, max(1, len(self.words)))
        self.runs = np.bincount(which, minlength=len(code))
        self.docs = doc[second][np.argsort(which, kind="stable")]

    def pack(self) -> tuple[bytes, ...]:
        """All but the counts, for the place where the answers come."""
        per_word = np.bincount(self.first, minlength=len(self.words))
        return pack(self.words, per_word.astype("<u4"), (self.second & 0xFFFF).astype("<u2"), (self.second >> 16).astype("<u2"), self.runs.astype("<u4"), self.docs.astype("<u2"), self.firsts.astype("<u4"))

    @classmethod
    def unpack(cls, blob: bytes) -> Chunk:
        new = cls.__new__(cls)
        new.words, per_word, low, high, new.runs, docs, new.firsts = unpack(blob, "<u8", "<u4", "<u2", "<u2", "<u4", "<u2", "<u4")
        new.first = np.repeat(np.arange(len(new.words)), per_word)
        new.second = low.astype(np.int64) | high.astype(np.int64) << 16
        new.docs = docs.astype(np.int64)
        return new

    def hashes(self) -> np.ndarray:
        """Of its words and then its pairs."""
        return np.concatenate([_mix(self.words), _mix(_mix(self.words[self.first]) + self.words[self.second] * np.uint64(0xC2B2AE3D27D4EB4F))])

    def order(self, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams' order by bucket and then words, pairs and hashes, and their buckets in it."""
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((hashes, np.arange(len(hashes)) >= len(self.words), bucket))
        return by, bucket[by]


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal values."""
    edges = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, int)
    return list(zip(edges.tolist(), [*edges[1:].tolist(), len(sorted_values)]))


def lm_scores(docs: DataFrame, min_count: int = MIN_COUNT, backoff: float = BACKOFF, chunk_words: int = CHUNK_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score) for every row of docs (doc_id, text).

    n_backoff counts the words after the first whose pair is too rare. log_score is the sum of ln S, null for texts without words, null and
    empty ones included. Very long texts make a chunk of their own. Repeated rows each give a row and each count in the corpus; an empty table gives no rows; other columns play no part.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_words))
    log_total, log_backoff = float(np.log(max(total, 1))), float(np.log(backoff))

    def place(chunk: np.ndarray) -> np.ndarray:
        """Where the documents of chunks wait: below zero, where buckets are not."""
        return -1 - (_mix(chunk.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, part, number = Hasher(), TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[list[int]] = []
        held = 0

        def put() -> pa.RecordBatch:
            nonlocal ids, texts, held, number
            own, chunk = Chunk(texts), part << 24 | number
            hashes, counts = own.hashes(), np.concatenate([own.word_counts, own.runs])
            order, bucket = own.order(hashes, buckets)
            hashes, counts, pair = hashes[order], counts[order], order >= len(own.words)
            rows = [(int(bucket[a]), chunk, pack(hashes[a:b], counts[a:b].astype("<u4"), np.array([np.count_nonzero(~pair[a:b])], "<u4"))) for a, b in _cuts(bucket)]
            null = np.array([i is None for i in ids])
            named = pack(np.array([i or 0 for i in ids], "<i8"), null.astype("<u1"), np.array([len(t) for t in texts], "<i8"))
            rows.append((int(place(np.array([chunk]))[0]), chunk, len(named).to_bytes(8, "little") + named + own.pack()))
            ids, texts, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["key", "chunk", "packed"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(hashed(text.as_py()))
                held += len(texts[-1])
                if held >= chunk_words or len(ids) >= CHUNK_DOCUMENTS:
                    yield put()
        if ids:
            yield put()

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A bucket's totals of the n-grams of each chunk, packed by where the chunks' documents wait."""
        rows = []
        if key[0] >= 0:
            asked = [unpack(b, "<u8", "<u4", "<u4") for b in pdf["packed"]]
            size, words = np.array([len(h) for h, *_ in asked]), np.array([int(w[0]) for *_, w in asked])
            pair = np.concatenate([np.arange(n) >= w for n, w in zip(size, words)])
            hashes, own = np.concatenate([h for h, *_ in asked]), np.concatenate([c for _, c, _ in asked])
            total_of = np.empty(len(hashes))
            for kind in (pair, ~pair):  # a word and a pair are never one, whatever their hashes
                distinct, at = np.unique(hashes[kind], return_inverse=True)
                total_of[kind] = np.bincount(at, own[kind], len(distinct))[at] if len(distinct) else 0
            ends = np.cumsum(size)
            chunks = pdf["chunk"].to_numpy("<i8")
            to = place(chunks)
            by = np.argsort(to, kind="stable")
            for a, b in _cuts(to[by]):
                some = by[a:b]
                rows.append((int(to[some[0]]), key[0], pack(chunks[some], size[some].astype("<u4"), np.concatenate([total_of[ends[i] - size[i] : ends[i]] for i in some]).astype("<u8"))))
        return pd.DataFrame(rows, columns=["key", "bucket", "totals"])

    def finish(key: tuple, waiting: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """The rows of the documents that wait in one place."""
        out = []
        if key[0] < 0:
            found: dict[int, list[np.ndarray]] = {}
            for blob in answers.sort_values("bucket")["totals"]:
                chunks, size, totals = unpack(blob, "<i8", "<u4", "<u8")
                for chunk, some in zip(chunks.tolist(), np.split(totals, np.cumsum(size)[:-1])):
                    found.setdefault(chunk, []).append(some)
            for chunk, blob in zip(waiting["chunk"], waiting["packed"]):
                cut_at = 8 + int.from_bytes(blob[:8], "little")
                ids, null, sizes = unpack(blob[8:cut_at], "<i8", "<u1", "<i8")
                own = Chunk.unpack(blob[cut_at:])
                hashes = own.hashes()
                totals = np.empty(len(hashes))
                if len(hashes):
                    totals[own.order(hashes, buckets)[0]] = np.concatenate(found[int(chunk)])
                words, pairs = totals[: len(own.words)], totals[len(own.words) :]
                rare = pairs < min_count
                value = np.where(rare, log_backoff + _log(words[own.second]) - log_total, _log(pairs) - _log(words[own.first]))
                score = np.bincount(own.docs, np.repeat(value, own.runs), len(ids))
                score[sizes > 0] += _log(words[own.firsts]) - log_total
                backs = np.bincount(own.docs, np.repeat(rare, own.runs), len(ids))
                out.append(pd.DataFrame({"doc_id": pd.Series(pd.array(ids, "Int64")).mask(null == 1), "n_words": sizes, "n_backoff": backs.astype(np.int64), "log_score": score}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_words": [], "n_backoff": [], "log_score": []})

    dealt = docs.mapInArrow(deal, "key bigint, chunk bigint, packed binary").groupBy("key")
    answers = dealt.applyInPandas(count, "key bigint, bucket bigint, totals binary").groupBy("key")
    scored = dealt.cogroup(answers).applyInPandas(finish, "doc_id bigint, n_words bigint, n_backoff bigint, log_score double")
    return scored.withColumn("log_score", F.when(F.col("n_words") > 0, F.col("log_score")))


def op6_lm_scoring(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score and mean_log_score (by words, both rounded to 6 digits) of all documents."""
    return lm_scores(docs).select("doc_id", "n_words", "n_backoff", F.round("log_score", 6).alias("log_score"), F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, w[i] AS w2, CASE WHEN i > 1 THEN w[i - 1] END AS w1 FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT w2 AS w, count(*) AS c FROM t GROUP BY 1),
b AS (SELECT w1, w2, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
s AS (SELECT r, count(*) AS n_words, count(*) FILTER (w1 IS NOT NULL AND b.c IS NULL) AS n_backoff,
      sum(CASE WHEN t.w1 IS NULL THEN ln(u2.c / (SELECT sum(c) FROM u)) WHEN b.c IS NOT NULL THEN ln(b.c / u1.c) ELSE ln({BACKOFF} * u2.c / (SELECT sum(c) FROM u)) END) AS log_score
      FROM t JOIN u u2 ON u2.w = t.w2 LEFT JOIN u u1 ON u1.w = t.w1 LEFT JOIN b USING (w1, w2) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(log_score, 6) AS log_score, round(log_score / n_words, 6) AS mean_log_score FROM d LEFT JOIN s USING (r)
"""
