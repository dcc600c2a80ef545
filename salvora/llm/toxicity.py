"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

Features are densities of a lexicon of words and word beginnings, plain and behind obfuscation, its nearness to second-person words, and rates of capitals, punctuation and
obfuscated words. The lexicon is learned too: a few fixed words and those whose document frequency among toxic rows of the sample
stands out. The model is fitted on the driver on features (not texts) of a bounded sample of labelled rows; one half of the sample
teaches the lexicon, the other the trees, and out-of-fold margins the calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvora.llm.trees import Boosted, Isotonic
from salvora.session import cut

#: Labelled rows that are learned from at most: those with the least hashes of their doc_id.
SAMPLE = 12_000
#: Words the learned lexicon has at most, and toxic documents that must have a word.
LEXICON, LEAST_DOCUMENTS = 300, 8
#: Lengths of word beginnings the lexicon may have, written with a star.
STEMS = (3, 4, 5, 6)
#: Least log odds of an entry.
LEAST_ODDS = 1.5
FOLDS = 5
#: Words that a worker remembers.
KNOWN_WORDS = 300_000
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 5

# Insults to begin with.
SEED_WORDS = frozenset("idiot stupid moron trash scum loser pathetic worthless disgusting clown imbecile dumb idiota estúpido basura imbécil stupide ordure dumm blödmann abschaum".split())
# Words that address the reader, in four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes tú ti tus".split())
# Characters that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
_TRIM = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "“”‘’–—…«»¡¿"
_LETTERS = re.compile(r"[^a-zà-öø-ÿœß]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_REPEAT = re.compile(r"(.)\1+")
NAMES = ("hits", "hits_100", "distinct", "weight_max", "weight_100", "hidden", "near_you", "you_100", "capitals", "shouted", "exclaims", "asks", "marks", "masked", "runs", "log_words")


def plain(word: str) -> str:
    """A word in lower case without marks about it."""
    return word.strip(_TRIM).lower()


def unmasked(word: str) -> str:
    """A word as it may be meant: letters for their look-alikes, other marks gone, repeats once."""
    return _REPEAT.sub(r"\1", _LETTERS.sub("", word.lower().translate(LEET)))


def entries(core: str) -> list[str]:
    """What a word can be found by in the lexicon: itself and its beginnings."""
    return [core, *(core[:k] + "*" for k in STEMS if len(core) > k)] if core else []


def features(text: str | None, lexicon: dict[str, float], folded: dict[str, float], known: dict[str, tuple] | None = None) -> list[float]:
    """The features of a whole text. lexicon: weight of each word and of each beginning, as in entries(); folded: the same with repeats once, to look behind obfuscation; known: words seen before, with what there is to say about each."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    hits, hidden, total, most, masked, shouted, you = [], 0, 0.0, 0.0, 0, 0, []
    known = {} if known is None else known
    if len(known) > KNOWN_WORDS:
        known.clear()
    for i, word in enumerate(words):
        seen = known.get(word)
        if seen is None:
            core = plain(word)
            weight, behind = max([lexicon.get(e, 0.0) for e in entries(core)], default=0.0), False
            odd = not core.isalpha() and any(c.isalpha() for c in core)
            if not weight and (odd or _REPEAT.search(core)):
                weight = folded.get(unmasked(core), 0.0)
                behind = weight > 0
            seen = known[word] = (weight, behind, odd, len(core) > 1 and word.isupper(), core in SECOND_PERSON)
        if seen[0]:
            hits.append(i)
            hidden += seen[1]
            total += seen[0]
            most = max(most, seen[0])
        masked += seen[2]
        shouted += seen[3]
        if seen[4]:
            you.append(i)
    at = np.array(you)
    near = 0
    if len(at) and hits:
        where = np.searchsorted(at, hits)
        gaps = np.minimum(np.abs(at[np.minimum(where, len(at) - 1)] - hits), np.abs(at[np.maximum(where - 1, 0)] - hits))
        near = int((gaps <= NEAR).sum())
    size = max(1, len(text))
    marks = sum(map(text.count, "!?#$%&*@.,;:-_~^"))
    runs = text.count("!!") + text.count("??") + text.count("***") + text.count("###") + text.count("$$$")
    return [len(hits), 100 * len(hits) / n, len({plain(words[i]) for i in hits}), most, 100 * total / n, hidden, near, 100 * len(you) / n, len(_CAPITAL.findall(text)) / size, shouted / n, 100 * text.count("!") / size, 100 * text.count("?") / size, marks / size, masked / n, 100 * runs / n, math.log1p(len(words))]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted
    calibration: Isotonic
    known: dict[str, tuple] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def features(self, texts: list) -> np.ndarray:
        folded = {}
        for word, weight in self.lexicon.items():
            folded[unmasked(word)] = max(weight, folded.get(unmasked(word), 0.0))
        folded.pop("", None)
        return np.array([features(t, self.lexicon, folded, self.known) for t in texts], dtype=float).reshape(len(texts), len(NAMES))

    def score(self, texts: list) -> np.ndarray:
        return np.clip(self.calibration.predict(self.trees.margin(self.features(texts))), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labels (doc_id, toxic) of docs (doc_id, text) that are not held out; of rows that share an id the largest label counts, and of documents that share one the text
    with the least hash, so that no more than `sample` texts are learned from.

    Texts are read whole, null as empty; columns of other names play no part. Without labelled rows of both kinds the model gives the share of toxic rows, or 0 without any.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    drawn = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    drawn = drawn.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), (F.pmod("h", F.lit(2)) == 0).alias("teaches_words"))
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = cut(labelled.groupBy("doc_id", "toxic", "teaches_words").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))  # at most `sample` rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        seen = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                toxic = toxic.as_py()
                seen[toxic] += 1
                found.update((w, toxic) for w in {e for w in {plain(w) for w in (text.as_py() or "").split()} if w.isalpha() for e in entries(w)})
        out = [("", n, 0) if k == 0 else ("", 0, n) for k, n in enumerate(seen)]
        out += [(w, n * (1 - t), n * t) for (w, t), n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["word", "clean", "toxic"])

    counts = rows.filter("teaches_words").select("text", "toxic").mapInArrow(count, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.filter("word = ''").first()
    lexicon = {w: 4.0 for w in SEED_WORDS}
    if total and total.clean and total.toxic:
        odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1)) - F.log((F.col("clean") + 0.5) / (total.clean + 1))
        best = counts.filter((F.col("word") != "") & (F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("toxic") >= 0.02 * total.toxic)).select("word", odds.alias("odds"), "toxic").filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "word").limit(LEXICON)
        lexicon |= {r.word: round(r.odds, 3) for r in best.collect()}
    model = Model(lexicon, Boosted(), Isotonic())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.filter("not teaches_words").select("text", "toxic").mapInArrow(describe, "toxic int, x array<double>").collect()
    got.sort(key=lambda r: (r.toxic, r.x))
    x, y = np.array([r.x for r in got], dtype=float).reshape(len(got), len(NAMES)), np.array([r.toxic for r in got], dtype=float)
    if len(y) < 2 * FOLDS or len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        model.calibration = Isotonic(np.array([0.0]), np.array([share]))
        return model
    fold = np.arange(len(y)) % FOLDS
    margin = np.empty(len(y))
    for k in range(FOLDS):
        margin[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    model.calibration.fit(margin, y)
    model.trees.fit(x, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) with score, one row each; null texts are scored as empty ones, which have all features zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below threshold, with all their columns."""

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), dtype=float)

    return docs.filter(judge(F.col("text").cast("string")) < threshold)


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Repeated rows each give a row; an empty table gives none."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
