"""A training corpus from raw documents, in stages that are each written and read again.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, the next stage's docs. All but the last
return the columns of documents, whatever they are called. A text that is null counts as empty, and every text is read whole; a stage of no rows gives none. Rows
that recur, or share a doc_id, are judged each by its own text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salvora.llm import decontamination, mixing, secrets, simhash, toxicity
from salvora.session import ensure_checkpoint_dir, load, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject: those with a score below one half; a score of one half goes. Null and empty texts are scored as empty ones. Without labels of both kinds all
    documents have one score, the share of toxic ones among the labelled."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word sets 0.8 alike or more, directly or through others. The first by doc_id, then by a hash of its text, stays, and one of rows equal in
    both; null and empty texts are one group; rows without a doc_id stay."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, within an edit for 20 characters; null and empty texts hold none. An empty benchmark takes nothing out."""
    return decontamination.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew; null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents it takes, whole copies of each, and words of a last copy in part. `taken` counts the words of all. Documents without words are never taken; sources that are null are one
    source; ties are broken by a seeded hash, so that reruns agree."""
    mixed = mixing.mix(docs).filter("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size")).cast("bigint")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", copies.alias("copies"), (F.col("taken") - copies * F.col("size")).alias("part_words"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: A trained model, edit distances and connected components are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written under the shared checkpoint folder and reread, and goes once the next is written."""
    docs = load(spark, sf_dir, "documents")
    folder, before = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
