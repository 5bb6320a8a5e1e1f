"""A document pipeline: toxicity, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result below the shared checkpoint folder and reads it back for the next stage.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import language, mixing, neardup, packing, toxicity
from panelwright.llm.common import read, store

#: No stage but mixing can be stated in SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ``ids``; documents without an id stay.

    Most documents stay, so only those that a bitmap of the ids does not clear are joined,
    and the texts of the others are not shuffled.
    """
    gone = ids.filter("doc_id IS NOT NULL").distinct()
    maybe = neardup.maybe_among(gone)(F.col("doc_id"))
    return docs.filter(~maybe).union(docs.filter(maybe).join(gone, "doc_id", "left_anti").select(docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the model learns from the labelled rows of ``docs``."""
    return toxicity.keep(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; what has no letter goes."""
    return language.keep(docs, language.sample(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets of similarity 0.8 or more, that with the smallest id."""
    groups = store(neardup.near_duplicates(docs, width=5))
    return _without(docs, groups.filter(~F.col("kept")).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights, three epochs at most."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their places in full sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_without_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
