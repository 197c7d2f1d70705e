"""A training corpus from documents: toxic documents go, near copies go, repeated passages go, sources are mixed, texts become token ids.

Every stage reads all that its predecessor wrote.  ``run`` writes the stages' tables to the folder that the cluster shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import bpe, mixing, neardup, suffix_dedup, toxicity
from verdigris.llm.common import held_out, read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, with weights learned from the labels of the training fold, does not reject."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"), ~held_out(5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near copies: five-word shingles, a likeness of 0.8."""
    return neardup.deduplicated(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``PASSAGE`` bytes, some fifty words, that start elsewhere in what is left."""
    return suffix_dedup.without_repeats(docs, suffix_dedup.PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it."""
    return mixing.mix_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy with the digests of its ids and of what they decode to."""
    return bpe.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: No SQL for suffix sorting, learned weights and BPE; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
