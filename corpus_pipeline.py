"""The corpus pipeline: STAGES, and run() that applies them to documents.

Each stage works on all rows that the one before it kept; what is written between two
stages cuts the lineage. SQL can't express the first stage (a fitted random field), so
there is none for the whole; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, linededup, minhash, mixing, quality
from tidewater.llm.common import Scratch, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents most of which is boilerplate go, as do those without a line of text."""
    return quality.quality_rules(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted from the texts; documents of which nothing is left go."""
    return linededup.line_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays, be they linked directly or through others."""
    return minhash.near_dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights; a scarce source gives all it has and doesn't bind the others."""
    return mixing.mix_sources(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become tokens, checked by decoding them."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("BPE encoding", encode_stage),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.cut(docs)
            scratch.clear(docs)  # what the stage read isn't needed any more
    return docs
