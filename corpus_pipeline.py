"""The corpus pipeline: its stages in order, each one operator of ``ratingspark.llm`` on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingspark.llm import bpe, compression, exact_dedup, mix, simhash
from ratingspark.llm.common import stored, table
from ratingspark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on labelled ones among them, does not reject. Null and empty texts are
    scored like any other; rows with null or repeated ids are judged row by row; without labels none is rejected for them."""
    return compression.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased), the one with the smallest id. Null texts equal empty ones; a row
    without an id stays only where its text has no other; rows that repeat id and text are one."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints at most 4 bits apart, the one with the smallest id. Different texts of one id
    are different documents; texts without words are one component; rows without an id give way to those with one."""
    return simhash.deduplicate(docs, width=4, bits=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, once for each pass that the mix makes over them; those it leaves out go, as do texts
    without words. A null source is one of its own."""
    return mix.ordered(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix, as digests of their ids and of the text that they decode to; no tokens for a null
    or empty text. Columns that no stage knows pass all stages but this one, whatever their names; an empty table stays one."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("bpe", tokens)]
#: The classifier, fingerprints and tokens have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
