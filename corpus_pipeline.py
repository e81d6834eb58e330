"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Defined results of the stages, all but the last of which return the columns of documents, extra ones of any name
too: a null or empty text is no toxic one, has no language and goes with the second stage; a null id is kept by
every stage, learned from by none; rows that repeat an id are scored each, and one stays of those that the third
stage keeps; ties of copies go to the smallest id; very long texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackscan.llm import langid, packing, simhash, toxicity
from trackscan.llm.common import materialize, prepare, table
from trackscan.llm.registry import vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the machine learns from the labels of the documents given."""
    return toxicity.keep_clean(docs, table(prepare(spark), sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    prepare(spark)
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its place in a sequence."""
    prepare(spark)
    return packing.query(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("language", language), ("simhash", near_copies), ("packing", pack)]
#: Learned models and tokenizers have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
