"""Corpus pipeline: stages over documents, each calling one operator of storelens.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storelens.llm.bpe import with_digests
from storelens.llm.common import shared_folder, stored
from storelens.llm.decontam import decontaminated
from storelens.llm.labelled import training_rows
from storelens.llm.partenum import without_near_duplicates
from storelens.llm.quality import with_quality
from storelens.llm.toxicity import with_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject (score below 0.3)."""
    return with_toxicity(docs, _table(spark, sf_dir, "labels"), threshold=0.3).filter("predicted = 0").select(docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality model does not reject (score of 0.7 at least); all, if no label can be learnt from."""
    labels = _table(spark, sf_dir, "labels")
    if training_rows(docs, labels, "quality", 1).isEmpty():
        return docs
    return with_quality(docs, labels, threshold=0.7).filter("predicted = 1").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group linked at a Jaccard similarity of 0.8."""
    return without_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item (0.8 of its shingles)."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"), threshold=80).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with the number of their BPE tokens, and digests of ids and of the decoded text."""
    return with_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: Trained models and a tokenizer cannot be said in SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs, folder = _table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
