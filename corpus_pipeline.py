"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of ``documents`` but for the last, which returns the packed pieces. What a stage returns
is written as Parquet and read again as the next one's input.

A null text counts as an empty one and stays null; empty and very long texts are scored, compared,
masked and packed whole. Rows without a doc_id pass like any other, repeated rows are scored alike,
and extra columns pass unread, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import minhash, packing, pii, quality, toxicity
from tapeline.llm.learning import fold
from tapeline.llm.storage import staged

#: SQL cannot express trained classifiers and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 for toxicity. Without labels of both kinds all score alike: all stay, or none if all are toxic."""
    return toxicity.kept(docs, toxicity.fit(*_labelled(spark, sf_dir), F.coalesce(fold(4) == 2, F.lit(False))))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 for quality. Without labels of both kinds all score alike: all stay, or none if all are poor."""
    return quality.kept(docs, quality.fit(*_labelled(spark, sf_dir), F.coalesce(fold(5) == 0, F.lit(False))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; all rows of this doc_id stay, as do texts without words and rows without a doc_id."""
    return minhash.kept_only(docs, 80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; no row goes, null and empty texts stay as they are."""
    return pii.masked(docs, pii.learnt(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places; a null or empty text is the end id alone."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
