"""Labelled samples for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a sample's texts, at most; longer texts than a part of that stay out of it.
BYTES, PART = 32 << 20, 32


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int, most_bytes: int = BYTES) -> DataFrame:
    """doc_id, label and text of labelled documents outside the held-out fold, chosen by a hash of doc_id.

    A doc_id with several labels has the largest, one with several texts the shortest, of equals
    the first; labels other than 0 and 1 are ignored, a null text is empty. At most ``most`` rows,
    one a doc_id, of ``most_bytes`` in all: both bounds hold whatever the tables, which is what
    makes it safe to broadcast the labels and to return the sample to the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    luck = [F.xxhash64("doc_id", F.lit(label)), F.col("doc_id")]
    chosen = known.orderBy(*luck).limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    found = texts.filter(size <= most_bytes // PART).join(F.broadcast(chosen), "doc_id")
    each = found.groupBy("doc_id", "label").agg(F.min(F.struct(size.alias("size"), "text")).alias("x"))
    upto = F.sum("x.size").over(Window.orderBy(*luck).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # of `most` rows
    return each.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).select("doc_id", "label", F.col("x.text").alias("text"))
