"""Staged tables, and the size of the batches that texts are handed over in."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeline.sources.staging import new_path, release, shared_dir, staged  # noqa: F401

BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Holds Arrow batches of this session to 8 MB, and returns ``df``.

    A batch stands in the JVM and in the worker, once on the way in and once on the way out; what
    is done with it here gains nothing from larger ones. The setting is the session's: it is
    lowered, never raised, and stays so, since the plan that needs it runs later.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df
