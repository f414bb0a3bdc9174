"""Summaries of runs, cohorts and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import market


def recall(rows: DataFrame, by: str) -> DataFrame:
    """Cases, truths, the share of truths that were hit, and hits that are none; ``rows`` has truth and hit."""
    out = rows.groupBy(by).agg(F.count("*").alias("cases"), F.count_if("truth").alias("truths"), F.count_if(F.col("truth") & F.col("hit")).alias("_found"), F.count_if(F.col("hit") & ~F.col("truth")).alias("noise_only"))
    return out.withColumn("recall", F.round(F.try_divide("_found", "truths"), 4)).drop("_found")


def backfill_progress(days: DataFrame) -> DataFrame:
    """Days (day, published) with whether they and all before them are published. As many rows as days."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn("in_prefix", F.min("published").over(w))


def backfill_summary(runs: DataFrame) -> DataFrame:
    """One row for each kind of failure (null: none): runs, and means of seconds and bytes; ``runs`` has day, failure, seconds and bytes."""
    return runs.groupBy("failure").agg(F.count("*").alias("runs"), F.count_distinct("day").alias("days"), F.avg("seconds").alias("mean_seconds"), F.avg("bytes").alias("mean_bytes"))


def profile_rates(stages: DataFrame) -> DataFrame:
    """Rows, seconds and rows a second of each stage; ``stages`` has stage and seconds, a row each."""
    out = stages.groupBy("stage").agg(F.count("*").alias("rows"), F.sum("seconds").alias("seconds"))
    return out.withColumn("rows_per_second", F.try_divide(F.col("rows"), F.col("seconds")))


def reconciliation(cohort: DataFrame, decided: DataFrame, key: str = "symbol_era_id") -> DataFrame:
    """One row: different keys of either table, and those that only one of them has."""
    both = cohort.select(key).distinct().withColumn("_c", F.lit(1)).join(decided.select(key).distinct().withColumn("_d", F.lit(1)), key, "full")
    return both.agg(F.count("*").alias("eras"), F.count_if(F.col("_c").isNull()).alias("only_decided"), F.count_if(F.col("_d").isNull()).alias("only_cohort"))


def two_in_a_row(rows: DataFrame, key: str, order: list[str], low: Column) -> DataFrame:
    """For each key whether two of its rows, one after the other, are low: a search that may stop."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_low", low).withColumn("_before", F.coalesce(F.lag("_low").over(w), F.lit(False)))
    return marked.groupBy(key).agg(F.bool_or(F.col("_low") & F.col("_before")).alias("stops"))


def seeded_sample(rows: DataFrame, truth: Column, key: str, seed: int, most: int) -> DataFrame:
    """``most`` rows: those that ``truth`` marks first, each part in the order of a hash of key and seed."""
    luck = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return rows.orderBy(F.when(truth, 0).otherwise(1), luck, key).limit(most)


def form_then_distance(rows: DataFrame, rank: Column, distance: Column, key: str, tie: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key by rank of form, then distance."""
    w = Window.partitionBy(key).orderBy(rank, distance, tie)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def validity_manifest(days: DataFrame, least_share: float = 0.2) -> DataFrame:
    """One row: days scanned, valid and quarantined, and the quarantined ones with their reasons, in order.

    ``days`` has day, total_rows and trade_rows.
    """
    rows = days.withColumn("reason", market.session_reason(least_share)).withColumn("share", F.round(F.try_divide("trade_rows", "total_rows"), 6))
    bad = F.when(F.col("reason").isNotNull(), F.struct("day", "reason", "total_rows", "trade_rows", F.coalesce("share", F.lit(0.0)).alias("trade_share")))
    return rows.agg(
        F.lit(least_share).alias("min_trade_share"), F.count("*").alias("scanned_day_count"), F.count_if(F.col("reason").isNull()).alias("valid_day_count"), F.count("reason").alias("quarantined_day_count"),
        F.array_sort(F.collect_list(bad)).alias("quarantined_days"),
    )


def without_quarantined(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of days that a manifest does not hold back."""
    return rows.join(manifest.select(F.explode("quarantined_days.day").alias("day")), "day", "left_anti")
