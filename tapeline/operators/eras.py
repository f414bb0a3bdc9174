"""Days on which symbols were seen, cut into eras of continuous observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import market

MAJOR_GAP = 14


def symbol_days(messages: DataFrame) -> DataFrame:
    """Rows, trades and times of each symbol and day, in one pass over all days."""
    return messages.filter(F.col("symbol").isNotNull()).groupBy("symbol", "day").agg(
        F.count("*").alias("main_rows"),
        F.count_if(F.col("type") == market.TRADE).alias("trade_rows"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
    )


def calendar(days: DataFrame) -> DataFrame:
    """The corpus's days with their number, from 1.

    There are as many rows as days, so that numbering them in one task is no burden.
    """
    return days.select("day").distinct().withColumn("day_no", F.row_number().over(Window.orderBy("day")))


def _gaps(days: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    date = F.to_date("day", "yyyyMMdd")
    return days.withColumn("from_day", F.lag("day").over(w)).withColumn("gap", F.datediff(date, F.to_date("from_day", "yyyyMMdd")))


def gap_list(days: DataFrame, major: int = MAJOR_GAP) -> DataFrame:
    """Days between two sightings of a symbol, where more than ``major``."""
    return _gaps(days).filter(F.col("gap") > major).select("symbol", "from_day", F.col("day").alias("to_day"), F.col("gap").alias("calendar_gap_days"))


def symbols(days: DataFrame, major: int = MAJOR_GAP, least_coverage: float = 0.95) -> DataFrame:
    """One row per symbol: first and last day, coverage of the days between, gaps, class."""
    each = _gaps(days).groupBy("symbol").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("*").alias("observed_days"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap_days"),
        F.count_if(F.col("gap") > major).alias("major_gap_count"),
        F.sum("main_rows").alias("main_rows"),
        F.sum("trade_rows").alias("trade_rows"),
    )
    each = _expected(each, days)
    return each.withColumn("coverage", F.col("observed_days") / F.col("expected_days")).withColumn("classification", market.symbol_class(least_coverage))


def _expected(spans: DataFrame, days: DataFrame) -> DataFrame:
    """Adds the corpus days between first and last day, and the corpus's own first and last day.

    Numbers of days turn the count into a difference; no day is joined to a span that it lies in.
    """
    cal = calendar(days)
    first, last = cal.select(F.col("day").alias("first_day"), F.col("day_no").alias("_a")), cal.select(F.col("day").alias("last_day"), F.col("day_no").alias("_b"))
    window = cal.agg(F.min("day").alias("first_window_day"), F.max("day").alias("last_window_day"))
    out = spans.join(first, "first_day").join(last, "last_day").crossJoin(F.broadcast(window))  # one row
    return out.withColumn("expected_days", F.col("_b") - F.col("_a") + 1).drop("_a", "_b")


def eras(days: DataFrame, major: int = MAJOR_GAP, least_coverage: float = 0.95) -> DataFrame:
    """One row per symbol and stretch of days without a gap of more than ``major`` days."""
    w = Window.partitionBy("symbol").orderBy("day")
    parts = _gaps(days).withColumn("era_index", F.sum(F.when(F.col("gap") > major, 1).otherwise(0)).over(w) + 1)
    spans = parts.groupBy("symbol", "era_index").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("*").alias("observed_days"),
        F.sum("main_rows").alias("main_rows"),
        F.sum("trade_rows").alias("trade_rows"),
        F.min("min_timestamp").alias("min_timestamp"),
        F.max("max_timestamp").alias("max_timestamp"),
    )
    spans = spans.withColumn("era_count", F.count("*").over(Window.partitionBy("symbol")))
    spans = _expected(spans, days).withColumnRenamed("expected_days", "expected_days_in_era")
    spans = spans.join(symbols(days, major, least_coverage).select("symbol", F.col("classification").alias("source_classification")), "symbol")
    return spans.withColumns(
        {
            "symbol_era_id": F.concat("symbol", F.lit("#"), F.lpad(F.col("era_index").cast("string"), 3, "0")),
            "coverage_ratio": F.round(F.col("observed_days") / F.col("expected_days_in_era"), 6),
            "missing_days_inside_era": F.col("expected_days_in_era") - F.col("observed_days"),
            "split_from_symbol": F.col("era_count") > 1,
        }
    ).withColumns({"recommended_use": market.recommended_use(least_coverage), "identity_status": market.identity_status()})
