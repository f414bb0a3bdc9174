"""From bars to a universe, quality events, a daily panel and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import market


def nearest_rank(column: str, q: float) -> Column:
    """Quantile by the nearest rank, of an aggregation's values."""
    values = F.sort_array(F.collect_list(column))
    return F.try_element_at(values, (F.round((F.size(values) - 1) * q) + 1).cast("int"))


def universe(eras: DataFrame, bars: DataFrame, coverage: float = 0.95, core: float = 1e6, active: float = 1e5) -> DataFrame:
    """Eras with what their bars add up to, and a liquidity tier. A group holds one bar a day at most."""
    stats = bars.join(eras.select("symbol_era_id"), "symbol_era_id").groupBy("symbol_era_id").agg(
        F.count_distinct("day").alias("traded_days"),
        F.min("day").alias("first_trade_day"),
        F.max("day").alias("last_trade_day"),
        F.sum("volume").alias("total_volume"),
        F.sum("trade_count").alias("total_trade_count"),
        F.sum("notional").alias("total_notional"),
        F.avg("notional").alias("avg_daily_notional"),
        F.median("notional").alias("median_daily_notional"),
        nearest_rank("notional", 0.10).alias("p10_daily_notional"),
        F.avg("volume").alias("avg_daily_volume"),
        F.median("volume").alias("median_daily_volume"),
        F.avg("trade_count").alias("avg_daily_trade_count"),
        F.median("trade_count").alias("median_daily_trade_count"),
        F.min_by("close", "day").alias("first_close"),
        F.max_by("close", "day").alias("last_close"),
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
    )
    out = eras.join(stats, "symbol_era_id", "left").fillna({"traded_days": 0, "total_volume": 0, "total_trade_count": 0, "total_notional": 0.0})
    out = out.withColumn("trade_day_coverage_ratio", F.col("traded_days") / F.col("expected_days_in_era"))
    return out.withColumn("liquidity_tier", market.liquidity_tier(coverage, core, active))


def quality(bars: DataFrame, members: DataFrame, multiple: float = 20.0, floor: float = 1e6, extreme: float = 0.5, near_zero: float = 0.01) -> DataFrame:
    """Bars of the universe's eras with one flag per kind of quality event; one shuffle, by era."""
    era = Window.partitionBy("symbol_era_id")
    keys = ["symbol", "symbol_era_id"]
    rows = bars.join(members.select(*keys, "liquidity_tier", "expected_days_in_era"), keys)
    rows = rows.withColumns(
        {
            "prev_close": F.lag("close").over(era.orderBy("day")),
            "median_notional_by_symbol": F.median("notional").over(era),
            "median_volume_by_symbol": F.median("volume").over(era),
        }
    )
    rows = rows.withColumn("raw_close_return", F.try_divide("close", "prev_close") - 1.0)
    return rows.withColumns(
        {
            "invalid_ohlc": market.ohlc_invalid(),
            "nonpositive_price": market.price_at_most(0.0),
            "near_zero_price": market.price_at_most(near_zero),
            "extreme_return": F.coalesce(F.abs("raw_close_return") >= extreme, F.lit(False)),
            "notional_outlier": market.notional_outlier(multiple, floor),
            "volume_outlier": market.volume_outlier(multiple),
        }
    )


def quality_events(flagged: DataFrame) -> DataFrame:
    """One row per bar and event; the bars are read once, not once for each kind."""
    events = F.filter(F.array(*[F.when(F.col(e), F.lit(e)) for e in market.QUALITY_EVENTS]), lambda e: e.isNotNull())
    keep = ["day", "symbol", "symbol_era_id", "liquidity_tier", "open", "high", "low", "close", "volume", "notional", "prev_close", "raw_close_return"]
    return flagged.select(*keep, F.explode(events).alias("event_type"))


def quality_by_symbol(flagged: DataFrame, members: DataFrame) -> DataFrame:
    """Days of each kind of event by era, and their sum with the missing days."""
    keys = ["symbol", "symbol_era_id", "liquidity_tier"]
    counted = [F.count_if(e).alias(f"{e}_days") for e in market.QUALITY_EVENTS]
    stats = flagged.groupBy(*keys).agg(
        F.count_distinct("day").alias("observed_trade_days"),
        *counted,
        F.min("raw_close_return").alias("min_raw_close_return"),
        F.max("raw_close_return").alias("max_raw_close_return"),
        F.max(F.abs("raw_close_return")).alias("max_abs_raw_close_return"),
        F.median("notional").alias("median_daily_notional"),
        F.median("volume").alias("median_daily_volume"),
    )
    out = members.select(*keys, "expected_days_in_era").join(stats, keys, "left").fillna({"observed_trade_days": 0})
    out = out.withColumn("missing_trade_days", F.col("expected_days_in_era") - F.col("observed_trade_days"))
    issues = sum((F.coalesce(c, F.lit(0)) for c in [*(f"{e}_days" for e in market.QUALITY_EVENTS), "missing_trade_days"]), F.lit(0))
    return out.withColumn("quality_issue_days", issues)


def event_flags(events: DataFrame) -> DataFrame:
    """Days and eras with a flag for each kind of event: a pivot over known values."""
    return events.groupBy("day", "symbol_era_id").agg(*[F.bool_or(F.col("event_type") == e).alias(f"quality_{e}") for e in market.QUALITY_EVENTS])


def panel(bars: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Bars of the universe's eras with its metadata and the day's quality flags."""
    flags = [f"quality_{e}" for e in market.QUALITY_EVENTS]
    out = bars.join(members, ["symbol", "symbol_era_id"]).join(event_flags(events), ["day", "symbol_era_id"], "left")
    out = out.fillna(False, flags)
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.col(f)
    return out.withColumn("quality_has_event", any_flag)


def flag_mismatches(table: DataFrame, events: DataFrame) -> DataFrame:
    """For each kind of event the rows whose flag differs from the events'."""
    names = [f"quality_{e}" for e in market.QUALITY_EVENTS]
    expected = event_flags(events).withColumnsRenamed({n: f"_{n}" for n in names})
    joined = table.join(expected, ["day", "symbol_era_id"], "left")
    counts = joined.agg(*[F.count_if(F.col(n) != F.coalesce(f"_{n}", F.lit(False))).alias(n) for n in names])
    return counts.unpivot([], names, "flag", "mismatches")


def contract_metrics(table: DataFrame) -> DataFrame:
    """One row of counts of what a panel must not have."""
    keys = table.groupBy("day", "symbol_era_id").agg((F.count("*") - 1).alias("extra"))
    twice = keys.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_key_rows"))
    counts = table.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("symbol_era_id").alias("symbol_era_count"),
        F.count_if(market.ohlc_invalid()).alias("invalid_ohlc_rows"),
        F.count_if(market.price_at_most(0.0, ("open", "high", "low", "close", "vwap"))).alias("nonpositive_price_rows"),
        F.count_if(F.coalesce(F.col("volume") <= 0, F.lit(True))).alias("nonpositive_volume_rows"),
        F.count_if(F.coalesce(F.col("trade_count") <= 0, F.lit(True))).alias("nonpositive_count_rows"),
        F.count_if(F.coalesce(F.col("notional") <= 0, F.lit(True))).alias("nonpositive_notional_rows"),
        F.count_if(F.coalesce(F.col("last_timestamp") < F.col("first_timestamp"), F.lit(True))).alias("reversed_time_rows"),
    )
    return counts.crossJoin(twice)  # one row each


def null_counts(table: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of each column, a row each."""
    return table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column", "null_count")


def returns(table: DataFrame, action: float = 0.45) -> DataFrame:
    """Close-to-close returns of a panel with the reason why one can't be trusted."""
    w = Window.partitionBy("symbol_era_id").orderBy("day")
    out = table.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("day", "close", "quality_has_event")})
    out = out.withColumn("raw_close_return", market.close_return())
    out = out.withColumns(
        {
            "log_close_return": F.when(F.col("raw_close_return") > -1, F.log1p("raw_close_return")),
            "potential_corporate_action": F.coalesce(F.abs("raw_close_return") >= action, F.lit(False)),
            "dirty_return_reason": market.dirty_reason(),
        }
    )
    return out.withColumn("is_clean_return_day", F.col("dirty_return_reason").isNull())
