"""Trades from messages, and bars from trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import market


def clean_trades(messages: DataFrame) -> DataFrame:
    """Confirmed trades without those that a trade break of the same symbol and trade id cancels.

    Works over any number of days at once: the anti join is keyed, so that a break only meets its
    own day's trades.
    """
    price = market.wire_price(messages.columns)
    trades = messages.withColumn("trade_price", price).filter(market.confirmed(F.col("trade_price")))
    if "trade_id" not in messages.columns:
        return trades
    breaks = messages.filter(F.col("type") == market.BREAK).select("day", "symbol", "trade_id").dropna().distinct()
    return trades.join(breaks, ["day", "symbol", "trade_id"], "left_anti")


def in_eras(trades: DataFrame, eras: DataFrame) -> DataFrame:
    """Trades with the era of their symbol that was active on their day; null for none.

    The symbol is an equality key, so the interval is only a filter on it. Eras are left to the
    optimizer, which broadcasts them if their size allows.
    """
    e = eras.select(F.col("symbol").alias("_symbol"), "symbol_era_id", F.col("first_day").alias("_first"), F.col("last_day").alias("_last"))
    return trades.join(e, (trades["symbol"] == e["_symbol"]) & trades["day"].between(e["_first"], e["_last"]), "left").drop("_symbol", "_first", "_last")


def bars(trades: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Open, high, low, close, volume, count, notional and volume-weighted price by ``keys``.

    ``order`` settles which trade is first and last; equal times need more than the time.
    """
    order = F.col("timestamp") if order is None else order
    price, size = F.col("trade_price"), F.col("size")
    out = trades.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(size).alias("volume"),
        F.count("*").alias("trade_count"),
        F.sum(price * size).alias("notional"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )
    return out.withColumn("vwap", F.col("notional") / F.col("volume"))


def first_of_each(trades: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``: the same one every time, unlike dropDuplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return trades.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def collisions(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and rows beyond the first of a key; a null key is one value."""
    each = trades.groupBy(*keys).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"))


def per_second(trades: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Trades of each symbol and second: volume, count, volume-weighted and plain mean price.

    Needs symbol, exchange_timestamp_ns, price and size. Local time decides session, day and year;
    all that depends on the second is derived from the group's key after the aggregation.
    """
    second = F.date_trunc("SECOND", market.utc_time(F.col("exchange_timestamp_ns")))
    out = trades.groupBy("symbol", second.alias("ts_second_utc")).agg(
        F.sum("size").alias("share_volume"), F.count("*").alias("trade_count"), F.sum(F.col("price") * F.col("size")).alias("dollar_volume"), F.avg("price").alias("mean_price")
    )
    local = F.from_utc_timestamp("ts_second_utc", zone)
    return out.withColumns(
        {
            "ts_second_ny": local,
            "session": market.session(local),
            "day": F.to_date(local),
            "year": F.year(local).cast("short"),
            "vwap": F.when(F.col("share_volume") > 0, F.col("dollar_volume") / F.col("share_volume")),
        }
    ).drop("dollar_volume")


def density(seconds: DataFrame) -> DataFrame:
    """One row: seconds with trades, symbols, and the share of all possible symbol-seconds of a day."""
    out = seconds.agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("vwap").alias("min_vwap"), F.max("vwap").alias("max_vwap"))
    return out.withColumn("density", F.when(F.col("symbols") > 0, F.round(F.col("rows") / (F.col("symbols") * 86400), 8)))
