"""Trades as a stream: duplicates, breaks, and per-second sums with a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeline.functions import market
from tapeline.sources.sinks import split_messages


def timed(messages: DataFrame, late: str) -> DataFrame:
    """Messages with their event time and a watermark; ``late`` is how long a message may be on its way."""
    return messages.withColumn("event_time", market.utc_time(F.col("timestamp"))).withWatermark("event_time", late)


def distinct_trades(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Confirmed trades, each (symbol, trade_id) once for as long as a repeat may come late."""
    price = market.wire_price(messages.columns)
    trades = timed(messages, late).withColumn("trade_price", price).filter(market.confirmed(F.col("trade_price")))
    return trades.dropDuplicatesWithinWatermark(["symbol", "trade_id"])


def without_breaks(trades: DataFrame, messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Trades for which no break came within ``late`` after them.

    A left join of two streams gives a trade out when its watermark has passed, so a break that
    comes later than that does not reach it; the batch path corrects the day.
    """
    # breaks are rare, so all messages move their watermark: a condition on the time is not pushed below it
    is_break = F.when(F.col("event_time").isNotNull(), F.col("type") == market.BREAK).otherwise(False)
    breaks = timed(messages, late).filter(is_break)
    breaks = breaks.select(F.col("symbol").alias("_symbol"), F.col("trade_id").alias("_trade_id"), F.col("event_time").alias("_time"))
    same = (F.col("symbol") == F.col("_symbol")) & (F.col("trade_id") == F.col("_trade_id"))
    near = F.col("_time").between(F.col("event_time"), F.col("event_time") + F.expr(f"interval {late}"))
    return trades.join(breaks, same & near, "leftOuter").filter("_symbol is null").drop("_symbol", "_trade_id", "_time")


def per_window(trades: DataFrame, size: str = "1 second", slide: str | None = None) -> DataFrame:
    """Volume, count and volume-weighted price of each symbol and window, tumbling or sliding."""
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    out = trades.groupBy(w.alias("w"), "symbol").agg(F.sum("size").alias("share_volume"), F.count("*").alias("trade_count"), F.sum(F.col("trade_price") * F.col("size")).alias("dollar_volume"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "symbol", "share_volume", "trade_count", F.try_divide("dollar_volume", "share_volume").alias("vwap"))


def bursts(trades: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Trades of each symbol without a pause of ``gap`` between them."""
    out = trades.groupBy(F.session_window("event_time", gap).alias("w"), "symbol").agg(F.count("*").alias("trade_count"), F.sum("size").alias("share_volume"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "symbol", "trade_count", "share_volume")


_LIFE = "symbol string, iex_first_seen string, iex_last_seen string, iex_seen_days int, iex_latest_issuer string, iex_issuer_variant_count int, iex_issuer_variants string"


def lifecycles(snapshots: DataFrame) -> DataFrame:
    """Each symbol's life so far, whenever snapshots add to it: a fold over a stream of symbol, snapshot_date and issuer.

    Snapshots may come late and more than once; a symbol's state holds its days and, of each, the
    issuer, which are as many as there are snapshots. The output mode is update.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        for batch in batches:
            for day, issuer in zip(batch["snapshot_date"], batch["issuer"], strict=True):
                seen[day] = max(seen.get(day) or "", issuer or "")
        days = sorted(seen)
        state.update((days, [seen[d] for d in days]))
        names = sorted({x for x in seen.values() if x})
        row = (key[0], days[0], days[-1], len(days), seen[days[-1]], len(names), " | ".join(names))
        yield pd.DataFrame([row], columns=[c.split()[0] for c in _LIFE.split(", ")])

    rows = snapshots.filter("symbol is not null and snapshot_date is not null").select("symbol", "snapshot_date", "issuer")
    return rows.groupBy("symbol").applyInPandasWithState(fold, _LIFE, "days array<string>, issuers array<string>", "update", GroupStateTimeout.NoTimeout)


def write_parts(messages: DataFrame, folder: str, checkpoint: str, write: Callable[[DataFrame, str], None] | None = None) -> StreamingQuery:
    """Main, quote and unknown messages of a stream, each batch in a folder of its own.

    A batch that is done again after a failure overwrites itself, so that every message stands once.
    """

    def one(batch: DataFrame, number: int) -> None:
        for rows, name in zip(split_messages(batch), ("main", "quote", "unknown"), strict=True):
            target = f"{folder}/{name}/batch={number}"
            if write:
                write(rows, target)
            else:
                rows.write.mode("overwrite").parquet(target)

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
