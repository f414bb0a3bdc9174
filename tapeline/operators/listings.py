"""Daily listing snapshots: lifecycles, differences, and what they say of eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import classify

FIELDS = ("issuer", "is_enabled", "lit")


def valid_snapshots(rows: DataFrame, least: int = 1000) -> DataFrame:
    """Rows of snapshots that hold at least ``least`` listings; a smaller file is a broken one."""
    sizes = rows.groupBy("snapshot_date").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return rows.join(sizes.select("snapshot_date"), "snapshot_date", "left_semi")


def invalid_snapshots(rows: DataFrame, least: int = 1000) -> DataFrame:
    """snapshot_date and size of the snapshots that ``valid_snapshots`` leaves out."""
    return rows.groupBy("snapshot_date").agg(F.count("*").alias("rows")).filter(F.col("rows") < least)


def lifecycle(rows: DataFrame) -> DataFrame:
    """One row per symbol: when it was seen, its latest attributes, and its issuer's spellings."""
    latest = rows.agg(F.max("snapshot_date").alias("iex_latest_snapshot"))
    names = F.array_sort(F.collect_set(F.when(F.col("issuer") != "", F.col("issuer"))))
    out = rows.groupBy("symbol").agg(
        F.min("snapshot_date").alias("iex_first_seen"),
        F.max("snapshot_date").alias("iex_last_seen"),
        F.count_distinct("snapshot_date").alias("iex_seen_days"),
        F.max_by("issuer", "snapshot_date").alias("iex_latest_issuer"),
        F.max_by("is_enabled", "snapshot_date").alias("iex_latest_is_enabled"),
        F.max_by("lit", "snapshot_date").alias("iex_latest_lit"),
        names.alias("_names"),
    )
    out = out.crossJoin(F.broadcast(latest))  # one row
    return out.withColumns(
        {
            "iex_product_hint": classify.product_hint(F.col("iex_latest_issuer")),
            "iex_issuer_variant_count": F.size("_names"),
            "iex_issuer_variants": F.concat_ws(" | ", "_names"),
            "iex_seen_in_latest": F.col("iex_last_seen") == F.col("iex_latest_snapshot"),
            "iex_removed_after_seen": F.col("iex_last_seen") != F.col("iex_latest_snapshot"),
        }
    ).drop("_names")


def enrich_eras(eras: DataFrame, lifecycles: DataFrame, first: str, last: str) -> DataFrame:
    """Eras with their symbol's lifecycle and how far it bears on them."""
    return eras.join(lifecycles, "symbol", "left").withColumn("iex_entity_confidence", classify.listing_confidence(first, last))


def differences(rows: DataFrame) -> DataFrame:
    """What was added, removed or changed between each snapshot and the next.

    Snapshots are numbered, and each row stands once for its own snapshot and once, as the row
    before, for the next: one full join on (number, symbol).
    """
    dates = rows.select("snapshot_date").distinct().withColumn("_k", F.row_number().over(Window.orderBy("snapshot_date")))
    steps = dates.select("_k", F.col("snapshot_date").alias("to_snapshot"), F.lag("snapshot_date").over(Window.orderBy("_k")).alias("from_snapshot")).filter("_k > 1")
    numbered = rows.join(dates, "snapshot_date")
    new = numbered.select("_k", "symbol", F.struct(*FIELDS).alias("new"))
    old = numbered.select((F.col("_k") + 1).alias("_k"), "symbol", F.struct(*FIELDS).alias("old"))
    both = old.join(new, ["_k", "symbol"], "full").join(F.broadcast(steps), "_k")
    differing = [F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in FIELDS]
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    changed = F.when(kind == "changed", F.concat_ws(",", *differing))
    return both.select("from_snapshot", "to_snapshot", "symbol", kind.alias("event_type"), changed.alias("change_fields"), F.col("old.issuer").alias("old_issuer"), F.col("new.issuer").alias("new_issuer")).filter("event_type is not null")


def daily_changes(rows: DataFrame) -> DataFrame:
    """Counts of each step between snapshots."""
    sizes = rows.groupBy("snapshot_date").agg(F.count("*").alias("n"))
    steps = sizes.select(F.lag("snapshot_date").over(Window.orderBy("snapshot_date")).alias("from_snapshot"), F.col("snapshot_date").alias("to_snapshot"), F.lag("n").over(Window.orderBy("snapshot_date")).alias("from_count"), F.col("n").alias("to_count")).filter("from_snapshot is not null")
    events = differences(rows).groupBy("to_snapshot").agg(*[F.count_if(F.col("event_type") == k).alias(f"{k}_count") for k in ("added", "removed", "changed")])
    out = steps.join(events, "to_snapshot", "left").fillna(0, ["added_count", "removed_count", "changed_count"])
    return out.withColumn("net_count_change", F.col("to_count") - F.col("from_count"))


def registry_lookup(rows: DataFrame, key: Column) -> DataFrame:
    """Registry rows by symbol key: how many, the least of each column, and all tickers."""
    columns = ("sec_cik", "sec_name", "sec_ticker", "sec_exchange")
    return rows.groupBy(key.alias("sec_symbol_key")).agg(F.count("*").alias("sec_match_count"), *[F.min(c).alias(c) for c in columns], F.concat_ws(" | ", F.sort_array(F.collect_list("sec_ticker"))).alias("sec_ticker_variants"))
