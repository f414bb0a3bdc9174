"""Queries on trades, bars, eras, universe, panel and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import market
from tapeline.operators import bars, eras, panel
from tapeline.plans.registry import Inputs, near, query


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: near(c, digits) for c in columns})


_BAR = "near(open, 4) AS open, near(high, 4) AS high, near(low, 4) AS low, near(close, 4) AS close, CAST(volume AS BIGINT) AS volume, trade_count, near(notional, 4) AS notional, near(vwap, 4) AS vwap, first_timestamp, last_timestamp"
_BAR_COLUMNS = ("open", "high", "low", "close", "notional", "vwap")


@query(
    f"SELECT day, symbol, {_BAR} FROM (SELECT day, symbol, arg_min(tp, seq) AS open, max(tp) AS high, min(tp) AS low, arg_max(tp, seq) AS close, sum(size) AS volume, count(*) AS trade_count, sum(tp * size) AS notional, sum(tp * size) / sum(size) AS vwap, min(ts) AS first_timestamp, max(ts) AS last_timestamp FROM trades GROUP BY day, symbol)",
    "trades",
)
def daily_bars(t: Inputs) -> DataFrame:
    return _rounded(bars.bars(t.trades, ["day", "symbol"], t.order), *_BAR_COLUMNS)


@query(f"SELECT day, symbol, symbol_era_id, {_BAR} FROM bars", "bars")
def daily_bars_by_era(t: Inputs) -> DataFrame:
    return _rounded(t.bars, *_BAR_COLUMNS)


@query("SELECT substr(t.day, 1, 4) AS year, count(*) AS trade_rows, count(*) FILTER (e.symbol IS NULL) AS unmatched FROM trades t LEFT JOIN (SELECT * FROM eras WHERE observed_days > 2) e ON t.symbol = e.symbol AND t.day BETWEEN e.first_day AND e.last_day GROUP BY 1", "trades", "eras")
def unmatched_trades(t: Inputs) -> DataFrame:
    joined = bars.in_eras(t.trades, t.eras.filter("observed_days > 2"))
    return joined.groupBy(F.substring("day", 1, 4).alias("year")).agg(F.count("*").alias("trade_rows"), F.count_if(F.col("symbol_era_id").isNull()).alias("unmatched"))


@query("SELECT day, count(*) AS breaks FROM messages WHERE type = 'TradeBreak' GROUP BY day", "messages")
def trade_breaks(t: Inputs) -> DataFrame:
    return t.messages.filter(F.col("type") == market.BREAK).groupBy("day").agg(F.count("*").alias("breaks"))


@query("SELECT trade_id, symbol, ts AS timestamp, size FROM (SELECT *, row_number() OVER (PARTITION BY trade_id, symbol ORDER BY ts, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM messages) WHERE k = 1", "messages")
def trade_dedupe(t: Inputs) -> DataFrame:
    return bars.first_of_each(t.messages, ["trade_id", "symbol"], [F.col("timestamp"), F.col("line")]).select("trade_id", "symbol", "timestamp", "size")


@query("SELECT sum(n) AS rows, count(*) AS keys, sum(n - 1) AS collisions FROM (SELECT count(*) AS n FROM messages GROUP BY trade_id)", "messages")
def trade_collisions(t: Inputs) -> DataFrame:
    return bars.collisions(t.messages, ["trade_id"])


_SECONDS = """(SELECT symbol, date_trunc('second', ts) AS s, sum(size) AS v, count(*) AS n, sum(price * size) AS d, avg(price) AS m FROM ({0}) GROUP BY 1, 2)"""
_EVENT_TRADES = "SELECT 'U' || (user_id % 5) AS symbol, CAST(to_timestamp(CAST(floor(epoch(ts) / 600) AS BIGINT) * 600) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts, event_id % 7 + 1 AS size, value AS price FROM events WHERE event_type <> 'error'"
_LOCAL = "(s AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
_SESSION = f"CASE WHEN hour({_LOCAL}) * 60 + minute({_LOCAL}) < 240 THEN 'unknown' WHEN hour({_LOCAL}) * 60 + minute({_LOCAL}) < 570 THEN 'pre' WHEN hour({_LOCAL}) * 60 + minute({_LOCAL}) < 960 THEN 'regular' WHEN hour({_LOCAL}) * 60 + minute({_LOCAL}) < 1200 THEN 'after' ELSE 'unknown' END"


def _event_trades(t: Inputs) -> DataFrame:
    """Events as trades whose clock stands still for ten minutes, so that seconds hold several."""
    e = t.table("events").withColumn("condition", F.when(F.col("event_type") == "error", "ODD_LOT").otherwise(""))
    e = e.filter(market.not_odd_lot(F.col("condition")))
    second = F.floor(F.unix_seconds("ts") / 600) * 600
    return e.select(F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")).alias("symbol"), (second * 1_000_000_000).alias("exchange_timestamp_ns"), (F.col("event_id") % 7 + 1).alias("size"), F.col("value").alias("price"))


@query(
    f"SELECT symbol, CAST(s AS VARCHAR) AS ts_second_utc, CAST({_LOCAL} AS VARCHAR) AS ts_second_ny, {_SESSION} AS session, CAST(CAST({_LOCAL} AS DATE) AS VARCHAR) AS day, CAST(year({_LOCAL}) AS INTEGER) AS year, CAST(v AS BIGINT) AS share_volume, n AS trade_count, near(m, 4) AS mean_price, near(d / v, 4) AS vwap FROM {_SECONDS.format(_EVENT_TRADES)}"
)
def per_second(t: Inputs) -> DataFrame:
    out = bars.per_second(_event_trades(t))
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("ts_second_utc", "ts_second_ny")}
    return _rounded(out.withColumns(text | {"day": F.col("day").cast("string"), "year": F.col("year").cast("int")}), "mean_price", "vwap")


@query(f"SELECT session, count(*) AS seconds FROM (SELECT {_SESSION} AS session FROM {_SECONDS.format(_EVENT_TRADES)}) GROUP BY session")
def session_histogram(t: Inputs) -> DataFrame:
    return bars.per_second(_event_trades(t)).groupBy("session").agg(F.count("*").alias("seconds"))


@query(f"SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, near(min(d / v), 4) AS min_vwap, near(max(d / v), 4) AS max_vwap, round(count(*) / (count(DISTINCT symbol) * 86400), 8) AS density FROM {_SECONDS.format(_EVENT_TRADES)}")
def sparse_density(t: Inputs) -> DataFrame:
    return _rounded(bars.density(bars.per_second(_event_trades(t))), "min_vwap", "max_vwap")


@query("SELECT count(*) AS row_count, min(epoch_us(ts)) * 1000 AS min_ns, max(epoch_us(ts)) * 1000 AS max_ns FROM events")
def capture_stats(t: Inputs) -> DataFrame:
    ns = F.unix_micros("ts") * 1000
    return t.table("events").agg(F.count("*").alias("row_count"), F.min(ns).alias("min_ns"), F.max(ns).alias("max_ns"))


_EVENT_DAYS = "(SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS total_rows, count(*) FILTER (event_type = 'purchase') AS trade_rows FROM events GROUP BY 1)"


@query(
    f"SELECT *, CAST(trade_rows AS DOUBLE) / total_rows >= 0.2 AND reason IS NULL AS valid FROM (SELECT *, near(trade_rows / total_rows, 6) AS trade_share, CASE WHEN isodow(strptime(day, '%Y%m%d')) >= 6 THEN 'weekend_session' WHEN trade_rows = 0 THEN 'no_trade_reports' WHEN trade_rows / total_rows < 0.2 THEN 'low_trade_share' END AS reason FROM {_EVENT_DAYS})"
)
def session_validity(t: Inputs) -> DataFrame:
    days = t.table("events").groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count("*").alias("total_rows"), F.count_if(F.col("event_type") == "purchase").alias("trade_rows"))
    out = days.withColumn("reason", market.session_reason(0.2))
    return out.withColumns({"trade_share": near(F.col("trade_rows") / F.col("total_rows"), 6), "valid": F.col("reason").isNull()})


@query("SELECT event_type AS type, strftime(ts, '%Y%m%d') AS day, count(*) AS rows FROM events GROUP BY ALL")
def message_type_counts(t: Inputs) -> DataFrame:
    return t.table("events").groupBy(F.col("event_type").alias("type"), F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count("*").alias("rows"))


@query("SELECT symbol, day, main_rows, trade_rows, min_ts AS min_timestamp, max_ts AS max_timestamp FROM days", "days")
def symbol_day_summary(t: Inputs) -> DataFrame:
    return t.days


@query(
    """SELECT symbol, symbol_era_id, CAST(era_index AS BIGINT) AS era_index, era_count, source_classification, first_day, last_day, observed_days, expected_days_in_era,
    coverage_ratio, expected_days_in_era - observed_days AS missing_days_inside_era, CAST(main_rows AS BIGINT) AS main_rows, CAST(trade_rows AS BIGINT) AS trade_rows,
    min_ts AS min_timestamp, max_ts AS max_timestamp, era_count > 1 AS split_from_symbol,
    CASE WHEN era_count = 1 AND first_day = w0 AND last_day = w1 AND coverage_ratio >= 0.95 THEN 'long_window_candidate' ELSE 'point_in_time_era' END AS recommended_use,
    CASE WHEN era_count > 1 OR source_classification IN ('intermittent_full_window_candidate', 'intermittent_or_reused_candidate', 'partial_window_candidate')
    THEN 'needs_security_master' ELSE 'ticker_continuity_candidate' END AS identity_status FROM eras""",
    "eras",
)
def symbol_eras(t: Inputs) -> DataFrame:
    return t.eras.drop("first_window_day", "last_window_day").withColumn("era_index", F.col("era_index").cast("long"))


@query("SELECT symbol, from_day, day AS to_day, CAST(gap AS INTEGER) AS calendar_gap_days FROM gaps WHERE gap > 14", "gaps")
def symbol_gaps(t: Inputs) -> DataFrame:
    return eras.gap_list(t.days)


@query("SELECT symbol, first_day, last_day, observed_days, expected_days, CAST(largest_gap_days AS INTEGER) AS largest_gap_days, major_gap_count, near(coverage, 6) AS coverage, classification FROM symbols", "symbols")
def symbol_classification(t: Inputs) -> DataFrame:
    out = eras.symbols(t.days).withColumn("coverage", near("coverage", 6))
    return out.select("symbol", "first_day", "last_day", "observed_days", "expected_days", "largest_gap_days", "major_gap_count", "coverage", "classification")


@query(
    "SELECT symbol, symbol_era_id, traded_days, near(coverage, 6) AS trade_day_coverage_ratio, CAST(total_volume AS BIGINT) AS total_volume, near(total_notional, 3) AS total_notional, near(median_daily_notional, 4) AS median_daily_notional, near(p10_daily_notional, 4) AS p10_daily_notional, near(avg_daily_notional, 4) AS avg_daily_notional, median_daily_volume, near(first_close, 4) AS first_close, near(last_close, 4) AS last_close, near(min_close, 4) AS min_close, near(max_close, 4) AS max_close, liquidity_tier FROM universe",
    "universe",
)
def stable_universe(t: Inputs) -> DataFrame:
    out = t.universe.select("symbol", "symbol_era_id", "traded_days", "trade_day_coverage_ratio", "total_volume", "total_notional", "median_daily_notional", "p10_daily_notional", "avg_daily_notional", "median_daily_volume", "first_close", "last_close", "min_close", "max_close", "liquidity_tier")
    out = out.withColumns({"trade_day_coverage_ratio": near("trade_day_coverage_ratio", 6), "total_notional": near("total_notional", 3)})
    return _rounded(out, "median_daily_notional", "p10_daily_notional", "avg_daily_notional", "first_close", "last_close", "min_close", "max_close")


_FLAGS = ", ".join(market.QUALITY_EVENTS)


@query(f"SELECT day, symbol_era_id, near(prev_close, 4) AS prev_close, near(ret, 6) AS raw_close_return, near(mn, 4) AS median_notional_by_symbol, mv AS median_volume_by_symbol, {_FLAGS} FROM flagged", "flagged")
def quality_daily(t: Inputs) -> DataFrame:
    out = t.flagged.select("day", "symbol_era_id", "prev_close", "raw_close_return", "median_notional_by_symbol", "median_volume_by_symbol", *market.QUALITY_EVENTS)
    return _rounded(_rounded(out, "prev_close", "median_notional_by_symbol"), "raw_close_return", digits=6)


@query(" UNION ALL ".join(f"SELECT day, symbol, symbol_era_id, liquidity_tier, '{e}' AS event_type, near(close, 4) AS close FROM flagged WHERE {e}" for e in market.QUALITY_EVENTS), "flagged")
def quality_events(t: Inputs) -> DataFrame:
    return _rounded(panel.quality_events(t.flagged).select("day", "symbol", "symbol_era_id", "liquidity_tier", "event_type", "close"), "close")


@query(
    "SELECT u.symbol, u.symbol_era_id, coalesce(o, 0) AS observed_trade_days, "
    + ", ".join(f"{e}_days" for e in market.QUALITY_EVENTS)
    + ", near(lo, 6) AS min_raw_close_return, near(hi, 6) AS max_raw_close_return, u.expected_days_in_era - coalesce(o, 0) AS missing_trade_days, "
    + " + ".join(f"coalesce({e}_days, 0)" for e in market.QUALITY_EVENTS)
    + " + u.expected_days_in_era - coalesce(o, 0) AS quality_issue_days FROM universe u LEFT JOIN (SELECT symbol_era_id, count(DISTINCT day) AS o, min(ret) AS lo, max(ret) AS hi, "
    + ", ".join(f"count(*) FILTER ({e}) AS {e}_days" for e in market.QUALITY_EVENTS)
    + " FROM flagged GROUP BY symbol_era_id) USING (symbol_era_id)",
    "flagged",
)
def quality_by_symbol(t: Inputs) -> DataFrame:
    out = panel.quality_by_symbol(t.flagged, t.universe)
    out = out.select("symbol", "symbol_era_id", "observed_trade_days", *[f"{e}_days" for e in market.QUALITY_EVENTS], "min_raw_close_return", "max_raw_close_return", "missing_trade_days", "quality_issue_days")
    return _rounded(out, "min_raw_close_return", "max_raw_close_return", digits=6)


_PANEL = ", ".join(f"quality_{e}" for e in market.QUALITY_EVENTS) + ", quality_has_event"


@query(f"SELECT day, symbol, symbol_era_id, liquidity_tier, near(close, 4) AS close, CAST(volume AS BIGINT) AS volume, {_PANEL} FROM panel", "panel")
def daily_panel(t: Inputs) -> DataFrame:
    return _rounded(t.panel.select("day", "symbol", "symbol_era_id", "liquidity_tier", "close", "volume", *_PANEL.split(", ")), "close")


@query(" UNION ALL ".join(f"SELECT 'quality_{e}' AS flag, {'count(*) FILTER (extreme_return)' if e == 'extreme_return' else 'count(*) FILTER (false)'} AS mismatches FROM flagged" for e in market.QUALITY_EVENTS), "flagged")
def panel_flag_mismatches(t: Inputs) -> DataFrame:
    events = panel.quality_events(t.flagged)
    return panel.flag_mismatches(t.panel, events.filter("event_type <> 'extreme_return'"))


@query(
    """SELECT count(*) AS row_count, count(DISTINCT symbol_era_id) AS symbol_era_count, count(*) FILTER (invalid_ohlc) AS invalid_ohlc_rows,
    count(*) FILTER (nonpositive_price OR vwap <= 0) AS nonpositive_price_rows, count(*) FILTER (volume <= 0) AS nonpositive_volume_rows,
    count(*) FILTER (trade_count <= 0) AS nonpositive_count_rows, count(*) FILTER (notional <= 0) AS nonpositive_notional_rows,
    count(*) FILTER (last_timestamp < first_timestamp) AS reversed_time_rows, count(*) - count(DISTINCT (day, symbol_era_id)) AS duplicate_key_rows FROM panel""",
    "panel",
)
def panel_contract(t: Inputs) -> DataFrame:
    return panel.contract_metrics(t.panel)


@query("SELECT 'price' AS \"column\", count(*) FILTER (price IS NULL) AS null_count FROM messages UNION ALL SELECT 'price_int', count(*) FILTER (price_int IS NULL) FROM messages UNION ALL SELECT 'symbol', count(*) FILTER (symbol IS NULL) FROM messages", "messages")
def null_counts(t: Inputs) -> DataFrame:
    return panel.null_counts(t.messages, ["price", "price_int", "symbol"])


@query("SELECT substr(day, 1, 4) AS year, liquidity_tier, count(*) AS rows, count(DISTINCT symbol_era_id) AS eras, near(sum(notional), 2) AS notional FROM panel GROUP BY 1, 2", "panel")
def year_tier_coverage(t: Inputs) -> DataFrame:
    out = t.panel.groupBy(F.substring("day", 1, 4).alias("year"), "liquidity_tier").agg(F.count("*").alias("rows"), F.count_distinct("symbol_era_id").alias("eras"), F.sum("notional").alias("notional"))
    return _rounded(out, "notional", digits=2)


@query("SELECT symbol_era_id, count(DISTINCT day) AS panel_days, min(day) AS first_panel_day, max(day) AS last_panel_day, near(count(DISTINCT day) / min(expected_days_in_era), 6) AS coverage FROM panel GROUP BY symbol_era_id", "panel")
def era_coverage(t: Inputs) -> DataFrame:
    out = t.panel.groupBy("symbol_era_id").agg(F.count_distinct("day").alias("panel_days"), F.min("day").alias("first_panel_day"), F.max("day").alias("last_panel_day"), F.min("expected_days_in_era").alias("expected"))
    return out.withColumn("coverage", near(F.col("panel_days") / F.col("expected"), 6)).drop("expected")


@query(
    "SELECT day, symbol_era_id, prev_day, near(close, 4) AS close, near(pc, 4) AS prev_close, near(raw, 6) AS raw_close_return, near(CASE WHEN raw > -1 THEN ln(1 + raw) END, 6) AS log_close_return, coalesce(abs(raw) >= 0.45, false) AS potential_corporate_action, dirty_return_reason, dirty_return_reason IS NULL AS is_clean_return_day FROM returns",
    "returns",
)
def daily_returns(t: Inputs) -> DataFrame:
    out = panel.returns(t.panel).select("day", "symbol_era_id", "prev_day", "close", "prev_close", "raw_close_return", "log_close_return", "potential_corporate_action", "dirty_return_reason", "is_clean_return_day")
    return _rounded(_rounded(out, "close", "prev_close"), "raw_close_return", "log_close_return", digits=6)


@query("SELECT count(*) AS row_count, count(DISTINCT symbol_era_id) AS symbol_era_count, min(day) AS first_day, max(day) AS last_day, count(raw) AS return_observation_count, count(*) FILTER (dirty_return_reason IS NULL) AS clean_return_count, count(dirty_return_reason) AS dirty_return_count FROM returns", "returns")
def returns_summary(t: Inputs) -> DataFrame:
    return panel.returns(t.panel).agg(
        F.count("*").alias("row_count"),
        F.count_distinct("symbol_era_id").alias("symbol_era_count"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("raw_close_return").alias("return_observation_count"),
        F.count_if("is_clean_return_day").alias("clean_return_count"),
        F.count_if(~F.col("is_clean_return_day")).alias("dirty_return_count"),
    )


@query("SELECT coalesce(dirty_return_reason, 'clean') AS reason, count(*) AS rows FROM returns GROUP BY 1", "returns")
def dirty_reason_counts(t: Inputs) -> DataFrame:
    return panel.returns(t.panel).groupBy(F.coalesce("dirty_return_reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("rows"))


@query("SELECT symbol_era_id, near(median_daily_notional, 4) AS median_daily_notional FROM universe ORDER BY median_daily_notional DESC NULLS FIRST, symbol_era_id LIMIT 25", "universe")
def top_universe(t: Inputs) -> DataFrame:
    return t.universe.orderBy(F.desc_nulls_first("median_daily_notional"), "symbol_era_id").limit(25).select("symbol_era_id", near("median_daily_notional", 4).alias("median_daily_notional"))
