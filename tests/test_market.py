import pytest
from pyspark.sql import functions as F

from tapeline.functions import market
from tapeline.operators import bars, eras, panel

MESSAGES = "day string, type string, symbol string, timestamp long, size long, price double, price_int long, trade_id long"


def test_bars_open_and_close_by_time_and_integer_price(spark):
    rows = [
        ("20250102", "TradeReport", "AAA", 3, 10, 11.0, None, 1),
        ("20250102", "TradeReport", "AAA", 1, 20, 10.0, None, 2),
        ("20250102", "QuoteUpdate", "AAA", 0, 5, 99.0, None, 3),
        ("20250102", "TradeReport", "BBB", 2, 5, None, 250000, 4),
        ("20250102", "TradeReport", "CCC", 2, 0, 5.0, None, 5),
        ("20250102", "TradeReport", None, 2, 1, 5.0, None, 6),
    ]
    out = {r["symbol"]: r for r in bars.bars(bars.clean_trades(spark.createDataFrame(rows, MESSAGES)), ["day", "symbol"]).collect()}
    assert set(out) == {"AAA", "BBB"}
    a = out["AAA"]
    assert (a["open"], a["high"], a["low"], a["close"], a["volume"], a["trade_count"]) == (10.0, 11.0, 10.0, 11.0, 30, 2)
    assert out["BBB"]["open"] == 25.0


def test_trade_breaks_cancel_only_their_own_trade(spark):
    rows = [
        ("20250102", "TradeReport", "AAA", 1, 500, 99.0, None, 10),
        ("20250102", "TradeReport", "AAA", 2, 100, 1.0, None, 11),
        ("20250102", "TradeBreak", "AAA", 3, 100, 1.0, None, 11),
        ("20250103", "TradeReport", "AAA", 4, 7, 98.0, None, 11),
    ]
    out = bars.clean_trades(spark.createDataFrame(rows, MESSAGES)).orderBy("timestamp").collect()
    assert [(r["day"], r["size"]) for r in out] == [("20250102", 500), ("20250103", 7)]


def test_trades_outside_every_era_are_unmatched(spark):
    trades = spark.createDataFrame([("AAA", "20250102"), ("AAA", "20250110"), ("ZZZ", "20250102")], "symbol string, day string")
    era = spark.createDataFrame([("AAA", "AAA#001", "20250101", "20250105")], "symbol string, symbol_era_id string, first_day string, last_day string")
    out = {(r["symbol"], r["day"]): r["symbol_era_id"] for r in bars.in_eras(trades, era).collect()}
    assert out == {("AAA", "20250102"): "AAA#001", ("AAA", "20250110"): None, ("ZZZ", "20250102"): None}


def test_bars_of_no_trades(spark):
    assert bars.bars(bars.clean_trades(spark.createDataFrame([], MESSAGES)), ["day", "symbol"]).count() == 0


def test_first_of_each_and_collisions(spark):
    rows = spark.createDataFrame([("1", "A", 5), ("1", "A", 3), ("2", "A", 1), (None, "A", 1), (None, "A", 2)], "trade_id string, symbol string, ts long")
    kept = bars.first_of_each(rows, ["trade_id", "symbol"], [F.col("ts")]).collect()
    assert sorted((r["trade_id"] or "", r["ts"]) for r in kept) == [("", 1), ("1", 3), ("2", 1)]
    assert bars.collisions(rows, ["trade_id", "symbol"]).first().asDict() == {"rows": 5, "keys": 3, "collisions": 2}


@pytest.mark.parametrize(("clock", "label"), [("03:59:59", "unknown"), ("04:00:00", "pre"), ("09:29:59", "pre"), ("09:30:00", "regular"), ("15:59:59", "regular"), ("16:00:00", "after"), ("19:59:59", "after"), ("20:00:00", "unknown")])
def test_sessions(spark, clock, label):
    t = F.to_timestamp(F.lit(f"2025-01-02 {clock}"))
    assert spark.range(1).select(market.session(t)).first()[0] == label


def test_per_second_in_winter_and_summer(spark):
    winter, summer = 1_736_175_600_000_000_000, 1_751_900_400_123_456_789  # 2025-01-06 15:00 UTC, 2025-07-07 15:00 UTC
    rows = [("AAA", winter, 100, 10.0), ("AAA", winter + 999_999_999, 300, 12.0), ("AAA", summer, 0, 5.0)]
    out = bars.per_second(spark.createDataFrame(rows, "symbol string, exchange_timestamp_ns long, size long, price double")).orderBy("ts_second_utc").collect()
    assert [(r["share_volume"], r["trade_count"], r["vwap"], r["mean_price"], r["session"]) for r in out] == [(400, 2, 11.5, 11.0, "regular"), (0, 1, None, 5.0, "regular")]
    assert [r["ts_second_ny"].hour for r in out] == [10, 11]


def _days(spark, *days):
    return spark.createDataFrame([(s, d, 1, 1, 0, 0) for s, ds in days for d in ds], "symbol string, day string, main_rows long, trade_rows long, min_timestamp long, max_timestamp long")


def test_eras_split_at_gaps_of_more_than_two_weeks(spark):
    days = _days(spark, ("AAA", ["20250102", "20250103", "20250120"]), ("BBB", ["20250102", "20250116", "20250120"]))
    out = {r["symbol_era_id"]: r for r in eras.eras(days).collect()}
    assert set(out) == {"AAA#001", "AAA#002", "BBB#001"}
    assert (out["AAA#001"]["observed_days"], out["AAA#002"]["era_count"], out["AAA#002"]["split_from_symbol"]) == (2, 2, True)
    assert out["BBB#001"]["expected_days_in_era"] == 4
    gaps = eras.gap_list(days).collect()
    assert [(g["from_day"], g["to_day"], g["calendar_gap_days"]) for g in gaps] == [("20250103", "20250120", 17)]
    assert sum(r["observed_days"] for r in out.values()) == days.count()


def test_symbol_classes(spark):
    rows = [("d1", "d9", 1.0, 0), ("d1", "d9", 0.6, 1), ("d3", "d9", 1.0, 0), ("d1", "d5", 1.0, 0), ("d3", "d5", 1.0, 0), ("d3", "d5", 1.0, 2)]
    df = spark.createDataFrame([(*r, "d1", "d9") for r in rows], "first_day string, last_day string, coverage double, major_gap_count int, first_window_day string, last_window_day string")
    assert [r[0] for r in df.select(market.symbol_class()).collect()] == [
        "stable_candidate", "intermittent_full_window_candidate", "ipo_or_new_listing_candidate", "delisted_or_acquired_candidate", "partial_window_candidate", "intermittent_or_reused_candidate",
    ]


def test_session_reasons(spark):
    rows = [("20170826", 31497, 165), ("20250106", 9000, 0), ("20250107", 10000, 100), ("20250108", 657759, 657000), ("20250109", 0, 0)]
    df = spark.createDataFrame(rows, "day string, total_rows long, trade_rows long")
    assert [r[0] for r in df.select(market.session_reason()).collect()] == ["weekend_session", "no_trade_reports", "low_trade_share", None, "no_trade_reports"]


BAR = "day string, symbol string, symbol_era_id string, open double, high double, low double, close double, volume long, trade_count long, notional double, vwap double, first_timestamp long, last_timestamp long"


def _bar(day, close, symbol="AAA", low=None, high=None, notional=1000.0, volume=100):
    return (day, symbol, f"{symbol}#001", close, high or close, low or close, close, volume, 1, notional, close, 1, 2)


def test_quality_events_and_ohlc(spark):
    table = spark.createDataFrame([_bar("20250102", 10.0), _bar("20250103", 20.0, low=21.0, high=19.0, notional=50_000.0), _bar("20250102", 1.0, "ZZZ")], BAR)
    members = spark.createDataFrame([("AAA", "AAA#001", "active", 2)], "symbol string, symbol_era_id string, liquidity_tier string, expected_days_in_era long")
    flagged = panel.quality(table, members, multiple=1.5, floor=1000.0)
    events = panel.quality_events(flagged)
    got = {(r["day"], r["event_type"]) for r in events.collect()}
    assert got == {("20250103", "invalid_ohlc"), ("20250103", "extreme_return"), ("20250103", "notional_outlier")}
    by_symbol = panel.quality_by_symbol(flagged, members).first()
    assert (by_symbol["observed_trade_days"], by_symbol["quality_issue_days"], by_symbol["missing_trade_days"]) == (2, 3, 0)
    joined = panel.panel(table, members, events)
    assert {r["day"]: r["quality_has_event"] for r in joined.collect()} == {"20250102": False, "20250103": True}
    assert {r["mismatches"] for r in panel.flag_mismatches(joined, events).collect()} == {0}
    assert sum(r["mismatches"] for r in panel.flag_mismatches(joined, events.limit(0)).collect()) == 3


def test_null_prices_count_as_invalid(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0, 1.0)], "open double, high double, low double, close double")
    assert df.select(market.ohlc_invalid(), market.price_at_most(0.0)).first()[:] == (True, True)


def test_return_reasons(spark):
    rows = [("d1", 10.0, False), ("d2", 11.0, False), ("d3", 12.0, True), ("d4", 18.0, False), ("d5", 0.0, False), ("d6", 5.0, False)]
    df = spark.createDataFrame([("A#001", *r) for r in rows], "symbol_era_id string, day string, close double, quality_has_event boolean")
    out = panel.returns(df).orderBy("day").collect()
    assert [r["dirty_return_reason"] for r in out] == ["first_observation", None, "current_day_quality_event", "previous_day_quality_event", "nonpositive_close", "nonpositive_prev_close"]
    assert [r["potential_corporate_action"] for r in out] == [False, False, False, True, True, False]
    assert abs(out[1]["raw_close_return"] - 0.1) < 1e-12 and out[4]["log_close_return"] is None


def test_universe_tiers_and_nearest_rank(spark):
    era = spark.createDataFrame([(f"{s}#001", s, 2) for s in ("AAA", "BBB", "CCC")], "symbol_era_id string, symbol string, expected_days_in_era long")
    table = spark.createDataFrame([_bar(d, 10.0, s, notional=n) for d in ("20250102", "20250103") for s, n in (("AAA", 2e6), ("BBB", 2e5))], BAR)
    out = {r["symbol"]: r for r in panel.universe(era, table).collect()}
    assert {s: r["liquidity_tier"] for s, r in out.items()} == {"AAA": "core_liquid", "BBB": "active", "CCC": "no_confirmed_trades"}
    assert out["CCC"]["total_volume"] == 0 and out["CCC"]["median_daily_notional"] is None
    values = spark.createDataFrame([(float(x),) for x in range(1, 21)], "x double")
    assert values.agg(panel.nearest_rank("x", 0.1)).first()[0] == 3.0


def test_contract_metrics_count_duplicates(spark):
    table = spark.createDataFrame([_bar("20250102", 10.0), _bar("20250102", 10.0), _bar("20250103", -1.0)], BAR)
    m = panel.contract_metrics(table).first()
    assert (m["duplicate_key_rows"], m["nonpositive_price_rows"], m["row_count"]) == (1, 1, 3)


@pytest.mark.parametrize(("flags", "sale", "report"), [(0, None, "REGULAR_HOURS"), (0x20, "odd_lot", "REGULAR_HOURS|ODD_LOT"), (0xC0, "iso|extended_hours", "INTERMARKET_SWEEP|EXTENDED_HOURS")])
def test_sale_flags(spark, flags, sale, report):
    f = F.lit(flags)
    assert spark.range(1).select(market.sale_labels(f), market.report_labels(f)).first()[:] == (sale, report)
