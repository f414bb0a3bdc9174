"""Column expressions of the market-data tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeline.schemas import PRICE_SCALE

TRADE, BREAK = "TradeReport", "TradeBreak"

# Bits of the sale-condition byte and their labels, in the order in which they are written.
SALE_BITS = ((0x80, "iso"), (0x40, "extended_hours"), (0x20, "odd_lot"), (0x10, "trade_through_exempt"), (0x08, "single_price_cross"))
REPORT_BITS = ((0x80, "INTERMARKET_SWEEP"), (0x40, "EXTENDED_HOURS"), (0x20, "ODD_LOT"), (0x10, "TRADE_THROUGH_EXEMPT"), (0x08, "SINGLE_PRICE_CROSS"))
MESSAGE_TYPES = {
    "system_event": "SystemEvent",
    "security_directive": "SecurityDirective",
    "trading_status": "TradingStatus",
    "retail_liquidity_indicator": "RetailLiquidity",
    "operational_halt": "OperationalHalt",
    "short_sale_price_test_status": "ShortSalePriceSale",
    "quote_update": "QuoteUpdate",
    "trade_report": "TradeReport",
    "official_price": "OfficialPrice",
    "trade_break": "TradeBreak",
    "auction_information": "AuctionInformation",
}
QUALITY_EVENTS = ("invalid_ohlc", "nonpositive_price", "near_zero_price", "extreme_return", "notional_outlier", "volume_outlier")


def wire_price(columns: list[str]) -> Column:
    """The float price, or the integer one scaled down, whichever the table has."""
    made = [F.col("price").cast("double")] * ("price" in columns) + [F.col("price_int") / float(PRICE_SCALE)] * ("price_int" in columns)
    if not made:
        raise ValueError("neither price nor price_int")
    return F.coalesce(*made)


def confirmed(price: Column) -> Column:
    """A trade report with a symbol, a time, and positive size and price."""
    present = F.col("symbol").isNotNull() & F.col("timestamp").isNotNull()
    return (F.col("type") == TRADE) & present & (F.col("size") > 0) & (price > 0)


def session(local: Column) -> Column:
    """Trading session of a local clock time; outside 04:00 to 20:00 it is unknown."""
    minute = F.hour(local) * 60 + F.minute(local)
    return F.when(minute < 240, "unknown").when(minute < 570, "pre").when(minute < 960, "regular").when(minute < 1200, "after").otherwise("unknown")


def utc_time(nanoseconds: Column) -> Column:
    """Timestamp of a count of nanoseconds, cut to microseconds."""
    return F.timestamp_micros(F.call_function("div", nanoseconds, F.lit(1000)))


def not_odd_lot(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit("")).contains("ODD_LOT")


def sale_labels(flags: Column) -> Column:
    """Lower-case labels of the set bits, joined by bars; null without one."""
    text = F.concat_ws("|", *[F.when(flags.bitwiseAND(F.lit(b)) != 0, label) for b, label in SALE_BITS])
    return F.when(text != "", text)


def report_labels(flags: Column) -> Column:
    """Upper-case labels; a trade outside extended hours is one of regular hours."""
    parts = []
    for b, label in REPORT_BITS:
        is_set = flags.bitwiseAND(F.lit(b)) != 0
        parts.append(F.when(is_set, label).otherwise("REGULAR_HOURS") if b == 0x40 else F.when(is_set, label))
    return F.concat_ws("|", *parts)


def ohlc_invalid() -> Column:
    """High below low, or open or close outside them; true where any is null."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return F.coalesce((h < lo) | ~o.between(lo, h) | ~c.between(lo, h), F.lit(True))


def price_at_most(bound: float, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> Column:
    """Whether any price is at or below the bound; true where that can't be told."""
    return F.coalesce(reduce(or_, [F.col(c) <= bound for c in columns]), F.lit(True))


def notional_outlier(multiple: float, floor: float) -> Column:
    return F.coalesce(F.col("notional") > F.greatest(F.col("median_notional_by_symbol") * multiple, F.lit(floor)), F.lit(False))


def volume_outlier(multiple: float) -> Column:
    return F.coalesce(F.col("volume") > F.col("median_volume_by_symbol") * multiple, F.lit(False))


def close_return() -> Column:
    return F.when(F.col("prev_close") > 0, F.col("close") / F.col("prev_close") - 1.0)


def dirty_reason() -> Column:
    """Why a return can't be trusted, the first that holds; null for a clean one."""
    rules = (
        (F.col("prev_close").isNull(), "first_observation"),
        (F.col("prev_close") <= 0, "nonpositive_prev_close"),
        (F.col("close") <= 0, "nonpositive_close"),
        (F.coalesce("prev_quality_has_event", F.lit(False)), "previous_day_quality_event"),
        (F.col("quality_has_event"), "current_day_quality_event"),
    )
    return F.coalesce(*[F.when(condition, reason) for condition, reason in rules])


def liquidity_tier(coverage: float = 0.95, core: float = 1e6, active: float = 1e5) -> Column:
    covered = F.col("trade_day_coverage_ratio") >= coverage
    median = F.coalesce("median_daily_notional", F.lit(0.0))
    return F.when(F.col("traded_days") == 0, "no_confirmed_trades").when(covered & (median >= core), "core_liquid").when(covered & (median >= active), "active").otherwise("thin")


def session_reason(least_share: float = 0.05) -> Column:
    """Why a day's capture is not a valid session; null for a valid one. Needs day, total_rows, trade_rows."""
    share = F.when(F.col("total_rows") > 0, F.col("trade_rows") / F.col("total_rows")).otherwise(0.0)
    weekend = F.weekday(F.to_date("day", "yyyyMMdd")) >= 5
    return F.when(weekend, "weekend_session").when(F.col("trade_rows") == 0, "no_trade_reports").when(share < least_share, "low_trade_share")


def symbol_class(least_coverage: float = 0.95) -> Column:
    """Continuity class of a symbol from its first and last day, the window's, coverage and gaps."""
    starts, ends = F.col("first_day") == F.col("first_window_day"), F.col("last_day") == F.col("last_window_day")
    gaps = F.col("major_gap_count") > 0
    return (
        F.when(starts & ends & (F.col("coverage") >= least_coverage) & ~gaps, "stable_candidate")
        .when(starts & ends, "intermittent_full_window_candidate")
        .when(gaps, "intermittent_or_reused_candidate")
        .when(ends & ~starts, "ipo_or_new_listing_candidate")
        .when(starts & ~ends, "delisted_or_acquired_candidate")
        .otherwise("partial_window_candidate")
    )


def recommended_use(least_coverage: float = 0.95) -> Column:
    whole = (F.col("first_day") == F.col("first_window_day")) & (F.col("last_day") == F.col("last_window_day"))
    return F.when((F.col("era_count") == 1) & whole & (F.col("coverage_ratio") >= least_coverage), "long_window_candidate").otherwise("point_in_time_era")


def identity_status() -> Column:
    risky = F.col("source_classification").isin("intermittent_full_window_candidate", "intermittent_or_reused_candidate", "partial_window_candidate")
    return F.when((F.col("era_count") > 1) | risky, "needs_security_master").otherwise("ticker_continuity_candidate")
