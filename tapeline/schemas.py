"""Column layouts, as DDL, of the tables that readers and writers agree on."""

from __future__ import annotations

#: Every message but quotes, one nullable column per field of any type; times are nanoseconds.
MAIN = (
    "type string, timestamp bigint, symbol string, system_event double, system_event_str string, flags int, round_lot_size bigint, "
    "adjusted_poc_close double, luld_tire int, price double, status string, reason string, trading_status_message string, "
    "retail_liquidity_indicator string, halt_status string, short_sale_status double, detail string, size bigint, price_int bigint, "
    "trade_id bigint, price_type string, sale_flags string"
)
QUOTE = ("type string, timestamp bigint, symbol string, flags int, bid_size bigint, bid_price_int bigint, ask_price_int bigint, ask_size bigint, bid_price double, ask_price double")
BAR = ("day string, symbol string, symbol_era_id string, open double, high double, low double, close double, volume bigint, trade_count bigint, notional double, vwap double, first_timestamp bigint, last_timestamp bigint")
TRADE_CSV = ("exchange_timestamp_ns bigint, symbol string, size bigint, price double, trade_id string, sale_condition string")
FACT = ("fact_id string, record_type string, symbol string, symbol_era_id string, verification_state string, flags array<string>, created_at string, payload string")

#: Wire prices are integers of this many to one.
PRICE_SCALE = 10_000
