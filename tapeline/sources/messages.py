"""Library messages (one wide row each, nulls where a type has no such field) to the main and quote layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline import schemas
from tapeline.functions import market

# Words for the letters of system events and trading states.
SYSTEM_EVENTS = {"O": "start_of_messages", "S": "start_of_system_hours", "R": "start_of_regular_hours", "M": "end_of_regular_hours", "E": "end_of_system_hours", "C": "end_of_messages"}
TRADING_STATES = {"H": "all_halted", "O": "iex_released", "P": "iex_paused", "T": "iex_trading"}

#: Which raw types fill each column of the main table, and with what; columns that are not named stay null.
_ONLY = {
    "flags": ("security_directive", "trade_report"),
    "round_lot_size": ("security_directive",),
    "luld_tier": ("security_directive",),
    "status": ("trading_status",),
    "reason": ("trading_status",),
    "retail_liquidity_indicator": ("retail_liquidity_indicator",),
    "halt_status": ("operational_halt",),
    "detail": ("short_sale_price_test_status",),
    "size": ("trade_report", "trade_break"),
    "trade_id": ("trade_report", "trade_break"),
    "price_type": ("official_price",),
}


def _words(letters: Column, words: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), letters)


def _layout(rows: DataFrame, columns: dict[str, Column], ddl: str) -> DataFrame:
    fields = [f.split() for f in ddl.split(", ")]
    return rows.select(*[(columns[n] if n in columns else F.lit(None)).cast(k).alias(n) for n, k in fields])


def normalized(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main and quote rows of messages whose ``type`` is the library's name; a missing column counts as null.

    Prices are decimal here; the integer ones are made of them, rounded half up.
    """
    have = set(messages.columns)
    raw = lambda name: F.col(name) if name in have else F.lit(None)
    kind = F.col("type")
    only = lambda types, value: F.when(kind.isin(*types), value)
    named = {"type": F.coalesce(_words(kind, market.MESSAGE_TYPES), kind), "timestamp": raw("timestamp"), "symbol": F.nullif(F.trim(raw("symbol").cast("string")), F.lit(""))}
    as_int = lambda c: F.round(c.cast("double") * schemas.PRICE_SCALE).cast("long")
    main = named | {c: only(types, raw(c)) for c, types in _ONLY.items()}
    main["luld_tire"] = main.pop("luld_tier")
    event, close = raw("event").cast("string"), raw("adjusted_poc_close")
    main |= {
        "system_event": only(("system_event",), F.ascii(event)),
        "system_event_str": only(("system_event",), _words(event, SYSTEM_EVENTS)),
        "adjusted_poc_close": only(("security_directive",), close),
        "trading_status_message": only(("trading_status",), _words(raw("status").cast("string"), TRADING_STATES)),
        "short_sale_status": only(("short_sale_price_test_status",), raw("status").cast("string").try_cast("double")),
        "price": F.when(kind == "security_directive", close.cast("double") / schemas.PRICE_SCALE)
        .when(kind.isin("trade_report", "trade_break", "official_price"), raw("price").cast("double"))
        .when(kind == "auction_information", raw("reference_price").cast("double")),
        "price_int": only(("trade_report", "trade_break"), as_int(raw("price"))),
        "sale_flags": only(("trade_report", "trade_break"), market.sale_labels(raw("flags").cast("int"))),
    }
    quote = named | {c: raw(c) for c in ("flags", "bid_size", "ask_size", "bid_price", "ask_price")} | {f"{s}_price_int": as_int(raw(f"{s}_price")) for s in ("bid", "ask")}
    is_quote = kind == "quote_update"
    return _layout(messages.filter(~is_quote), main, schemas.MAIN), _layout(messages.filter(is_quote), quote, schemas.QUOTE)
