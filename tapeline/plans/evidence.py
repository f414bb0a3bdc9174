"""Queries on texts of filings, normalized messages, migrations and composed worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import classify, evidence
from tapeline.operators import facts, filings, worklists
from tapeline.plans import book as b
from tapeline.plans.registry import Inputs, query
from tapeline.sources import messages

_VERIFIED = [
    "Acme Foods completed the merger on {d}. The stock was delisted from NYSE.", "The deal is expected to close on {d}; Acme Foods will be delisted.", "Nothing happened on {d}.", "Shares ceased trading on {d} (NYSE: ABC).",
    "Zeta Corp consummated the merger. Much later, on {d}, it said so (NYSE: XYZ).", "Acme Foods began trading under the symbol ABC on {d}.",
]
_ISSUERS = ["Acme Foods Inc", "Zeta Corp", "ABC", ""]


def _filings(t: Inputs) -> DataFrame:
    """Orders as short filings."""
    k, o = F.col("o_orderkey"), t.table("orders")
    text = F.replace(b.pick(_VERIFIED, k), F.lit("{d}"), F.date_format("o_orderdate", "MMMM d, yyyy"))
    return o.select(k, text.alias("text"), b.pick(_ISSUERS, F.floor(k / 6)).alias("issuer"), b.pick(["ABC", "XYZ"], F.floor(k / 24)).alias("symbol"), b.pick(["8-K", "SC 13E3"], F.floor(k / 48)).alias("form"))


_PLAIN = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"
_DAY = "strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y')"


def _any(words: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({words}, '{p.upper()}')" for p in phrases) + ")"


def _issuer_named(issuer: str, words: str) -> str:
    tokens = f"list_filter(string_split({_PLAIN.format(issuer)}, ' '), lambda k: length(k) >= 4)"
    return f"(len({tokens}) > 0 AND len(list_filter({tokens}, lambda k: contains({words}, k))) >= least(2, len({tokens})))"


@query(
    f"""SELECT o_orderkey, v AS score, CASE WHEN v >= 70 AND (i OR s) AND (terminal OR completion) THEN 'strong_review_candidate' WHEN v >= 45 AND (terminal OR completion) THEN 'moderate_review_candidate' ELSE 'weak_review_candidate' END AS bucket
    FROM (SELECT *, CAST(20 * i::INT + 10 * s::INT + 25 * terminal::INT + 35 * completion::INT + 25 * delisting::INT + 15 * (form = 'SC 13E3')::INT AS INTEGER) AS v FROM (SELECT o_orderkey, form,
    {_issuer_named("issuer", "w")} AS i, contains(' ' || w || ' ', ' ' || symbol || ' ') AS s, {_any("w", evidence.TERMINAL)} AS terminal, {_any("w", evidence.COMPLETION)} AS completion, {_any("w", evidence.DELISTING)} AS delisting
    FROM (SELECT *, {_PLAIN.format("text")} AS w FROM (SELECT o_orderkey, replace({b.sql_pick(_VERIFIED, "o_orderkey")}, '{{d}}', {_DAY}) AS text, {b.sql_pick(_ISSUERS, "o_orderkey // 6")} AS issuer,
    {b.sql_pick(["ABC", "XYZ"], "o_orderkey // 24")} AS symbol, {b.sql_pick(["8-K", "SC 13E3"], "o_orderkey // 48")} AS form FROM orders))))"""
)
def verifier_review(t: Inputs) -> DataFrame:
    rows = _filings(t).withColumn("flags", evidence.verifier_flags(F.col("issuer"), F.col("symbol"), F.col("form"), F.col("text")))
    return rows.select("o_orderkey", evidence.score(F.col("flags"), evidence.VERIFIER_WEIGHTS).alias("score"), evidence.verifier_bucket(F.col("flags")).alias("bucket"))


_FILL = "and more of what fills a filing without any bearing on it " * 7
#: Every phrase of either review, in texts with one or two places that may hold proof, of which the second is out of the first one's reach.
_PHRASES = sorted({*evidence.TERMINAL, *evidence.ACTUAL, *evidence.PROSPECTIVE, *evidence.FIRST_DAY, *evidence.LIFECYCLE_PROSPECTIVE})
_FRAMES = [
    "Acme Foods {p} on {d}.", "On {d}, {p}: Acme Foods. " + _FILL + "Acme Foods common stock, ticker ABC, was delisted.", "Zeta Corp, symbol XYZ, {p}. " + _FILL + "It commenced trading, then suspended from trading, on {d}.", "Zeta Corp (ABC) {p}; see {d}.", "{d}: {p}. ABC shares of Acme Foods.", "Acme {p}.",
]
_ENTITIES = ["ACME FOODS INC (ABC) (CIK 1)", "", "ZETA CORP (XYZ, ABCD) (CIK 2)", None, "ABC INC", "ACME (CIK 4)"]
_NAMED = ["Acme Foods Inc", "Zeta Corp", "ABC", "", "ACME"]


def _reviewed(t: Inputs) -> DataFrame:
    """Orders as filings on an era whose first and last day lie up to 19 days away."""
    k, o = F.col("o_orderkey"), t.table("orders")
    text = F.replace(F.replace(b.pick(_FRAMES, F.floor(k / len(_PHRASES))), F.lit("{p}"), b.pick(_PHRASES, k)), F.lit("{d}"), F.date_format("o_orderdate", "MMMM d, yyyy"))
    day = F.to_date("o_orderdate")
    return o.select(
        k, text.alias("text"), b.pick(_NAMED, F.col("o_custkey")).alias("issuer"), b.pick(_ENTITIES, F.floor(F.col("o_custkey") / 5)).alias("entity"), b.pick(["ABC", "XYZ", "IN"], F.floor(F.col("o_custkey") / 30)).alias("symbol"),
        F.date_add(day, (F.col("o_custkey") % 20).cast("int")).alias("last_day"), F.date_sub(day, (F.col("o_custkey") % 17).cast("int")).alias("first_day"), F.when(k % 2 == 0, "first").otherwise("last").alias("lifecycle_anchor"),
    )


_REVIEWED = f"""SELECT o_orderkey, replace(replace({b.sql_pick(_FRAMES, f"o_orderkey // {len(_PHRASES)}")}, '{{p}}', {b.sql_pick(_PHRASES, "o_orderkey")}), '{{d}}', {_DAY}) AS text, {b.sql_pick(_NAMED, "o_custkey")} AS issuer,
{b.sql_pick(_ENTITIES, "o_custkey // 5")} AS entity, {b.sql_pick(["ABC", "XYZ", "IN"], "o_custkey // 30")} AS symbol, CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 AS INTEGER) AS last_day, CAST(o_orderdate AS DATE) - CAST(o_custkey % 17 AS INTEGER) AS first_day,
CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'last' END AS anchor FROM orders"""
_BRACKETS = r"list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(coalesce({0}, ''), '\(([^)]*)\)', 1), lambda g: string_split(g, ','))), lambda x: upper(trim(x))), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9.\-]{{0,7}}') AND x <> 'CIK'))"
_DIRECT = r"(list_contains(" + _BRACKETS + r", symbol) OR regexp_matches({1}, '\b(TICKER|SYMBOL|NASDAQ|NYSE|NYSEAMERICAN|OTC) ' || symbol || '\b') OR regexp_matches({1}, '\b' || symbol || ' (COMMON|ORDINARY|SHARES|STOCK)\b'))"
_DATED = r"TRY_CAST(try_strptime(nullif(regexp_extract({0}, '\b((JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER) [0-9]{{1,2}} [0-9]{{4}})\b', 1), ''), '%B %d %Y') AS DATE)"


def _snippet(text: str, phrases, rows: str, quality: list[tuple], after: int, where: str = "true") -> str:
    """SQL of the rows with their best snippet ``x``: the part of ``text`` around the first or last place of a phrase that says most."""
    found = f"[{', '.join(repr(p) for p in phrases)}]"
    worth = " + ".join(f"CASE WHEN {_any('px', p) if p else _DATED.format('px') + ' IS NOT NULL'} THEN {v} ELSE 0 END" for p, v in quality)
    return f"""SELECT o_orderkey, x FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY q DESC, n, p) AS r FROM (SELECT *, {worth} AS q FROM (SELECT *, {_PLAIN.format("x")} AS px FROM (
    SELECT o_orderkey, n, p, substr({text}, greatest(0, p - {evidence.RADIUS}) + 1, least(length({text}), p + {f"length({found}[n]) + " if after else ""}{evidence.RADIUS}) - greatest(0, p - {evidence.RADIUS})) AS x
    FROM (SELECT *, unnest([strpos(upper({text}), upper({found}[n])) - 1, CASE WHEN strpos(upper({text}), upper({found}[n])) > 0 THEN length({text}) - strpos(reverse(upper({text})), reverse(upper({found}[n]))) - length({found}[n]) + 1 ELSE -1 END]) AS p FROM (SELECT *, unnest(range(1, {len(phrases) + 1})) AS n FROM ({rows}) WHERE {where})) WHERE p >= 0)))) WHERE r = 1"""


_TERMINAL_ROWS = f"SELECT *, {_PLAIN.format('text')} AS w FROM ({_REVIEWED})"


@query(
    f"""SELECT o_orderkey, CASE WHEN collision THEN 'reject_symbol_collision' WHEN x = '' THEN 'no_terminal_text_review' WHEN d IS NULL THEN 'missing_terminal_date_review' WHEN abs(date_diff('day', d, last_day)) > 14 THEN 'date_mismatch_review'
    WHEN ambiguous THEN 'ambiguous_identity_review' WHEN {_any("x", evidence.PROSPECTIVE)} THEN 'prospective_close_review' WHEN NOT (i OR direct) THEN 'weak_identity_review'
    WHEN ({_any("x", evidence.COMPLETION)} OR {_any("x", evidence.DELISTING)}) AND {_any("x", evidence.ACTUAL)} THEN 'terminal_text_verified_ready' ELSE 'terminal_text_review' END AS bucket,
    CAST(d AS VARCHAR) AS terminal_date, CAST(date_diff('day', d, last_day) AS INTEGER) AS days, length(x) AS snippet_chars,
    CASE WHEN list_contains(tickers, symbol) THEN 'parenthetical_match' WHEN len(tickers) > 0 THEN 'parenthetical_collision' WHEN named THEN 'direct_text_match' ELSE 'no_direct_ticker_evidence' END AS ticker_match_status
    FROM (SELECT *, {_DATED.format("x")} AS d, len(list_filter(tickers, lambda z: z <> symbol)) > 0 AS collision, named OR list_contains(tickers, symbol) OR {_DIRECT.format("x", "x")} AS direct,
    list_contains(string_split({_PLAIN.format("issuer")}, ' '), symbol) AND NOT (named OR list_contains(tickers, symbol) OR {_DIRECT.format("x", "x")}) AS ambiguous
    FROM (SELECT t.*, trim(coalesce(s.x, '')) AS x, {_BRACKETS.format("entity")} AS tickers, {_DIRECT.format("text", "w")} AS named, {_issuer_named("issuer", "w")} AS i FROM ({_TERMINAL_ROWS}) t
    LEFT JOIN ({_snippet("w", [p.upper() for p in evidence.TERMINAL], _TERMINAL_ROWS, [((), 40), (evidence.COMPLETION, 25), (evidence.DELISTING, 25)], 0)}) s USING (o_orderkey)))"""
)
def terminal_review(t: Inputs) -> DataFrame:
    out = filings.terminal_text(_reviewed(t))
    return out.select(
        "o_orderkey", F.col("terminal_text_bucket").alias("bucket"), F.col("terminal_text_date").cast("string").alias("terminal_date"), F.col("days_terminal_text_to_last").alias("days"),
        F.length("terminal_text_snippet").cast("long").alias("snippet_chars"), "ticker_match_status",
    )


_LIFE = [((), 40), (evidence.LAST_DAY, 25), (evidence.FIRST_DAY, 20)]


@query(
    f"""SELECT o_orderkey, CASE WHEN collision THEN 'reject_symbol_collision' WHEN NOT (i OR direct) THEN 'weak_identity_review' WHEN d IS NULL THEN 'missing_lifecycle_date_review' WHEN abs(days) > 14 THEN 'date_mismatch_review'
    WHEN ambiguous THEN 'ambiguous_identity_review' WHEN {_any("px", evidence.LIFECYCLE_PROSPECTIVE)} THEN 'prospective_language_review'
    WHEN CASE anchor WHEN 'first' THEN {_any("px", evidence.FIRST_DAY)} AND direct ELSE {_any("px", evidence.LAST_DAY)} END THEN 'lifecycle_text_verified_ready' ELSE anchor || '_day_lifecycle_review' END AS bucket, CAST(d AS VARCHAR) AS lifecycle_date, CAST(days AS INTEGER) AS days,
    CAST(20 * i::INT + 25 * direct::INT + 30 * {_any("px", evidence.LAST_DAY)}::INT + 25 * {_any("px", evidence.FIRST_DAY)}::INT + 15 * (d IS NOT NULL)::INT + 25 * coalesce(abs(days) <= 14, false)::INT - 40 * {_any("px", evidence.LIFECYCLE_PROSPECTIVE)}::INT
    - 100 * collision::INT - 30 * ambiguous::INT - 20 * (length(symbol) <= 2 AND NOT contains(' ' || w || ' ', ' ' || symbol || ' '))::INT AS INTEGER) AS score
    FROM (SELECT *, date_diff('day', d, CASE anchor WHEN 'first' THEN first_day ELSE last_day END) AS days, len(list_filter(tickers, lambda z: z <> symbol)) > 0 AS collision, list_contains(string_split({_PLAIN.format("issuer")}, ' '), symbol) AND NOT direct AS ambiguous
    FROM (SELECT *, {_DATED.format("px")} AS d, list_contains(tickers, symbol) OR {_DIRECT.format("text", "w")} OR {_DIRECT.format("x", "px")} AS direct FROM (SELECT *, {_PLAIN.format("x")} AS px, list_concat({_BRACKETS.format("entity")}, {_BRACKETS.format("x")}) AS tickers
    FROM (SELECT t.*, trim(coalesce(s.x, '')) AS x, {_issuer_named("issuer", "w")} AS i FROM ({_TERMINAL_ROWS}) t LEFT JOIN (
    {_snippet("text", evidence.FIRST_DAY, _TERMINAL_ROWS, _LIFE, 1, "anchor = 'first'")} UNION ALL {_snippet("text", evidence.LAST_DAY, _TERMINAL_ROWS, _LIFE, 1, "anchor = 'last'")}) s USING (o_orderkey)))))"""
)
def lifecycle_review(t: Inputs) -> DataFrame:
    out = filings.lifecycle_text(_reviewed(t))
    return out.select("o_orderkey", F.col("lifecycle_text_bucket").alias("bucket"), F.col("lifecycle_text_date").cast("string").alias("lifecycle_date"), F.col("days_lifecycle_text_to_anchor").alias("days"), F.col("lifecycle_text_score").alias("score"))


_CHANGES = [
    "The ticker symbol will change from AB to CD{n} on {d}.", "It ceased trading under the symbol AB and began trading on {d} under the new ticker symbol CD{n}.", "The ticker symbol changed from the symbol ab to cd{n}. On {d} it met.",
    "It commenced trading under the new symbol CD{n}, formerly AB, as of {d}.", "no change of symbol",
]


@query(
    f"""SELECT o_orderkey, CASE WHEN x < 4 THEN 'AB' END AS old_symbol, CASE WHEN x < 4 THEN 'CD' || n END AS new_symbol, CASE WHEN x IN (0, 1, 2, 3) THEN strftime(o_orderdate, '%Y-%m-%d') END AS event_date,
    CASE WHEN x IN (0, 1, 3) AND symbol = 'AB' AND n < 2 AND late >= 0 AND o_orderkey % 11 <> 0 THEN 'verified' ELSE 'event_candidate' END AS verification_state
    FROM (SELECT *, o_orderkey % 5 AS x, o_orderkey % 3 AS n, o_custkey % 5 - 1 AS late, {b.sql_pick(["AB", "AB", "ZZ"], "o_custkey")} AS symbol FROM orders)"""
)
def symbol_changes(t: Inputs) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.replace(F.replace(b.pick(_CHANGES, k), F.lit("{n}"), (k % 3).cast("string")), F.lit("{d}"), F.date_format("o_orderdate", "MMMM d, yyyy"))
    filed = F.date_add(day, (F.col("o_custkey") % 5 - 1).cast("int"))
    other = F.array(F.struct(F.when(k % 11 == 0, "7").otherwise("00042").alias("cik"), filed.alias("filing_date"), F.array(F.lit("CD0"), F.lit("cd1")).alias("tickers")))
    rows = t.table("orders").select(k, text.alias("text"), b.pick(["AB", "AB", "ZZ"], F.col("o_custkey")).alias("symbol"), day.alias("boundary"), F.lit("42").alias("subject_cik"), other.alias("confirmations"))
    return filings.symbol_change_proof(rows).select("o_orderkey", "old_symbol", "new_symbol", F.col("event_date").cast("string").alias("event_date"), "verification_state")


@query(
    """SELECT symbol_era_id, CASE WHEN n % 5 = 0 THEN CASE WHEN n % 2 = 0 THEN 'unknown' ELSE 'disjoint' END WHEN DATE '1999-06-30' < f THEN 'disjoint' WHEN DATE '1997-01-01' > l THEN CASE WHEN n % 2 = 0 THEN 'unknown' ELSE 'disjoint' END
    WHEN DATE '1999-06-30' BETWEEN f AND l OR DATE '1997-01-01' BETWEEN f AND l THEN 'plausible' ELSE 'unknown' END AS verdict, coalesce(n % 5 <> 0 AND DATE '1997-01-01' <= f AND DATE '1999-06-30' >= l, false) AS contains
    FROM (SELECT *, strptime(first_day, '%Y%m%d')::DATE AS f, strptime(last_day, '%Y%m%d')::DATE AS l FROM book)""",
    "book",
)
def activity_verdicts(t: Inputs) -> DataFrame:
    dates = F.array(F.lit("1999-06-30").cast("date"), F.lit("1997-01-01").cast("date"))
    known = F.when(F.col("n") % 5 != 0, dates)
    era = F.to_date("first_day", "yyyyMMdd"), F.to_date("last_day", "yyyyMMdd")
    return b.book(t).select("symbol_era_id", evidence.activity_verdict(*era, known, F.col("n") % 2 == 0).alias("verdict"), evidence.contains_era(*era, known).alias("contains"))


_KINDS = ["trade_report", "quote_update", "trade_break", "system_event", "security_directive", "trading_status", "official_price", "auction_information"]


def _library(t: Inputs) -> DataFrame:
    n = F.col("event_id")
    return t.table("events").select(
        b.pick(_KINDS, n).alias("type"), n.alias("timestamp"), F.concat(F.lit("S"), F.col("user_id").cast("string"), F.lit("  ")).alias("symbol"), F.col("value").alias("price"), (n % 100).alias("size"), n.alias("trade_id"), (n % 256).cast("int").alias("flags"),
        F.col("value").alias("bid_price"), (n % 7).alias("bid_size"), F.lit(None).cast("double").alias("ask_price"), F.lit(None).cast("long").alias("ask_size"), b.pick(["O", "C", "x"], n).alias("event"), b.pick(["H", "T", "?"], n).alias("status"), (n * 100).alias("adjusted_poc_close"), F.col("value").alias("reference_price"),
    )


_LIBRARY = f"SELECT event_id AS n, {b.sql_pick(_KINDS, 'event_id')} AS k, value, user_id FROM events"


@query(
    f"""SELECT n AS timestamp, CASE k WHEN 'trade_report' THEN 'TradeReport' WHEN 'trade_break' THEN 'TradeBreak' WHEN 'system_event' THEN 'SystemEvent' WHEN 'security_directive' THEN 'SecurityDirective' WHEN 'trading_status' THEN 'TradingStatus' WHEN 'official_price' THEN 'OfficialPrice' ELSE 'AuctionInformation' END AS type,
    'S' || user_id AS symbol, CASE WHEN k IN ('trade_report', 'trade_break') THEN n % 100 END AS size, CASE k WHEN 'security_directive' THEN n * 100 / 10000 WHEN 'system_event' THEN NULL WHEN 'trading_status' THEN NULL ELSE value END AS price,
    CASE WHEN k IN ('trade_report', 'trade_break') THEN CAST(round(value * 10000) AS BIGINT) END AS price_int, CASE WHEN k = 'system_event' THEN [79.0, 67.0, 120.0][n % 3 + 1]::DOUBLE END AS system_event,
    CASE WHEN k = 'system_event' THEN ['start_of_messages', 'end_of_messages', NULL][n % 3 + 1] END AS system_event_str, CASE WHEN k = 'trading_status' THEN ['all_halted', 'iex_trading', NULL][n % 3 + 1] END AS trading_status_message,
    CASE WHEN k IN ('trade_report', 'security_directive') THEN CAST(n % 256 AS INTEGER) END AS flags FROM ({_LIBRARY}) WHERE k <> 'quote_update'"""
)
def normalized_main(t: Inputs) -> DataFrame:
    return messages.normalized(_library(t))[0].select("timestamp", "type", "symbol", "size", "price", "price_int", "system_event", "system_event_str", "trading_status_message", "flags")


@query(f"SELECT n AS timestamp, 'QuoteUpdate' AS type, 'S' || user_id AS symbol, n % 7 AS bid_size, value AS bid_price, CAST(round(value * 10000) AS BIGINT) AS bid_price_int, CAST(NULL AS DOUBLE) AS ask_price FROM ({_LIBRARY}) WHERE k = 'quote_update'")
def normalized_quotes(t: Inputs) -> DataFrame:
    return messages.normalized(_library(t))[1].select("timestamp", "type", "symbol", "bid_size", "bid_price", "bid_price_int", "ask_price")


@query("SELECT symbol_era_id || 'x' AS symbol_era_id, CASE WHEN n % 3 = 0 THEN 'event_candidate' ELSE 'verified' END AS verification_state FROM book WHERE n % 4 <> 0", "book")
def migrated_rows(t: Inputs) -> DataFrame:
    rows = b.book(t).select("symbol_era_id", "n", F.when(F.col("n") % 3 == 0, "merger_lead").otherwise("merger").alias("status"))
    mapping = rows.filter("n % 4 <> 0").select(F.col("symbol_era_id").alias("old_era_id"), F.concat("symbol_era_id", F.lit("x")).alias("new_era_id"))
    return facts.migrated(rows, mapping, must_survive=False).select("symbol_era_id", "verification_state")


@query("SELECT symbol, symbol_era_id, 'terminal_disposition' AS resolution_status, 'trade_rows=' || CAST(trade_rows AS BIGINT) || '; observed_days=' || observed_days || '; no current evidence' AS source_note FROM lanes WHERE trade_rows <= 3 AND observed_days <= 5 AND evidence = 'historical_identity_unresolved' AND research_route = 'fund_or_trust_closure'", "lanes")
def ledger_candidates(t: Inputs) -> DataFrame:
    args = (F.col("ticker"), F.col("iex_product_hint"), F.col("issuer"))
    rows = b.book(t).withColumn("research_route", classify.research_route(classify.instrument_type(*args))).filter("research_route = 'fund_or_trust_closure'")
    rows = rows.withColumn("resolution_lane", F.lit("other"))
    plan = worklists.impact(rows).withColumn("workplan_bucket", classify.workplan_bucket(0, 10**9, 3, 5))
    return worklists.ledger_candidates(plan).select("symbol", "symbol_era_id", "resolution_status", "source_note")


@query(
    """SELECT d.symbol_era_id, d.root AS parent_symbol, p.symbol_era_id AS parent_era_id, p.n AS parent_score FROM (SELECT symbol_era_id, symbol AS root FROM book WHERE n % 2 = 0) d
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, symbol_era_id) AS k FROM book) WHERE k = 1) p ON p.symbol = d.root""",
    "book",
)
def parent_links(t: Inputs) -> DataFrame:
    rows = b.book(t)
    derived = rows.filter("n % 2 = 0").select("symbol_era_id", F.concat("symbol", F.lit("-A")).alias("symbol"))
    roots = rows.select("symbol", "symbol_era_id", F.col("n").alias("evidence_score"), F.lit("u").alias("url"))
    return worklists.parent_links(derived, roots).select("symbol_era_id", "parent_symbol", "parent_era_id", "parent_score")


@query("SELECT symbol_era_id, CASE WHEN n % 3 = 0 THEN 5 ELSE 0 END AS documents, CASE WHEN n % 3 = 0 THEN 'x' ELSE 'none' END AS bucket FROM book", "book")
def attached_documents(t: Inputs) -> DataFrame:
    rows = b.book(t)
    extra = rows.filter("n % 3 = 0").select("symbol_era_id", F.lit(5).alias("documents"), F.lit("x").alias("bucket"))
    return worklists.attach(rows.select("symbol_era_id"), extra, {"documents": 0, "bucket": "none"})


@query(
    """SELECT symbol_era_id, r AS resolved_cik, s AS sic, CASE WHEN TRY_CAST(s AS BIGINT) BETWEEN 2000 AND 3999 THEN 'D' WHEN TRY_CAST(s AS BIGINT) BETWEEN 7000 AND 8999 THEN 'I' END AS sector_code,
    CASE WHEN s IS NOT NULL THEN 'sic_and_sector' WHEN r IS NOT NULL THEN 'cik_no_sic' WHEN n % 2 = 0 THEN 'fund_no_sic_needed' ELSE 'no_cik' END AS sic_coverage_status,
    CASE WHEN r IS NULL THEN NULL WHEN CAST(r AS BIGINT) % 2 = 0 THEN 'terminal' WHEN symbol = 'S1' THEN 'still_active_same_symbol' ELSE 'renamed_or_successor' END AS continuity_status
    FROM (SELECT *, CASE WHEN n % 3 <> 0 THEN CAST(n % 30 AS VARCHAR) END AS r, CASE WHEN n % 3 <> 0 AND n % 30 < 20 THEN ['2000', '7372', '1800'][n % 30 % 3 + 1] END AS s FROM book)""",
    "book",
)
def sector_table(t: Inputs) -> DataFrame:
    rows, n = b.book(t), F.col("n")
    keys = t.spark.range(30).withColumnRenamed("id", "k")
    eras = rows.select("symbol_era_id", "symbol", F.lit(None).cast("string").alias("identity_instrument"))
    ciks = rows.filter("n % 3 <> 0").select("symbol_era_id", (n % 30).cast("string").alias("resolved_cik"))
    sic = keys.filter("k < 20").select(F.col("k").cast("string").alias("cik"), b.pick(["2000", "7372", "1800"], F.col("k")).alias("sic"))
    classes = rows.filter("n % 2 = 0").select("symbol_era_id", F.lit("fund_etf").alias("stable_openfigi_class"))
    tickers = keys.select(F.col("k").cast("string").alias("cik"), F.when(F.col("k") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("S1"))).alias("current_tickers"))
    return worklists.sector_table(eras, ciks, sic, classes, tickers).select("symbol_era_id", "resolved_cik", "sic", "sector_code", "sic_coverage_status", "continuity_status")
