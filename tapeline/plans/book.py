"""A book of eras with names, tickers and evidence, made from the driver's tables on both sides.

The attributes are picked from short lists by a number of each era, so that every rule meets every
kind of input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators import facts
from tapeline.plans.registry import PARTS, Inputs

TICKERS = ["ABC", "ABCDW", "ABCDU", "XY.PRA", "XY.A", "AB-A", "ABCWS", "RT^", "FOO=", "BAR RT", "A+", "ZZ PRB*", "TOOLONGNAME", "FIVEU", "Q", "WARRANT", "XYZPRC"]
ISSUERS = [
    "ACME HOLDINGS INC", "Acme Inc.", "BETA FUND TRUST", "GAMMA U.S. SILICA CO/DE", "CONN'S INC", "DELTA & SONS LTD", "DELTA AND SONS LIMITED", "EPSILON GROUP PLC /NEW/", "", "ZETA CORP-CL A", "ZETA CORP", "ETA ACQUISITION CORP II",
    "ETA ACQUISITION CORP III", "THETA RESOURCE", "THETA RESOURCES INC", "IOTA GLOBAL HLDGS", "IOTA GLOBAL", "THE KAPPA COMPANY", "LAMBDA ETF", "MU ADR", "NU INCOME", "XI S.A.",
]
HINTS = ["etf", "operating_or_other", None, "spac", "adr"]
SEC = ["sec_current_match", "sec_unmatched", "sec_multiple_current_matches", "sec_unmatched", "sec_unmatched"]
LISTED = ["iex_snapshot_unmatched", "iex_snapshot_overlap", "iex_snapshot_unmatched", "iex_current_symbol_only", "iex_seen_before_era", "iex_snapshot_unmatched"]
MANUAL = [None, None, None, None, None, None, "confirmed"]
STATUS = [None, "auto_verified", "review_ready", "manual_required", None, "open"]
STATES = ["verified", "candidate", "openfigi_asserted", "corroborated", "candidate"]
METHODS = ["sec_date_scoped_display_names", "legacy_historical_override", "other"]
FLAGS = ["issuer_name_match", "symbol_match", "event_language", "completion_language", "delisting_language", "terminal_date_proximity", "unknown_flag"]
FORMS = ["8-K", "6-K", "25", "15-12B", "S-4", "425", "10-K", "8-K"]
STRENGTHS = ["deal_form", "exchange_exit_form", "review_form", "weak_form"]


def pick(values: list, n: Column) -> Column:
    """The value at a number, counted round and round."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def sql_pick(values: list, n: str) -> str:
    """The same in SQL."""
    items = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{items}])[({n}) % {len(values)} + 1]"


def book(t: Inputs) -> DataFrame:
    """Eras with attributes."""
    n = F.col("n")
    rows = t.eras.select("symbol", "symbol_era_id", "era_index", "first_day", "last_day", "observed_days", "trade_rows", "source_classification")
    rows = rows.withColumn("n", (F.col("trade_rows") * 7 + F.col("observed_days") * 3 + F.col("era_index") * 11).cast("long"))
    return rows.withColumns(
        {
            "ticker": pick(TICKERS, n),
            "issuer": pick(ISSUERS, n),
            "iex_product_hint": pick(HINTS, F.floor(n / 2)),
            "sec_current_confidence": pick(SEC, n),
            "iex_entity_confidence": pick(LISTED, n),
            "historical_identity_status": pick(MANUAL, n),
            "resolution_status": pick(STATUS, n),
            "cik": F.lpad((n % 50).cast("string"), 10, "0"),
        }
    )


def found(t: Inputs) -> DataFrame:
    """Orders as facts on eras, one a customer and year: ids, states, issuers, entities, times."""
    o = t.table("orders")
    k = F.col("o_orderkey")
    symbol = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    return o.select(
        F.concat(F.lit("identity:"), (k % 9000).cast("string")).alias("fact_id"),
        F.concat(symbol, F.lit("#"), F.date_format("o_orderdate", "yyyy")).alias("symbol_era_id"),
        symbol.alias("symbol"),
        pick(STATES, k).alias("verification_state"),
        pick(ISSUERS, k).alias("issuer"),
        (k % 40).cast("string").alias("entity_id"),
        pick(METHODS, k).alias("identity_method"),
        (k % 3 == 0).alias("contested"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("created_at"),
        F.col("o_orderstatus").alias("batch"),
        k.alias("o_orderkey"),
    )


def best(t: Inputs) -> DataFrame:
    return facts.best_facts(found(t), [F.col("o_orderkey")])


PARTS |= {
    "book": (
        ("eras",),
        f"""SELECT *, {sql_pick(TICKERS, "n")} AS ticker, {sql_pick(ISSUERS, "n")} AS issuer, {sql_pick(HINTS, "n // 2")} AS iex_product_hint,
        {sql_pick(SEC, "n")} AS sec_current_confidence, {sql_pick(LISTED, "n")} AS iex_entity_confidence, {sql_pick(MANUAL, "n")} AS historical_identity_status,
        {sql_pick(STATUS, "n")} AS resolution_status, lpad(CAST(n % 50 AS VARCHAR), 10, '0') AS cik
        FROM (SELECT symbol, symbol_era_id, era_index, first_day, last_day, observed_days, trade_rows, source_classification,
        CAST(trade_rows * 7 + observed_days * 3 + era_index * 11 AS BIGINT) AS n FROM eras)""",
    ),
    "typed": (
        ("book",),
        r"""SELECT *, CASE WHEN iex_product_hint IN ('etf', 'etn', 'fund_or_trust') THEN 'probable_fund_or_trust|iex_product_hint_fund_or_trust'
        WHEN (length(ticker) >= 5 AND regexp_matches(ticker, '(WS|WT|W)$')) OR regexp_matches(ticker, 'WTS$|(^|[-. ])(WTS?|WARRANTS?)$|\+[A-Z]?$') THEN 'probable_warrant|symbol_warrant_suffix'
        WHEN (length(ticker) >= 5 AND ticker LIKE '%U') OR regexp_matches(ticker, '(^|[-. ])U$|=$') THEN 'probable_unit|symbol_unit_suffix'
        WHEN regexp_matches(ticker, '(^|[-. ])RTS?$|\^$') THEN 'probable_right|symbol_right_suffix'
        WHEN regexp_matches(regexp_replace(ticker, '\*$', ''), '^([A-Z]{1,5}[- .]PR[A-Z]|[A-Z]{1,5}[- ][A-Z]|[A-Z]{2,5}PR[A-Z])$') THEN 'probable_preferred|symbol_preferred_suffix'
        WHEN regexp_matches(ticker, '^[A-Z]{1,5}\.[A-Z]$') THEN 'probable_share_class|dot_share_class_suffix'
        WHEN regexp_matches(issuer, '(?i)\b(etf|etn|fund|trust|portfolio|index|pref)\b') THEN 'probable_fund_or_trust|issuer_name_fund_or_trust'
        WHEN regexp_matches(ticker, '^[A-Z]{1,5}$') THEN 'probable_operating_company|common_stock_symbol' ELSE 'unknown_instrument|ambiguous_symbol_pattern' END AS tr FROM book""",
    ),
    "routed": (
        ("typed",),
        """SELECT *, CASE instrument_type WHEN 'probable_operating_company' THEN 'operating_company_sec_event' WHEN 'probable_fund_or_trust' THEN 'fund_or_trust_closure'
        WHEN 'probable_preferred' THEN 'preferred_redemption_or_delisting' WHEN 'probable_share_class' THEN 'share_class_corporate_action' WHEN 'unknown_instrument' THEN 'manual_syntax_review'
        ELSE 'warrant_unit_right_security_action' END AS research_route,
        CASE WHEN historical_identity_status IS NOT NULL THEN 'manual_verified_historical_identity' ELSE evidence END AS identity_evidence_status,
        CASE WHEN historical_identity_status IS NOT NULL THEN 'manual_verified_historical_identity' WHEN resolution_status = 'auto_verified' THEN 'ledger_terminal_disposition'
        WHEN resolution_status = 'review_ready' THEN 'ledger_review_ready' WHEN resolution_status = 'manual_required' THEN 'ledger_manual_required' ELSE 'needs_resolution' END AS resolution_workflow_status
        FROM (SELECT *, split_part(tr, '|', 1) AS instrument_type, split_part(tr, '|', 2) AS instrument_reason,
        CASE WHEN sec_current_confidence <> 'sec_unmatched' AND iex_entity_confidence IN ('iex_snapshot_overlap', 'iex_current_symbol_only') THEN 'current_sec_and_iex_evidence'
        WHEN sec_current_confidence <> 'sec_unmatched' THEN 'current_sec_only_evidence'
        WHEN iex_entity_confidence IN ('iex_snapshot_overlap', 'iex_current_symbol_only') THEN 'current_iex_only_evidence' ELSE 'historical_identity_unresolved' END AS evidence FROM typed)""",
    ),
    "lanes": (
        ("routed",),
        """SELECT *, CASE WHEN research_route = 'operating_company_sec_event' AND source_classification = 'delisted_or_acquired_candidate' THEN 'operating_terminal_event'
        WHEN research_route = 'operating_company_sec_event' AND source_classification = 'partial_window_candidate' THEN 'operating_partial_window'
        WHEN research_route = 'operating_company_sec_event' AND trade_rows < 5 THEN 'operating_sparse_intermit' WHEN research_route = 'operating_company_sec_event' THEN 'operating_intermit_material'
        WHEN research_route = 'preferred_redemption_or_delisting' THEN 'preferred_parent_or_redemption' WHEN research_route = 'warrant_unit_right_security_action' THEN 'warrant_unit_right_action'
        WHEN research_route = 'share_class_corporate_action' THEN 'share_class_action' ELSE 'manual_syntax' END AS resolution_lane,
        row_number() OVER w AS impact_rank, sum(trade_rows) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_trade_rows, sum(trade_rows) OVER () AS everything
        FROM routed WINDOW w AS (ORDER BY trade_rows DESC, symbol_era_id)""",
    ),
    "found": (
        (),
        f"""SELECT 'identity:' || (o_orderkey % 9000) AS fact_id, 'C' || o_custkey || '#' || year(o_orderdate) AS symbol_era_id, 'C' || o_custkey AS symbol,
        {sql_pick(STATES, "o_orderkey")} AS verification_state, {sql_pick(ISSUERS, "o_orderkey")} AS issuer, CAST(o_orderkey % 40 AS VARCHAR) AS entity_id,
        {sql_pick(METHODS, "o_orderkey")} AS identity_method, o_orderkey % 3 = 0 AS contested, strftime(o_orderdate, '%Y%m%d') AS created_at, o_orderstatus AS batch, o_orderkey FROM orders""",
    ),
    "best": (
        ("found",),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_era_id ORDER BY CASE verification_state WHEN 'verified' THEN 0 WHEN 'corroborated' THEN 1
        WHEN 'openfigi_asserted' THEN 2 ELSE 9 END, o_orderkey) AS k FROM found) WHERE k = 1""",
    ),
    "shots": (
        (),
        f"""SELECT snapshot_date, symbol, max({sql_pick(ISSUERS, "o_orderkey % 7 + o_custkey % 10")}) AS issuer, max(o_orderstatus) AS is_enabled, max(o_orderpriority) AS lit
        FROM (SELECT *, strftime(o_orderdate, '%Y-%m-01') AS snapshot_date, 'C' || (o_custkey % 60) AS symbol FROM orders) GROUP BY 1, 2""",
    ),
    "steps": (("shots",), "SELECT * FROM (SELECT lag(snapshot_date) OVER (ORDER BY snapshot_date) AS f, snapshot_date AS t FROM (SELECT DISTINCT snapshot_date FROM shots)) WHERE f IS NOT NULL"),
    "m": (("book",), "SELECT e.*, c.o_orderkey AS doc, CAST(o_orderdate AS DATE) AS ev, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 20 END AS inc FROM book e JOIN orders c ON e.symbol = 'X' || (c.o_custkey % 97)"),
}


def shots(t: Inputs) -> DataFrame:
    """Orders by month and customer as listing snapshots."""
    o = t.table("orders")
    name = pick(ISSUERS, F.col("o_orderkey") % 7 + F.col("o_custkey") % 10)
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("snapshot_date"), F.concat(F.lit("C"), (F.col("o_custkey") % 60).cast("string")).alias("symbol")).agg(
        F.max(name).alias("issuer"), F.max("o_orderstatus").alias("is_enabled"), F.max("o_orderpriority").alias("lit")
    )
