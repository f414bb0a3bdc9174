"""Labels of instruments, evidence, research work and registry codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeline.functions import names

# The ten divisions of the public SIC manual, with their first and last code.
SIC_DIVISIONS = (
    ("A", "Agriculture, Forestry, And Fishing", 100, 999),
    ("B", "Mining", 1000, 1499),
    ("C", "Construction", 1500, 1799),
    ("D", "Manufacturing", 2000, 3999),
    ("E", "Transportation, Communications, Electric, Gas, And Sanitary Services", 4000, 4999),
    ("F", "Wholesale Trade", 5000, 5199),
    ("G", "Retail Trade", 5200, 5999),
    ("H", "Finance, Insurance, And Real Estate", 6000, 6799),
    ("I", "Services", 7000, 8999),
    ("J", "Public Administration", 9100, 9729),
)

# Instrument types, their short hint, and the route and evidence of research on each.
ROUTES = {
    "probable_operating_company": ("operating_company_sec_event", "8-K, merger proxy/S-4, 25-NSE, 15-12B, issuer/acquirer release"),
    "probable_fund_or_trust": ("fund_or_trust_closure", "fund liquidation, closure, merger, trust termination, or sponsor notice"),
    "probable_preferred": ("preferred_redemption_or_delisting", "preferred redemption, exchange, delisting, prospectus, or issuer notice"),
    "probable_warrant": ("warrant_unit_right_security_action", "warrant/unit/right redemption, separation, expiration, or SPAC action"),
    "probable_unit": ("warrant_unit_right_security_action", "warrant/unit/right redemption, separation, expiration, or SPAC action"),
    "probable_right": ("warrant_unit_right_security_action", "warrant/unit/right redemption, separation, expiration, or SPAC action"),
    "probable_share_class": ("share_class_corporate_action", "share-class rename, ADR/common share conversion, merger, or delisting notice"),
    "unknown_instrument": ("manual_syntax_review", "manual symbol syntax review before choosing SEC or security-action path"),
}
_FUND_WORDS = r"(?i)\b(etf|etn|fund|trust|portfolio|index|pref)\b"
_PREFERRED = r"^(?:[A-Z]{1,5}[- .]PR[A-Z]|[A-Z]{1,5}[- ][A-Z]|[A-Z]{2,5}PR[A-Z])$"


def _first(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = F.coalesce(*[F.when(condition, F.lit(label)) for condition, label in rules])
    return F.coalesce(out, F.lit(otherwise)) if otherwise is not None else out


def product_hint(issuer: Column) -> Column:
    """Kind of product that an issuer's name suggests."""
    name = F.upper(F.coalesce(issuer, F.lit("")))
    any_of = lambda *words: name.rlike("|".join(words))
    return _first(
        [(any_of(" ETF", "ETF$"), "etf"), (any_of(" ETN", "ETN$"), "etn"), (any_of(" FUND", " TRUST", " INCOME", " TREASURY"), "fund_or_trust"), (any_of(" ACQUISITION", " SPAC"), "spac"), (any_of(" ADR", "-ADR$"), "adr")],
        "operating_or_other",
    )


def _instrument(symbol: Column, hint: Column, issuer: Column) -> list[tuple[Column, str, str]]:
    s = F.upper(F.coalesce(symbol, F.lit("")))
    long = F.length(s) >= 5
    return [
        (F.coalesce(hint.isin("etf", "etn", "fund_or_trust"), F.lit(False)), "probable_fund_or_trust", "iex_product_hint_fund_or_trust"),
        ((long & s.rlike("(WS|WT|W)$")) | s.rlike(r"WTS$|(^|[-. ])(WTS?|WARRANTS?)$|\+[A-Z]?$"), "probable_warrant", "symbol_warrant_suffix"),
        ((long & s.endswith("U")) | s.rlike(r"(^|[-. ])U$|=$"), "probable_unit", "symbol_unit_suffix"),
        (s.rlike(r"(^|[-. ])RTS?$|\^$"), "probable_right", "symbol_right_suffix"),
        (s.rlike(_PREFERRED) | F.regexp_replace(s, r"\*$", "").rlike(_PREFERRED), "probable_preferred", "symbol_preferred_suffix"),
        (s.rlike(r"^[A-Z]{1,5}\.[A-Z]$"), "probable_share_class", "dot_share_class_suffix"),
        (F.coalesce(issuer, F.lit("")).rlike(_FUND_WORDS), "probable_fund_or_trust", "issuer_name_fund_or_trust"),
        (s.rlike(r"^[A-Z]{1,5}$"), "probable_operating_company", "common_stock_symbol"),
    ]


def instrument_type(symbol: Column, hint: Column, issuer: Column) -> Column:
    return _first([(c, t) for c, t, _ in _instrument(symbol, hint, issuer)], "unknown_instrument")


def instrument_reason(symbol: Column, hint: Column, issuer: Column) -> Column:
    return _first([(c, r) for c, _, r in _instrument(symbol, hint, issuer)], "ambiguous_symbol_pattern")


def instrument_hint(kind: Column) -> Column:
    """The older, coarser label of an instrument type."""
    same = kind.isin("probable_fund_or_trust", "probable_warrant", "probable_unit", "probable_right")
    return F.when(same, kind).when(kind == "probable_preferred", "possible_preferred").otherwise("probable_operating_or_other")


def _routed(kind: Column, field: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in ROUTES.items() for x in (k, v[field])])
    return F.coalesce(F.try_element_at(table, F.coalesce(kind, F.lit("unknown_instrument"))), F.lit(ROUTES["unknown_instrument"][field]))


def research_route(kind: Column) -> Column:
    return _routed(kind, 0)


def recommended_evidence(kind: Column) -> Column:
    return _routed(kind, 1)


def evidence_status(registry: Column, listing: Column) -> Column:
    """What current listings say of an era."""
    sec = registry.isin("sec_current_match", "sec_multiple_current_matches")
    seen = listing.isin("iex_snapshot_overlap", "iex_snapshot_changed_during_window", "iex_snapshot_removed_before_latest", "iex_current_symbol_only")
    return _first([(sec & seen, "current_sec_and_iex_evidence"), (sec, "current_sec_only_evidence"), (seen, "current_iex_only_evidence")], "historical_identity_unresolved")


def manual_evidence(status: Column, manual: Column) -> Column:
    return F.when(manual.isNotNull(), "manual_verified_historical_identity").otherwise(status)


def review_priority(manual: Column, status: Column, source_class: Column) -> Column:
    return (
        F.when(manual.isNotNull(), 0)
        .when(status == "historical_identity_unresolved", 1)
        .when(source_class == "intermittent_or_reused_candidate", 2)
        .when(source_class == "delisted_or_acquired_candidate", 3)
        .otherwise(4)
    )


def workflow_status(manual: Column, resolution: Column) -> Column:
    return _first(
        [
            (manual.isNotNull(), "manual_verified_historical_identity"),
            (resolution.isin("auto_verified", "terminal_disposition", "no_evidence_after_search"), "ledger_terminal_disposition"),
            (resolution == "review_ready", "ledger_review_ready"),
            (resolution == "manual_required", "ledger_manual_required"),
        ],
        "needs_resolution",
    )


def usable_by_default(tier: Column, contested: Column) -> Column:
    """Whether an identity may be used without choosing a tier."""
    return F.coalesce(tier.isin("verified", "corroborated") | ((tier == "openfigi_asserted") & ~contested), F.lit(False))


def sic_division(sic: Column, field: int = 0) -> Column:
    """Division code (field 0) or name (1) of a SIC code; null in the scheme's gaps and for anything that is no number."""
    code = sic.try_cast("long")
    return _first([(code.between(d[2], d[3]), d[field]) for d in SIC_DIVISIONS])


def sic_coverage(sic: Column, cik: Column, instrument: Column) -> Column:
    return _first([(sic.isNotNull(), "sic_and_sector"), (cik.isNotNull(), "cik_no_sic"), (instrument == "fund_etf", "fund_no_sic_needed")], "no_cik")


def continuity(symbol: Column, tickers: Column) -> Column:
    """What a registrant's current tickers say of a symbol; null where they are not known."""
    own = F.coalesce(F.array_contains(tickers, symbol), F.lit(False))
    return F.when(tickers.isNotNull(), F.when(F.size(tickers) == 0, "terminal").when(own, "still_active_same_symbol").otherwise("renamed_or_successor"))


def registry_confidence(matches: Column) -> Column:
    return F.when(matches.isNull(), "sec_unmatched").when(matches > 1, "sec_multiple_current_matches").otherwise("sec_current_match")


def listing_confidence(first_snapshot: str, last_snapshot: str) -> Column:
    """How listing snapshots (days without dashes) bear on an era; needs the joined lifecycle columns."""
    c = F.col
    last_seen = F.replace(c("iex_last_seen"), F.lit("-"), F.lit(""))
    overlaps = (c("last_day") >= first_snapshot) & (c("first_day") <= last_snapshot)
    removed = F.coalesce("iex_removed_after_seen", F.lit(False)) | (last_seen < last_snapshot)
    return _first(
        [
            (c("iex_first_seen").isNull(), "iex_snapshot_unmatched"),
            ((F.coalesce("iex_issuer_variant_count", F.lit(0)) > 1) & overlaps, "iex_snapshot_changed_during_window"),
            (removed, "iex_snapshot_removed_before_latest"),
            (overlaps, "iex_snapshot_overlap"),
            ((c("last_day") < first_snapshot) & F.coalesce("iex_seen_in_latest", F.lit(False)), "iex_current_symbol_only"),
            (c("first_day") > last_snapshot, "iex_seen_before_era"),
        ],
        "iex_snapshot_matched",
    )


def resolution_lane(route: Column, source_class: Column, trade_rows: Column, sparse: int = 1000) -> Column:
    operating = route == "operating_company_sec_event"
    return _first(
        [
            (operating & (source_class == "delisted_or_acquired_candidate"), "operating_terminal_event"),
            (operating & (source_class == "partial_window_candidate"), "operating_partial_window"),
            (operating & (trade_rows < sparse), "operating_sparse_intermit"),
            (operating, "operating_intermit_material"),
            (route == "preferred_redemption_or_delisting", "preferred_parent_or_redemption"),
            (route == "warrant_unit_right_security_action", "warrant_unit_right_action"),
            (route == "share_class_corporate_action", "share_class_action"),
        ],
        "manual_syntax",
    )


def trade_tier(rows: Column) -> Column:
    steps = ((1_000_000, ">=1M"), (100_000, "100K-999K"), (10_000, "10K-99K"), (1_000, "1K-9K"), (100, "100-999"), (1, "1-99"))
    return _first([(rows >= n, label) for n, label in steps], "0")


def workplan_bucket(top_rank: int = 2000, many: int = 100_000, few: int = 99, days: int = 5) -> Column:
    """Which kind of work an unresolved era goes to; needs the lanes' columns and impact_rank."""
    c = F.col
    operating = c("research_route") == "operating_company_sec_event"
    high = operating & ((c("impact_rank") <= top_rank) | (c("trade_rows") >= many))
    derivative = c("research_route").isin("preferred_redemption_or_delisting", "warrant_unit_right_security_action", "share_class_corporate_action")
    current = F.coalesce(evidence_status(c("sec_current_confidence"), c("iex_entity_confidence")) != "historical_identity_unresolved", F.lit(False))
    syntax = (c("research_route") == "manual_syntax_review") | (c("resolution_lane") == "manual_syntax")
    low = (c("trade_rows") <= few) & (c("observed_days") <= days) & ~current & ~syntax
    lifecycle = operating & c("resolution_lane").isin("operating_partial_window", "operating_sparse_intermit", "operating_intermit_material")
    return _first(
        [(high, "high_impact_operating"), (derivative, "derivative_parent_resolution"), (low, "low_materiality_bulk_disposition"), (lifecycle, "operating_lifecycle_search")],
        "manual_review_hold",
    )


def parent_root(symbol: Column) -> Column:
    """Symbol of the common stock that a derived security's symbol points to; null for plain symbols."""
    cut = lambda n: F.substring(symbol, F.lit(1), F.length(symbol) - n)
    return F.when(symbol.rlike("[-.]"), F.regexp_replace(symbol, "[-.].*$", "")).when(symbol.rlike("(WS|WT|RT)$"), cut(2)).when(symbol.rlike(r"[WU+=^]$"), cut(1))


def cik_tiers() -> list[tuple[Column, str, str, Column]]:
    """Condition, tier, source and CIK of each way to a registrant, best first."""
    c = F.col
    no = F.lit(False)
    verified = F.coalesce(c("identity_tier") == "verified", no)
    legacy = F.coalesce(names.archive_cik(c("identity_source_url")), F.lit(""))
    by_date = verified & F.coalesce(c("identity_method") == "sec_date_scoped_display_names", no) & F.coalesce(c("identity_entity_id").rlike(r"^\d+$"), no)
    by_url = verified & F.coalesce(c("identity_method") == "legacy_historical_override", no) & (legacy != "")
    active = F.coalesce(c("source_classification").isin("stable_candidate", "ipo_or_new_listing_candidate"), no)
    current = active & F.coalesce(c("sec_current_confidence") == "sec_current_match", no) & c("sec_cik").isNotNull()
    plain = lambda x: F.ltrim(x, F.lit("0"))
    return [
        (by_date, "A", "sec_date_scoped_display_names", plain(c("identity_entity_id"))),
        (by_url, "B", "legacy_historical_override_url_derived", legacy),
        (current, "C", "sec_current_ticker_match", plain(c("sec_cik"))),
        (c("name_matched_cik").isNotNull(), "D", "sec_name_matched", c("name_matched_cik")),
        (c("edgar_matched_cik").isNotNull(), "E", "edgar_company_search_matched", c("edgar_matched_cik")),
    ]


def resolved_cik() -> Column:
    """Struct of cik, source and tier by the best tier that holds."""
    none = F.struct(F.lit(None).cast("string").alias("cik"), F.lit("no_cik_available").alias("source"), F.lit(None).cast("string").alias("tier"))
    out = none
    for condition, tier, source, cik in reversed(cik_tiers()):
        out = F.when(condition, F.struct(cik.alias("cik"), F.lit(source).alias("source"), F.lit(tier).alias("tier"))).otherwise(out)
    return out
