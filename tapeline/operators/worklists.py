"""Review queues, ranked worklists, roll-ups and document evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import classify

# What each flag of a document is worth.
DOCUMENT_WEIGHTS = {
    "issuer_name_match": 25,
    "symbol_match": 15,
    "issuer_or_symbol_context": 10,
    "event_language": 25,
    "completion_language": 30,
    "delisting_language": 25,
    "terminal_date_proximity": 20,
    "going_private_form": 15,
}
# Filing forms of the strata that are looked at, and how many of each.
FILING_STRATA = (("operating", ("8-K", "6-K"), 4), ("regulatory", ("25", "25-NSE", "15", "15-12B", "15-12G", "15-15D"), 4), ("deal", ("425", "DEFM14A", "S-4", "S-4/A", "SC 13E3", "SC 13E3/A"), 2))


def review_queue(eras: DataFrame) -> DataFrame:
    """Eras of doubtful continuity with instrument, route, evidence, workflow status and priority.

    Needs the joined columns of registry, listings, overrides and ledger.
    """
    doubtful = ("delisted_or_acquired_candidate", "intermittent_or_reused_candidate", "intermittent_full_window_candidate", "partial_window_candidate")
    c = F.col
    args = (c("symbol"), c("iex_product_hint"), c("iex_latest_issuer"))
    rows = eras.filter(c("source_classification").isin(*doubtful))
    rows = rows.withColumns({"instrument_type": classify.instrument_type(*args), "instrument_reason": classify.instrument_reason(*args)})
    rows = rows.withColumns(
        {
            "instrument_hint": classify.instrument_hint(c("instrument_type")),
            "research_route": classify.research_route(c("instrument_type")),
            "recommended_evidence": classify.recommended_evidence(c("instrument_type")),
            "routing_reason": F.concat(F.lit("instrument_type="), c("instrument_type")),
            "identity_evidence_status": classify.manual_evidence(classify.evidence_status(c("sec_current_confidence"), c("iex_entity_confidence")), c("historical_identity_status")),
            "resolution_workflow_status": classify.workflow_status(c("historical_identity_status"), c("resolution_status")),
        }
    )
    return rows.withColumn("review_priority", classify.review_priority(c("historical_identity_status"), c("identity_evidence_status"), c("source_classification")))


def prioritized(queue: DataFrame) -> DataFrame:
    """Unresolved eras with their rank by kind, class and trades.

    A worklist is read by people; its global rank needs one sorted sequence.
    """
    rows = queue.filter((F.col("identity_evidence_status") == "historical_identity_unresolved") & (F.col("resolution_workflow_status") == "needs_resolution"))
    rows = rows.withColumns({"is_probable_operating": F.col("instrument_type") == "probable_operating_company", "is_delisted_candidate": F.col("source_classification") == "delisted_or_acquired_candidate"})
    order = Window.orderBy(F.desc("is_probable_operating"), F.desc("is_delisted_candidate"), F.desc("trade_rows"), "symbol", "symbol_era_id")
    return rows.withColumn("priority_rank", F.row_number().over(order))


def impact(rows: DataFrame) -> DataFrame:
    """Rank by trades, running sum of them, and its share of all in percent."""
    order = Window.orderBy(F.desc("trade_rows"), "symbol_era_id")
    total = F.sum("trade_rows").over(Window.partitionBy())
    running = F.sum("trade_rows").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumns({"impact_rank": F.row_number().over(order), "cumulative_trade_rows": running, "_all": total})
    return out.withColumn("cumulative_trade_rows_pct", F.when(F.col("_all") > 0, F.round(F.col("cumulative_trade_rows") / F.col("_all") * 100, 6)).otherwise(0.0)).drop("_all")


def year_rollup(missing: DataFrame) -> DataFrame:
    """Eras, trades and kinds by first year and route, and by year alone (null route)."""
    year = F.substring("first_day", 1, 4).alias("first_year")
    return missing.select(year, "research_route", "trade_rows", "instrument_type", "source_classification").rollup("first_year", "research_route").agg(
        F.count("*").alias("eras"),
        F.sum("trade_rows").alias("trade_rows"),
        F.count_if(F.col("instrument_type") == "probable_operating_company").alias("probable_operating_company"),
        F.count_if(F.col("source_classification") == "delisted_or_acquired_candidate").alias("delisted_or_acquired"),
    ).filter("first_year is not null")


def counted(rows: DataFrame, *columns: str) -> DataFrame:
    """How many rows hold each value or combination."""
    return rows.groupBy(*columns).agg(F.count("*").alias("rows"))


def document_graph(evidence: DataFrame, most: int = 3) -> DataFrame:
    """Each era's best documents: bucket of the first, best score, count, reasons and references.

    ``evidence`` has symbol_era_id, flags (array), triage_score and url.
    """
    flags = F.array_sort(F.array_distinct("flags"))
    worth = F.create_map(*[F.lit(x) for k, v in DOCUMENT_WEIGHTS.items() for x in (k, v)])
    points = F.aggregate(F.col("_flags"), F.lit(0), lambda a, f: a + F.coalesce(F.try_element_at(worth, f), F.lit(0)))
    rows = evidence.withColumn("_flags", flags)
    rows = rows.withColumn("score", points + F.least(F.floor(F.col("triage_score") / 10), F.lit(15)).cast("int"))
    any_of = lambda *x: F.arrays_overlap("_flags", F.array(*map(F.lit, x)))
    identity, event = any_of("issuer_name_match", "symbol_match", "issuer_or_symbol_context"), any_of("event_language", "completion_language", "delisting_language")
    bucket = F.when((F.col("score") >= 80) & identity & event, "auto_verified_candidate").when(identity & event, "issuer_event_review").when(event, "event_only_review").otherwise("manual_review")
    reason = F.when(F.size("_flags") > 0, F.concat_ws(",", "_flags")).otherwise("no_combined_evidence")
    rows = rows.withColumns({"bucket": bucket, "reason": reason, "rank": F.row_number().over(Window.partitionBy("symbol_era_id").orderBy(F.desc("score"), "url"))})
    top = rows.filter(F.col("rank") <= most)
    return top.groupBy("symbol_era_id").agg(
        F.min_by("bucket", "rank").alias("bucket"),
        F.max("score").alias("score"),
        F.count("*").alias("documents"),
        F.concat_ws(" | ", F.array_sort(F.collect_set("reason"))).alias("reasons"),
        F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"])).alias("top_documents"),
    )


def triage(hits: DataFrame, most: int = 3) -> DataFrame:
    """Search hits scored by form, date, entity and rank; the best of each era with their bucket.

    ``hits`` has symbol_era_id, symbol, form_strength, filed (date), first_day, last_day, entity and hit_rank.
    """
    first, last, filed = F.to_date("first_day", "yyyyMMdd"), F.to_date("last_day", "yyyyMMdd"), F.col("filed")
    form = F.when(F.col("form_strength") == "deal_form", 60).when(F.col("form_strength") == "exchange_exit_form", 55).when(F.col("form_strength") == "review_form", 25).otherwise(5)
    unknown = filed.isNull() | first.isNull() | last.isNull()
    relation = (
        F.when(unknown, "unknown_date")
        .when(filed.between(first, last), "inside_symbol_era")
        .when(F.datediff(filed, last).between(0, 730), "near_after_symbol_era")
        .when(F.datediff(first, filed).between(0, 365), "near_before_symbol_era")
        .otherwise("outside_symbol_era")
    )
    points = {"unknown_date": 0, "inside_symbol_era": 30, "near_after_symbol_era": 20, "near_before_symbol_era": 10, "outside_symbol_era": -15}
    dated = F.element_at(F.create_map(*[F.lit(x) for kv in points.items() for x in kv]), F.col("date_relation"))
    words = F.split(F.upper(F.coalesce("entity", F.lit(""))), "[^A-Z0-9]+")
    own = (F.length("symbol") > 1) & F.array_contains(words, F.col("symbol"))
    entity = F.when(F.coalesce("entity", F.lit("")) == "", "unknown_entity").when(own, "symbol_token_in_entity").when(F.length("symbol") <= 2, "short_symbol_no_entity_match").otherwise("no_entity_match")
    named = F.when(F.col("entity_match") == "symbol_token_in_entity", 20).when(F.col("entity_match") == "short_symbol_no_entity_match", -15).otherwise(0)
    rows = hits.withColumns({"date_relation": relation, "entity_match": entity})
    rows = rows.withColumn("triage_score", form + dated + named + F.greatest(F.lit(0), 11 - F.col("hit_rank")))
    strong = F.col("form_strength").isin("deal_form", "exchange_exit_form")
    useful, exact = F.col("date_relation").isin("inside_symbol_era", "near_after_symbol_era"), F.col("entity_match") == "symbol_token_in_entity"
    bucket = (
        F.when(F.col("entity_match") == "short_symbol_no_entity_match", "manual_review_lead")
        .when(strong & useful & exact, "high_confidence_lead")
        .when((strong & (useful | exact)) | ((F.col("form_strength") == "review_form") & useful & exact), "medium_confidence_lead")
        .otherwise("manual_review_lead")
    )
    order = Window.partitionBy("symbol_era_id").orderBy(F.desc("triage_score"), "hit_rank", "url")
    return rows.withColumns({"confidence_bucket": bucket, "triage_rank": F.row_number().over(order)}).filter(F.col("triage_rank") <= most)


def stratified_filings(filings: DataFrame, boundary: str = "boundary") -> DataFrame:
    """Of each era the filings nearest to a boundary date: some of each stratum of forms."""
    stratum, most = F.lit(None).cast("string"), F.lit(0)
    for name, forms, n in FILING_STRATA:
        inside = F.upper("form").isin(*forms)
        stratum, most = F.when(inside, name).otherwise(stratum), F.when(inside, n).otherwise(most)
    distance = F.coalesce(F.abs(F.datediff("filing_date", F.col(boundary))), F.lit(100_000))
    rows = filings.withColumns({"stratum": stratum, "_most": most, "distance": distance}).filter("stratum is not null")
    rank = F.row_number().over(Window.partitionBy("symbol_era_id", "stratum").orderBy("distance", "accession_no"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= F.col("_most")).drop("_most")


def identity_buckets(eras: DataFrame, evidence: DataFrame, before: int = 45, after: int = 90) -> DataFrame:
    """How many registrants name an era's symbol in filings around it, and what follows from that.

    ``evidence`` has ticker, cik and filing_date (date).
    """
    lo, hi = F.date_sub(F.to_date("first_day", "yyyyMMdd"), before), F.date_add(F.to_date("last_day", "yyyyMMdd"), after)
    spans = eras.select("symbol_era_id", "symbol", lo.alias("_lo"), hi.alias("_hi"))
    joined = spans.join(evidence, (F.col("symbol") == F.col("ticker")) & F.col("filing_date").between(F.col("_lo"), F.col("_hi")), "left")
    out = joined.groupBy("symbol_era_id").agg(F.count("ticker").alias("evidence"), F.count_distinct("cik").alias("ciks"), F.min("cik").alias("_cik"))
    bucket = F.when(F.col("ciks") > 1, "identity_collision_hold").when(F.col("ciks") == 1, "identity_verified_ready").when(F.col("evidence") == 0, "identity_no_evidence").otherwise("identity_weak_hold")
    return out.withColumns({"identity_bucket": bucket, "identity_cik": F.when(F.col("ciks") == 1, F.col("_cik"))}).drop("_cik")


def ledger_candidates(plan: DataFrame, resolver: str = "low_materiality_v1") -> DataFrame:
    """Rows of the low-materiality bucket as ledger rows, filled alike and for a dry run."""
    reason = F.format_string("trade_rows=%s; observed_days=%s; no current evidence", F.col("trade_rows").cast("string"), F.col("observed_days").cast("string"))
    rows = plan.filter("workplan_bucket = 'low_materiality_bulk_disposition'")
    return rows.select("symbol", "symbol_era_id", F.lit("terminal_disposition").alias("resolution_status"), F.lit("low_materiality").alias("resolution_category"), reason.alias("source_note"), F.lit(resolver).alias("resolver")).dropDuplicates(["symbol_era_id"])


def template(rows: DataFrame, preferred: list[str], to_fill: list[str]) -> DataFrame:
    """The preferred columns that a table has, and empty text columns to be filled by hand."""
    have = [c for c in preferred if c in rows.columns]
    return rows.select(*have, *[F.lit(None).cast("string").alias(c) for c in to_fill if c not in have])


def attach(plan: DataFrame, extra: DataFrame, defaults: dict) -> DataFrame:
    """A worklist with another table's columns by era, and defaults where that has none."""
    return plan.join(extra, "symbol_era_id", "left").fillna(defaults)


def parent_links(derived: DataFrame, roots: DataFrame) -> DataFrame:
    """Derived securities with the best row of the symbol that theirs points to.

    ``roots`` has symbol, symbol_era_id, evidence_score and url; the best has the greatest score, of
    equals the least url.
    """
    order = Window.partitionBy("symbol").orderBy(F.desc("evidence_score"), "url", "symbol_era_id")
    best = roots.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    best = best.select(F.col("symbol").alias("parent_symbol"), F.col("symbol_era_id").alias("parent_era_id"), F.col("evidence_score").alias("parent_score"))
    return derived.withColumn("parent_symbol", classify.parent_root(F.col("symbol"))).join(best, "parent_symbol")


def sector_table(eras: DataFrame, ciks: DataFrame, sic: DataFrame, classes: DataFrame, tickers: DataFrame) -> DataFrame:
    """Eras with registrant, SIC code and division, instrument class, coverage and continuity.

    ``ciks`` has symbol_era_id and resolved_cik, ``sic`` cik and sic, ``classes`` symbol_era_id and
    stable_openfigi_class, ``tickers`` cik and current_tickers (array).
    """
    out = eras.join(ciks, "symbol_era_id", "left")
    out = out.join(sic.withColumnRenamed("cik", "resolved_cik"), "resolved_cik", "left").join(classes, "symbol_era_id", "left")
    out = out.join(tickers.withColumnRenamed("cik", "resolved_cik"), "resolved_cik", "left")
    out = out.withColumn("instrument_class", F.coalesce("identity_instrument", "stable_openfigi_class"))
    return out.withColumns(
        {
            "sector_code": classify.sic_division(F.col("sic"), 0),
            "sector_name": classify.sic_division(F.col("sic"), 1),
            "sic_coverage_status": classify.sic_coverage(F.col("sic"), F.col("resolved_cik"), F.col("instrument_class")),
            "continuity_status": classify.continuity(F.col("symbol"), F.col("current_tickers")),
        }
    ).drop("current_tickers")


# Columns that research fills in, and the forms that tell what a lead is about.
RESEARCH = (
    "research_status", "proposed_historical_identity_status", "proposed_historical_issuer_name", "proposed_historical_event_type", "proposed_historical_event_date", "proposed_historical_successor", "primary_source_url", "secondary_source_url", "research_note",
)
LEAD = ("triage_bucket", "triage_score", "triage_reason", "cik", "entity", "form", "filed_at", "accession_no")
BUCKETS = ("high_confidence_lead", "medium_confidence_lead", "manual_review_lead")


def lead_candidates(template: DataFrame, triage: DataFrame, least: str = "manual_review_lead", anchored: bool = False, base: str = "https://www.sec.gov/Archives/edgar/data") -> DataFrame:
    """Template rows with the best search hit of their era, as candidates that need a review.

    Hits of rank 1 whose bucket is ``least`` or better count. Rows meet by symbol and era; with
    ``anchored`` by first and last day too, so that the windows around an era's first and last day
    stay apart, and the template says which of them a row is (lifecycle_anchor).
    """
    keys = ["symbol", "symbol_era_id"] + (["first_day", "last_day"] if anchored else [])
    best = triage.filter(F.col("triage_rank").try_cast("int") == 1).filter(F.col("triage_bucket").isin(*BUCKETS[: BUCKETS.index(least) + 1])).select(*keys, *LEAD)
    rows = template.drop(*[c for c in (*RESEARCH, *LEAD) if c in template.columns]).join(best, keys)
    c = F.col
    form, first = F.upper(F.trim(F.coalesce("form", F.lit("")))), c("lifecycle_anchor") == "first" if anchored else F.lit(False)
    other = "operating_lifecycle_terminal_lead" if anchored else "merger_or_acquisition_lead"
    event = (
        F.when(first, "trading_commencement_or_symbol_lifecycle_lead").when(form.isin("25-NSE", "15-12B"), "delisting_or_registration_termination_lead")
        .when(form.isin("SC 13E3", "SC 13E3/A"), "going_private_lead").otherwise(other)
    )
    cik, accession = F.ltrim(F.coalesce(c("cik").cast("string"), F.lit("")), F.lit("0")), F.replace(F.coalesce("accession_no", F.lit("")), F.lit("-"), F.lit(""))
    score = c("triage_score").cast("string")
    if anchored:
        note = F.concat(F.lit("SEC lifecycle "), c("lifecycle_anchor"), F.lit("-anchor triage "), c("triage_bucket"), F.lit(" score="), score, F.lit("; "), c("triage_reason"), F.lit("."))
    else:
        note = F.concat(
            F.lit("SEC triage "), c("triage_bucket"), F.lit(" score="), score, F.lit("; "), c("triage_reason"), F.lit("; form="), c("form"),
            F.lit(". Verify issuer, CIK, event, successor, and final delisting/closing before changing research_status to verified."),
        )
    empty = F.lit(None).cast("string")
    filled = {
        "research_status": F.lit("candidate_needs_review"), "proposed_historical_identity_status": F.lit("manual_verified_historical_identity"),
        "proposed_historical_issuer_name": F.trim(F.regexp_replace(F.trim(F.coalesce("entity", F.lit(""))), r"(\s+\([^)]*\))+$", "")), "proposed_historical_event_type": event, "proposed_historical_event_date": c("filed_at"),
        "proposed_historical_successor": empty, "primary_source_url": F.when((cik != "") & (accession != ""), F.concat_ws("/", F.lit(base), cik, accession, F.lit(""))), "secondary_source_url": empty, "research_note": note,
    }
    carried = [x for x in rows.columns if x not in LEAD]
    return rows.select(*carried, *[v.alias(k) for k, v in filled.items()], *LEAD)


def joined_review_queue(eras: DataFrame, listings: DataFrame, overrides: DataFrame, ledger: DataFrame, facts: DataFrame) -> DataFrame:
    """The review queue of eras from the tables that it draws on, each joined once by era.

    ``eras`` has the registry's columns, ``listings`` the snapshots', ``overrides`` those set by hand,
    ``ledger`` resolution_status and ``facts`` the best verified facts'.
    """
    seen = [c for c in ("symbol_era_id", "iex_entity_confidence", "iex_latest_issuer", "iex_product_hint", "iex_seen_in_latest") if c in listings.columns]
    rows = eras.join(listings.select(*seen), "symbol_era_id", "left")
    for other in (overrides, ledger, facts):
        rows = rows.join(other, "symbol_era_id", "left")
    return review_queue(rows)


def enriched_eras(eras: DataFrame, identities: DataFrame, events: DataFrame) -> DataFrame:
    """Eras with the best identity and the best event, whether the identity may be used, and the span in days.

    ``identities`` has symbol_era_id, identity_tier, identity_contested and more, ``events`` symbol_era_id
    and more; both have an era once.
    """
    day = lambda c: F.to_date(c, "yyyyMMdd")
    rows = eras.join(identities, "symbol_era_id", "left").join(events, "symbol_era_id", "left")
    usable = classify.usable_by_default(F.col("identity_tier"), F.coalesce("identity_contested", F.lit(False)))
    return rows.withColumns({"identity_usable_default": usable, "era_span_days": F.datediff(day("last_day"), day("first_day"))})
