"""Queries on instruments, reviews, identities, listings, names and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import classify, names
from tapeline.operators import facts, linking, listings, worklists
from tapeline.plans import book as b
from tapeline.plans.registry import Inputs, query


def _queue(t: Inputs) -> DataFrame:
    rows = b.book(t).withColumns({"iex_latest_issuer": F.col("issuer"), "_symbol": F.col("symbol"), "symbol": F.col("ticker")})
    return worklists.review_queue(rows).withColumn("symbol", F.col("_symbol"))


_DOUBTFUL = "source_classification IN ('delisted_or_acquired_candidate', 'intermittent_or_reused_candidate', 'intermittent_full_window_candidate', 'partial_window_candidate')"


@query("SELECT symbol_era_id, ticker, instrument_type, instrument_reason, research_route, CASE WHEN instrument_type IN ('probable_fund_or_trust', 'probable_warrant', 'probable_unit', 'probable_right') THEN instrument_type WHEN instrument_type = 'probable_preferred' THEN 'possible_preferred' ELSE 'probable_operating_or_other' END AS instrument_hint, 'instrument_type=' || instrument_type AS routing_reason FROM routed", "routed")
def instrument_types(t: Inputs) -> DataFrame:
    args = (F.col("ticker"), F.col("iex_product_hint"), F.col("issuer"))
    out = b.book(t).withColumns({"instrument_type": classify.instrument_type(*args), "instrument_reason": classify.instrument_reason(*args)})
    kind = F.col("instrument_type")
    return out.select("symbol_era_id", "ticker", "instrument_type", "instrument_reason", classify.research_route(kind).alias("research_route"), classify.instrument_hint(kind).alias("instrument_hint"), F.concat(F.lit("instrument_type="), kind).alias("routing_reason"))


@query(
    f"SELECT symbol_era_id, instrument_type, research_route, identity_evidence_status, resolution_workflow_status, CASE WHEN historical_identity_status IS NOT NULL THEN 0 WHEN identity_evidence_status = 'historical_identity_unresolved' THEN 1 WHEN source_classification = 'intermittent_or_reused_candidate' THEN 2 WHEN source_classification = 'delisted_or_acquired_candidate' THEN 3 ELSE 4 END AS review_priority FROM routed WHERE {_DOUBTFUL}",
    "routed",
)
def review_queue(t: Inputs) -> DataFrame:
    return _queue(t).select("symbol_era_id", "instrument_type", "research_route", "identity_evidence_status", "resolution_workflow_status", "review_priority")


@query(
    f"SELECT symbol_era_id, CAST(row_number() OVER (ORDER BY instrument_type = 'probable_operating_company' DESC, source_classification = 'delisted_or_acquired_candidate' DESC, trade_rows DESC, symbol, symbol_era_id) AS INTEGER) AS priority_rank FROM routed WHERE {_DOUBTFUL} AND identity_evidence_status = 'historical_identity_unresolved' AND resolution_workflow_status = 'needs_resolution'",
    "routed",
)
def priority_queue(t: Inputs) -> DataFrame:
    return worklists.prioritized(_queue(t)).select("symbol_era_id", "priority_rank")


def _lanes(t: Inputs) -> DataFrame:
    args = (F.col("ticker"), F.col("iex_product_hint"), F.col("issuer"))
    rows = b.book(t).withColumn("research_route", classify.research_route(classify.instrument_type(*args)))
    rows = rows.withColumn("resolution_lane", classify.resolution_lane(F.col("research_route"), F.col("source_classification"), F.col("trade_rows"), 5))
    return worklists.impact(rows)


@query(
    """SELECT symbol_era_id, resolution_lane, CAST(impact_rank AS INTEGER) AS impact_rank, CAST(cumulative_trade_rows AS BIGINT) AS cumulative_trade_rows,
    round(cumulative_trade_rows / everything * 100, 6) AS cumulative_trade_rows_pct,
    CASE WHEN trade_rows >= 100 THEN '100-999' WHEN trade_rows >= 1 THEN '1-99' ELSE '0' END AS tier,
    CASE WHEN research_route = 'operating_company_sec_event' AND (impact_rank <= 100 OR trade_rows >= 50) THEN 'high_impact_operating'
    WHEN research_route IN ('preferred_redemption_or_delisting', 'warrant_unit_right_security_action', 'share_class_corporate_action') THEN 'derivative_parent_resolution'
    WHEN trade_rows <= 3 AND observed_days <= 5 AND evidence = 'historical_identity_unresolved' AND research_route <> 'manual_syntax_review' AND resolution_lane <> 'manual_syntax' THEN 'low_materiality_bulk_disposition'
    WHEN resolution_lane IN ('operating_partial_window', 'operating_sparse_intermit', 'operating_intermit_material') THEN 'operating_lifecycle_search' ELSE 'manual_review_hold' END AS workplan_bucket FROM lanes""",
    "lanes",
)
def workplan(t: Inputs) -> DataFrame:
    tier = classify.trade_tier(F.least(F.col("trade_rows"), F.lit(999)))
    return _lanes(t).select("symbol_era_id", "resolution_lane", "impact_rank", "cumulative_trade_rows", "cumulative_trade_rows_pct", tier.alias("tier"), classify.workplan_bucket(100, 50, 3, 5).alias("workplan_bucket"))


@query("SELECT resolution_lane AS bucket, count(*) AS rows, CAST(sum(trade_rows) AS BIGINT) AS trade_rows FROM lanes GROUP BY 1", "lanes")
def count_and_trade(t: Inputs) -> DataFrame:
    return _lanes(t).groupBy(F.col("resolution_lane").alias("bucket")).agg(F.count("*").alias("rows"), F.sum("trade_rows").alias("trade_rows"))


@query(r"SELECT ticker, CASE WHEN regexp_matches(ticker, '[-.]') THEN regexp_replace(ticker, '[-.].*$', '') WHEN regexp_matches(ticker, '(WS|WT|RT)$') THEN left(ticker, -2) WHEN regexp_matches(ticker, '[WU+=^]$') THEN left(ticker, -1) END AS root, count(*) AS eras FROM book GROUP BY ALL", "book")
def parent_roots(t: Inputs) -> DataFrame:
    return b.book(t).groupBy("ticker", classify.parent_root(F.col("ticker")).alias("root")).agg(F.count("*").alias("eras"))


@query("SELECT p_partkey, sic, CASE WHEN c BETWEEN 100 AND 999 THEN 'A' WHEN c BETWEEN 1000 AND 1499 THEN 'B' WHEN c BETWEEN 1500 AND 1799 THEN 'C' WHEN c BETWEEN 2000 AND 3999 THEN 'D' WHEN c BETWEEN 4000 AND 4999 THEN 'E' WHEN c BETWEEN 5000 AND 5199 THEN 'F' WHEN c BETWEEN 5200 AND 5999 THEN 'G' WHEN c BETWEEN 6000 AND 6799 THEN 'H' WHEN c BETWEEN 7000 AND 8999 THEN 'I' WHEN c BETWEEN 9100 AND 9729 THEN 'J' END AS division, CASE WHEN c IS NOT NULL THEN 'sic_and_sector' ELSE 'other' END AS known FROM (SELECT *, TRY_CAST(sic AS BIGINT) AS c FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE CAST((p_partkey * 137) % 10000 AS VARCHAR) END AS sic FROM part))")
def sic_divisions(t: Inputs) -> DataFrame:
    sic = F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(((F.col("p_partkey") * 137) % 10000).cast("string"))
    known = F.when(F.col("sic").try_cast("long").isNotNull(), "sic_and_sector").otherwise("other")
    return t.table("part").select("p_partkey", sic.alias("sic")).withColumns({"division": classify.sic_division(F.col("sic")), "known": known})


@query(
    """SELECT symbol_era_id, CASE WHEN x = 0 THEN 'sic_and_sector' WHEN y THEN 'cik_no_sic' WHEN z THEN 'fund_no_sic_needed' ELSE 'no_cik' END AS status
    FROM (SELECT symbol_era_id, n % 4 AS x, n % 3 = 0 AS y, n % 5 = 0 AS z FROM book)""",
    "book",
)
def sic_coverage(t: Inputs) -> DataFrame:
    n = F.col("n")
    status = classify.sic_coverage(F.when(n % 4 == 0, "7372"), F.when(n % 3 == 0, "1"), F.when(n % 5 == 0, "fund_etf"))
    return b.book(t).select("symbol_era_id", status.alias("status"))


@query(
    """SELECT symbol_era_id, CASE tier WHEN 'A' THEN ltrim(entity_id, '0') WHEN 'B' THEN CAST(n % 700 + 1 AS VARCHAR) WHEN 'C' THEN ltrim(cik, '0') WHEN 'D' THEN CAST(n % 90 AS VARCHAR) WHEN 'E' THEN 'E' || (n % 9) END AS resolved_cik,
    CASE tier WHEN 'A' THEN 'sec_date_scoped_display_names' WHEN 'B' THEN 'legacy_historical_override_url_derived' WHEN 'C' THEN 'sec_current_ticker_match' WHEN 'D' THEN 'sec_name_matched' WHEN 'E' THEN 'edgar_company_search_matched' ELSE 'no_cik_available' END AS cik_source, tier AS cik_tier
    FROM (SELECT *, CASE WHEN n % 5 = 0 AND n % 3 = 0 AND regexp_matches(entity_id, '^[0-9]+$') THEN 'A' WHEN n % 5 = 0 AND n % 3 = 1 AND n % 2 = 0 THEN 'B'
    WHEN source_classification IN ('stable_candidate', 'ipo_or_new_listing_candidate') AND sec_current_confidence = 'sec_current_match' THEN 'C' WHEN n % 4 = 0 THEN 'D' WHEN n % 7 = 0 THEN 'E' END AS tier
    FROM (SELECT *, CASE WHEN n % 13 = 0 THEN 'x' ELSE lpad(CAST(n % 800 + 1 AS VARCHAR), 10, '0') END AS entity_id FROM book))""",
    "book",
)
def cik_tiers(t: Inputs) -> DataFrame:
    n = F.col("n")
    url = F.concat(F.lit("https://archive.example/data/000"), (n % 700 + 1).cast("string"), F.lit("/x.txt"))
    rows = b.book(t).withColumns(
        {
            "identity_tier": F.when(n % 5 == 0, "verified").otherwise("candidate"),
            "identity_method": b.pick(b.METHODS, n),
            "identity_entity_id": F.when(n % 13 == 0, "x").otherwise(F.lpad((n % 800 + 1).cast("string"), 10, "0")),
            "identity_source_url": F.when(n % 2 == 0, url),
            "sec_cik": F.col("cik"),
            "name_matched_cik": F.when(n % 4 == 0, (n % 90).cast("string")),
            "edgar_matched_cik": F.when(n % 7 == 0, F.concat(F.lit("E"), (n % 9).cast("string"))),
        }
    )
    got = rows.withColumn("r", classify.resolved_cik())
    return got.select("symbol_era_id", F.col("r.cik").alias("resolved_cik"), F.col("r.source").alias("cik_source"), F.col("r.tier").alias("cik_tier"))


@query("SELECT symbol_era_id, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN 'terminal' WHEN n % 4 = 2 THEN 'still_active_same_symbol' ELSE 'renamed_or_successor' END AS continuity_status FROM book", "book")
def continuity(t: Inputs) -> DataFrame:
    n = F.col("n") % 4
    tickers = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.lit(None).cast("string"), F.col("symbol"))).when(n == 3, F.array(F.lit("OTHER"), F.lit(None).cast("string")))
    return b.book(t).select("symbol_era_id", classify.continuity(F.col("symbol"), tickers).alias("continuity_status"))


@query("SELECT symbol_era_id, verification_state, issuer, entity_id, o_orderkey, coalesce(verification_state IN ('verified', 'corroborated') OR (verification_state = 'openfigi_asserted' AND NOT contested), false) AS usable FROM best", "best")
def best_identities(t: Inputs) -> DataFrame:
    usable = classify.usable_by_default(F.col("verification_state"), F.col("contested"))
    return b.best(t).select("symbol_era_id", "verification_state", "issuer", "entity_id", "o_orderkey", usable.alias("usable"))


@query("SELECT symbol_era_id, fact_id, created_at, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY symbol_era_id ORDER BY created_at DESC, fact_id DESC, o_orderkey DESC) AS k FROM found) WHERE k = 1 AND verification_state = 'verified'", "found")
def latest_verified(t: Inputs) -> DataFrame:
    return facts.latest_facts(b.found(t), order=[F.desc("o_orderkey")]).filter("verification_state = 'verified'").select("symbol_era_id", "fact_id", "created_at", "o_orderkey")


@query("SELECT symbol_era_id, i.issuer, e.created_at AS event_date FROM (SELECT * FROM best WHERE batch <> 'F') i FULL JOIN (SELECT * FROM best WHERE batch <> 'O') e USING (symbol_era_id)", "best")
def identities_and_events(t: Inputs) -> DataFrame:
    best = b.best(t)
    return facts.identities_and_events(best.filter("batch <> 'F'").select("symbol_era_id", "issuer"), best.filter("batch <> 'O'").select("symbol_era_id", F.col("created_at").alias("event_date")))


@query("SELECT fact_id, symbol_era_id, o_orderkey FROM found WHERE batch = 'F' UNION ALL SELECT fact_id, symbol_era_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY o_orderkey) AS k FROM found WHERE batch <> 'F') WHERE k = 1 AND fact_id NOT IN (SELECT fact_id FROM found WHERE batch = 'F')", "found")
def fact_merge(t: Inputs) -> DataFrame:
    rows = b.found(t).select("fact_id", "symbol_era_id", "o_orderkey", "batch")
    return facts.merge(rows.filter("batch = 'F'"), rows.filter("batch <> 'F'"), [F.col("o_orderkey")]).drop("batch")


@query("SELECT fact_id, symbol_era_id, o_orderkey FROM found WHERE batch = 'F' AND fact_id NOT IN (SELECT fact_id FROM found WHERE batch <> 'F') UNION ALL SELECT fact_id, symbol_era_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY o_orderkey DESC) AS k FROM found WHERE batch <> 'F') WHERE k = 1", "found")
def fact_replace(t: Inputs) -> DataFrame:
    rows = b.found(t).select("fact_id", "symbol_era_id", "o_orderkey", "batch")
    return facts.replace(rows.filter("batch = 'F'"), rows.filter("batch <> 'F'"), [F.col("o_orderkey")]).drop("batch")


@query("SELECT fact_id, symbol_era_id FROM found f WHERE batch <> 'F' AND NOT EXISTS (SELECT 1 FROM found s WHERE s.batch = 'F' AND s.fact_id = f.fact_id) AND NOT EXISTS (SELECT 1 FROM found s WHERE s.batch = 'F' AND s.symbol_era_id = f.symbol_era_id AND s.verification_state = 'verified')", "found")
def staged_additions(t: Inputs) -> DataFrame:
    rows = b.found(t)
    return facts.staged_additions(rows.filter("batch = 'F'"), rows.filter("batch <> 'F'")).select("fact_id", "symbol_era_id")


@query(
    """SELECT symbol, symbol_era_id, be AS entity_id, bi AS instrument, bid AS before_era_id, aid AS after_era_id FROM (SELECT *, lag(e) OVER w AS be, lead(e) OVER w AS ae, lag(i) OVER w AS bi, lead(i) OVER w AS ai,
    lag(symbol_era_id) OVER w AS bid, lead(symbol_era_id) OVER w AS aid, lag(last_day) OVER w AS bl, lead(first_day) OVER w AS af
    FROM (SELECT *, CASE WHEN n % 3 <> 0 THEN CAST(n % 2 + 1 AS VARCHAR) END AS e, CASE WHEN n % 3 <> 0 THEN 'common' END AS i FROM book) WINDOW w AS (PARTITION BY symbol ORDER BY first_day, symbol_era_id))
    WHERE e IS NULL AND be = ae AND bi = ai AND bl < first_day AND last_day < af""",
    "book",
)
def bridged_gaps(t: Inputs) -> DataFrame:
    rows = b.book(t)
    known = rows.filter("n % 3 <> 0").select("symbol_era_id", F.lpad((F.col("n") % 2 + 1).cast("string"), 4, "0").alias("entity_id"), F.lit("common").alias("instrument"))
    return facts.bridged_gaps(rows, known)


@query("SELECT symbol, min(snapshot_date) AS iex_first_seen, max(snapshot_date) AS iex_last_seen, count(*) AS iex_seen_days, arg_max(issuer, snapshot_date) AS iex_latest_issuer, CAST(count(DISTINCT nullif(issuer, '')) AS INTEGER) AS iex_issuer_variant_count, coalesce(array_to_string(list_sort(list(DISTINCT nullif(issuer, ''))), ' | '), '') AS iex_issuer_variants, max(snapshot_date) = (SELECT max(snapshot_date) FROM shots) AS iex_seen_in_latest FROM shots GROUP BY symbol", "shots")
def listing_lifecycle(t: Inputs) -> DataFrame:
    return listings.lifecycle(b.shots(t)).select("symbol", "iex_first_seen", "iex_last_seen", "iex_seen_days", "iex_latest_issuer", "iex_issuer_variant_count", "iex_issuer_variants", "iex_seen_in_latest")


@query(
    """SELECT f0 AS from_snapshot, t0 AS to_snapshot, coalesce(o.symbol, n.symbol) AS symbol, CASE WHEN o.symbol IS NULL THEN 'added' WHEN n.symbol IS NULL THEN 'removed' ELSE 'changed' END AS event_type,
    CASE WHEN o.symbol IS NOT NULL AND n.symbol IS NOT NULL THEN concat_ws(',', CASE WHEN o.issuer <> n.issuer THEN 'issuer' END, CASE WHEN o.is_enabled <> n.is_enabled THEN 'is_enabled' END, CASE WHEN o.lit <> n.lit THEN 'lit' END) END AS change_fields,
    o.issuer AS old_issuer, n.issuer AS new_issuer
    FROM (SELECT x.*, s.t FROM shots x JOIN steps s ON s.f = x.snapshot_date) o FULL JOIN (SELECT x.*, s.f FROM shots x JOIN steps s ON s.t = x.snapshot_date) n ON o.snapshot_date = n.f AND o.symbol = n.symbol
    JOIN (SELECT f AS f0, t AS t0 FROM steps) z ON z.f0 = coalesce(o.snapshot_date, n.f) WHERE NOT coalesce(o.issuer = n.issuer AND o.is_enabled = n.is_enabled AND o.lit = n.lit, false)""",
    "steps",
)
def listing_differences(t: Inputs) -> DataFrame:
    return listings.differences(b.shots(t))


@query(
    """SELECT f AS from_snapshot, t AS to_snapshot, a.n AS from_count, c.n AS to_count, c.n - a.n AS net_count_change,
    (SELECT count(*) FROM shots s WHERE s.snapshot_date = t AND s.symbol NOT IN (SELECT symbol FROM shots p WHERE p.snapshot_date = f)) AS added_count
    FROM steps JOIN (SELECT snapshot_date, count(*) AS n FROM shots GROUP BY 1) a ON a.snapshot_date = f JOIN (SELECT snapshot_date, count(*) AS n FROM shots GROUP BY 1) c ON c.snapshot_date = t""",
    "steps",
)
def listing_daily_changes(t: Inputs) -> DataFrame:
    return listings.daily_changes(b.shots(t)).select("from_snapshot", "to_snapshot", "from_count", "to_count", "net_count_change", "added_count")


@query(
    """SELECT symbol_era_id, CASE WHEN s.symbol IS NULL THEN 'iex_snapshot_unmatched' WHEN v > 1 AND o THEN 'iex_snapshot_changed_during_window' WHEN gone OR l < '20010101' THEN 'iex_snapshot_removed_before_latest'
    WHEN o THEN 'iex_snapshot_overlap' WHEN last_day < '19980101' AND NOT gone THEN 'iex_current_symbol_only' WHEN first_day > '20010101' THEN 'iex_seen_before_era' ELSE 'iex_snapshot_matched' END AS iex_entity_confidence
    FROM (SELECT *, last_day >= '19980101' AND first_day <= '20010101' AS o, 'C' || (n % 80) AS c FROM book) e LEFT JOIN (SELECT symbol, count(DISTINCT nullif(issuer, '')) AS v, replace(max(snapshot_date), '-', '') AS l,
    max(snapshot_date) <> (SELECT max(snapshot_date) FROM shots) AS gone FROM shots GROUP BY 1) s ON s.symbol = c""",
    "book", "shots",
)
def listing_confidence(t: Inputs) -> DataFrame:
    eras = b.book(t).withColumn("symbol", F.concat(F.lit("C"), (F.col("n") % 80).cast("string"))).select("symbol", "symbol_era_id", "first_day", "last_day")
    return listings.enrich_eras(eras, listings.lifecycle(b.shots(t)), "19980101", "20010101").select("symbol_era_id", "iex_entity_confidence")


_PAIRS = """(SELECT a.symbol AS a_symbol, a.symbol_era_id AS a_symbol_era_id, a.trade_rows AS wa, c.symbol AS b_symbol, c.symbol_era_id AS b_symbol_era_id, c.trade_rows AS wb, a.last_day AS ld, c.first_day AS fd,
date_diff('day', strptime(a.last_day, '%Y%m%d')::DATE, strptime(c.first_day, '%Y%m%d')::DATE) AS gap_days, a.cik AS ac, c.cik AS cc
FROM book a JOIN book c ON a.symbol <> c.symbol AND strptime(c.first_day, '%Y%m%d')::DATE - strptime(a.last_day, '%Y%m%d')::DATE BETWEEN 1 AND 2)"""


def _pairs(t: Inputs) -> DataFrame:
    return linking.successor_pairs(b.book(t).withColumn("issuer", F.lit(None).cast("string")), 2)


@query(f"SELECT a_symbol_era_id, b_symbol_era_id, CAST(gap_days AS INTEGER) AS gap_days, round(1 - (gap_days - 1) / 2, 4) AS boundary_score, CASE WHEN ac = cc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cik_score FROM {_PAIRS}", "book")
def rename_pairs(t: Inputs) -> DataFrame:
    return _pairs(t).select("a_symbol_era_id", "b_symbol_era_id", "gap_days", "boundary_score", "cik_score")


@query(
    f"""SELECT a_symbol_era_id, b_symbol_era_id FROM (SELECT *, row_number() OVER (PARTITION BY a_symbol_era_id ORDER BY wb DESC, score DESC, b_symbol_era_id) AS s, row_number() OVER (PARTITION BY b_symbol_era_id ORDER BY wa DESC, score DESC, a_symbol_era_id) AS p
    FROM (SELECT *, round(0.35 * round(1 - (gap_days - 1) / 2, 4) + 0.25 * round(least(wa, wb) / greatest(wa, wb), 4) + 0.25 * 0.3 + 0.15 * CASE WHEN ac = cc THEN 1.0 ELSE 0.0 END, 4) AS score FROM {_PAIRS})) WHERE s = 1 AND p = 1""",
    "book",
)
def mutual_best(t: Inputs) -> DataFrame:
    return linking.mutual_best(_pairs(t)).select("a_symbol_era_id", "b_symbol_era_id")


@query(
    """SELECT symbol_era_id, doc, 'delist_window' AS match_basis FROM m WHERE abs(date_diff('day', strptime(last_day, '%Y%m%d')::DATE, ev)) <= 45
    UNION ALL SELECT symbol_era_id, doc, 'inception_window' FROM m WHERE abs(date_diff('day', strptime(first_day, '%Y%m%d')::DATE, inc)) <= 45""",
    "m",
)
def catalog_matches(t: Inputs) -> DataFrame:
    return linking.catalog_matches(b.book(t), _catalog(t)).select("symbol_era_id", "doc", "match_basis")


def _catalog(t: Inputs) -> DataFrame:
    date = F.to_date("o_orderdate")
    return t.table("orders").select(F.concat(F.lit("X"), (F.col("o_custkey") % 97).cast("string")).alias("ticker"), F.col("o_orderkey").alias("doc"), date.alias("event_date"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(date, 20)).alias("inception_date"))


@query("SELECT basis, count(DISTINCT symbol_era_id) AS eras, count(*) AS match_rows, round(count(DISTINCT symbol_era_id) / (SELECT count(*) FROM book), 4) AS share FROM (SELECT symbol_era_id, 'delist_window' AS basis FROM m WHERE abs(date_diff('day', strptime(last_day, '%Y%m%d')::DATE, ev)) <= 45) GROUP BY basis", "m")
def catalog_coverage(t: Inputs) -> DataFrame:
    eras = b.book(t)
    found = linking.catalog_matches(eras, _catalog(t)).filter("match_basis = 'delist_window'").groupBy(F.col("match_basis").alias("basis")).agg(F.count_distinct("symbol_era_id").alias("eras"), F.count("*").alias("match_rows"))
    total = eras.agg(F.count("*").alias("_all"))
    return found.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("eras") / F.col("_all"), 4)).drop("_all")  # one row


@query("SELECT old_era_id, new_era_id, match_kind FROM (SELECT symbol_era_id AS old_era_id, CASE WHEN n % 5 = 0 THEN symbol_era_id || 'b' ELSE symbol_era_id END AS new_era_id, CASE WHEN n % 7 = 0 THEN 'last_day_shift' WHEN n % 11 = 0 THEN 'first_day_shift' WHEN n % 5 = 0 THEN 'id_shift' ELSE 'unchanged' END AS match_kind, n FROM book) WHERE NOT (n % 77 = 0)", "book")
def era_remap(t: Inputs) -> DataFrame:
    rows = b.book(t)
    moved = lambda c, k, d: F.when(F.col("n") % k == 0, F.date_format(F.date_add(F.to_date(c, "yyyyMMdd"), d), "yyyyMMdd")).otherwise(F.col(c))
    old = rows.select("symbol", "symbol_era_id", F.date_format(F.to_date("first_day", "yyyyMMdd"), "yyyy-MM-dd").alias("first_day"), "last_day")
    new = rows.withColumns({"symbol_era_id": F.when(F.col("n") % 5 == 0, F.concat("symbol_era_id", F.lit("b"))).otherwise(F.col("symbol_era_id")), "last_day": moved("last_day", 7, 3), "first_day": moved("first_day", 11, -3)})
    return linking.remap_ids(old, new.select("symbol", "symbol_era_id", "first_day", "last_day"))


@query("SELECT symbol_era_id || 'b' AS symbol_era_id, n FROM book WHERE n % 2 = 0", "book")
def remapped_rows(t: Inputs) -> DataFrame:
    rows = b.book(t).select("symbol_era_id", "n")
    mapping = rows.filter("n % 2 = 0").select(F.col("symbol_era_id").alias("old_era_id"), F.concat("symbol_era_id", F.lit("b")).alias("new_era_id"))
    return linking.apply_remap(rows, mapping)


@query("SELECT symbol_era_id, symbol, error FROM (SELECT f.symbol_era_id, f.symbol, CASE WHEN e.symbol IS NULL THEN 'missing_era' WHEN e.symbol <> f.symbol THEN 'symbol_mismatch' END AS error FROM (SELECT CASE WHEN n % 50 = 0 THEN 'none#001' ELSE symbol_era_id END AS symbol_era_id, CASE WHEN n % 60 = 1 THEN 'ZZ' ELSE symbol END AS symbol FROM book) f LEFT JOIN book e USING (symbol_era_id)) WHERE error IS NOT NULL ORDER BY 1, 2 LIMIT 10", "book")
def reference_errors(t: Inputs) -> DataFrame:
    n = F.col("n")
    rows = b.book(t).select(F.when(n % 50 == 0, "none#001").otherwise(F.col("symbol_era_id")).alias("symbol_era_id"), F.when(n % 60 == 1, "ZZ").otherwise(F.col("symbol")).alias("symbol"))
    return linking.reference_errors(rows, t.eras)


_NORMAL = r"""trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(issuer), '[/\\]\s*[A-Z]+\s*[/\\]?$', ''), '\bU\.S\.', 'US'), '\bS\.A\.', 'SA'), '''S( |$)', 'S\1'), '[^A-Z0-9]+', ' ', 'g')), '((^| )(INCORPORATED|INCORPORATION|CORPORATION|COMPANY|LIMITED|HOLDINGS|HOLDING|GROUP|TRUST|PARTNERS|PARTNERSHIP|INC|CORP|CO|LTD|LLC|LP|LLP|PLC|SA|NV|AG|PUBLIC))+$', ''))"""


@query(f"SELECT issuer, regexp_replace({_NORMAL}, '\\bAND ', '') AS normal, count(*) AS eras FROM book GROUP BY ALL", "book")
def normal_names(t: Inputs) -> DataFrame:
    return b.book(t).groupBy("issuer", names.normal_name(F.col("issuer")).alias("normal")).agg(F.count("*").alias("eras"))


@query(r"SELECT issuer, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(upper(issuer), '/(THE|A|AN)$', ''), '[^A-Z0-9]+', ' ', 'g')), '^THE( |$)', ''), '((^| )(INC|CORP|CORPORATION|CO|COMPANY|LTD|LLC|LP|LLP|PLC|HOLDINGS|HOLDING|GROUP|NV|SE|AG))+$', '')) AS normal FROM (SELECT DISTINCT issuer FROM book)", "book")
def normal_issuers(t: Inputs) -> DataFrame:
    return b.book(t).select("issuer").distinct().select("issuer", names.normal_issuer(F.col("issuer")).alias("normal"))


@query(
    """SELECT symbol_era_id, CASE issuer WHEN 'ACME HOLDINGS INC' THEN NULL WHEN 'GAMMA U.S. SILICA CO/DE' THEN '300' WHEN 'ZETA CORP-CL A' THEN '500' WHEN 'ZETA CORP' THEN '500' WHEN 'THETA RESOURCE' THEN '700'
    WHEN 'THETA RESOURCES INC' THEN '700' WHEN 'IOTA GLOBAL HLDGS' THEN '800' WHEN 'IOTA GLOBAL' THEN '800' WHEN 'ETA ACQUISITION CORP II' THEN '600' END AS name_matched_cik FROM book""",
    "book",
)
def name_matches(t: Inputs) -> DataFrame:
    registry = t.spark.createDataFrame(
        [("0000000100", "Acme Inc"), ("0000000200", "Acme Corp"), ("0000000300", "Gamma US Silica Company"), ("0000000500", "Zeta Corporation"), ("0000000600", "Eta Acquisition Corp II"), ("0000000700", "Theta Resources Inc"), ("0000000800", "Iota Global Inc")],
        "sec_cik string, sec_name string",
    )
    rows = b.book(t).select("symbol_era_id", F.col("issuer").alias("identity_issuer"))
    return linking.match_names(rows, linking.name_index(registry))


@query("SELECT c_mktsegment AS sec_symbol_key, count(*) AS sec_match_count, min(lpad(CAST(c_custkey AS VARCHAR), 10, '0')) AS sec_cik, min(c_name) AS sec_name FROM customer GROUP BY 1")
def registry_lookup(t: Inputs) -> DataFrame:
    c = t.table("customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("sec_cik"), F.col("c_name").alias("sec_name"), F.col("c_mktsegment").alias("sec_ticker"), F.lit("X").alias("sec_exchange"))
    return listings.registry_lookup(c, names.symbol_key(F.col("sec_ticker"))).select("sec_symbol_key", "sec_match_count", "sec_cik", "sec_name")


@query("SELECT symbol_era_id, CASE WHEN c IS NULL THEN 'sec_unmatched' WHEN c > 1 THEN 'sec_multiple_current_matches' ELSE 'sec_current_match' END AS sec_current_confidence FROM book LEFT JOIN (SELECT 'X' || (s_suppkey % 60) AS symbol, count(*) AS c FROM supplier GROUP BY 1) USING (symbol)", "book")
def registry_matches(t: Inputs) -> DataFrame:
    s = t.table("supplier").select(F.lit("1").alias("sec_cik"), F.col("s_name").alias("sec_name"), F.concat(F.lit("x"), (F.col("s_suppkey") % 60).cast("string")).alias("sec_ticker"), F.lit("X").alias("sec_exchange"))
    lookup = listings.registry_lookup(s, names.symbol_key(F.col("sec_ticker")))
    eras = b.book(t).withColumn("sec_symbol_key", names.symbol_key(F.col("symbol")))
    return eras.join(lookup, "sec_symbol_key", "left").select("symbol_era_id", classify.registry_confidence(F.col("sec_match_count")).alias("sec_current_confidence"))


@query("SELECT y AS first_year, research_route, count(*) AS eras, CAST(sum(trade_rows) AS BIGINT) AS trade_rows, count(*) FILTER (instrument_type = 'probable_operating_company') AS probable_operating_company, count(*) FILTER (source_classification = 'delisted_or_acquired_candidate') AS delisted_or_acquired FROM (SELECT *, substr(first_day, 1, 4) AS y FROM routed) GROUP BY GROUPING SETS ((y, research_route), (y))", "routed")
def missing_by_year(t: Inputs) -> DataFrame:
    args = (F.col("ticker"), F.col("iex_product_hint"), F.col("issuer"))
    rows = b.book(t).withColumn("instrument_type", classify.instrument_type(*args)).withColumn("research_route", classify.research_route(F.col("instrument_type")))
    return worklists.year_rollup(rows)


@query("SELECT source_classification, sec_current_confidence, count(*) AS rows FROM book GROUP BY ALL", "book")
def nested_counts(t: Inputs) -> DataFrame:
    return worklists.counted(b.book(t), "source_classification", "sec_current_confidence")


def _worth(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in worklists.DOCUMENT_WEIGHTS.items()) + " ELSE 0 END"


@query(
    f"""SELECT symbol_era_id, CAST(max(score) AS INTEGER) AS score, count(*) AS documents, string_agg(url, ' | ' ORDER BY k) AS top_documents
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol_era_id ORDER BY score DESC, url) AS k
    FROM (SELECT 'C' || (o_custkey % 300) AS symbol_era_id, CAST(o_orderkey AS VARCHAR) AS url, {_worth("x")} + CASE WHEN x <> y THEN {_worth("y")} ELSE 0 END + least((o_orderkey % 200) // 10, 15) AS score
    FROM (SELECT *, {b.sql_pick(b.FLAGS, "o_orderkey")} AS x, {b.sql_pick(b.FLAGS, "o_orderkey // 7")} AS y FROM orders))) WHERE k <= 3 GROUP BY 1"""
)
def document_graph(t: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.table("orders").select(F.concat(F.lit("C"), (F.col("o_custkey") % 300).cast("string")).alias("symbol_era_id"), k.cast("string").alias("url"), F.array(b.pick(b.FLAGS, k), b.pick(b.FLAGS, F.floor(k / 7))).alias("flags"), (k % 200).alias("triage_score"))
    return worklists.document_graph(rows).select("symbol_era_id", "score", "documents", "top_documents")
