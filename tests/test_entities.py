import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tapeline.functions import classify, names
from tapeline.operators import facts, linking, listings, summaries, worklists


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "normal"),
    [
        ("XYZ HOLDINGS INC", "XYZ"), ("U.S. Silica Co", "US SILICA"), ("Cosan S.A.", "COSAN"), ("CONN'S INC", "CONNS"), ("PETCO HEALTH AND WELLNESS CO", "PETCO HEALTH WELLNESS"), ("Petco Health & Wellness Company, Inc.", "PETCO HEALTH WELLNESS"),
        ("CORE SCIENTIFIC, INC./TX", "CORE SCIENTIFIC"), ("TRC COMPANIES INC /DE/", "TRC COMPANIES"), ("AGILITI, INC. \\DE", "AGILITI"), ("Inc", ""), (None, ""), ("TXO Partners, L.P.", "TXO"),
    ],
)
def test_normal_names(spark, name, normal):
    assert _one(spark, names.normal_name(F.lit(name).cast("string"))) == normal


@pytest.mark.parametrize(("name", "bare"), [("ABB LTD-SPON ADR", "ABB LTD"), ("ROYALTY PHARMA PLC- CL A", "ROYALTY PHARMA PLC"), ("SWITCH INC - A", "SWITCH INC"), ("BRASKEM SA-CLASS A- ADR", "BRASKEM SA"), ("PLAIN CO", "PLAIN CO")])
def test_descriptors(spark, name, bare):
    assert _one(spark, names.without_descriptors(F.lit(name))) == bare


@pytest.mark.parametrize(
    ("a", "b", "related"),
    [("HERTZ GLOBAL", "HERTZ GLOBAL HLDGS", True), ("ACME RESOURCE", "ACME RESOURCES", True), ("XYZ ACQUISITION II", "XYZ ACQUISITION III", False), ("BANCORP", "BANCORP SOUTH", False), ("ACME RE", "ACME RESOURCES", False), ("ACME RESOURCE X", "ACME RESOURCES", False)],
)
def test_prefixes(spark, a, b, related):
    s = lambda x: F.split(F.lit(x), " ")
    assert _one(spark, names.prefix_related(s(a), s(b))) is related


def test_names_match_one_registrant_only(spark):
    registry = spark.createDataFrame([("0000000001", "Acme Inc"), ("0000000002", "Acme Corp"), ("0000000003", "Beta Global Inc"), ("0000000004", "Gamma Foods North Inc"), ("0000000005", "Gamma Foods South Inc")], "sec_cik string, sec_name string")
    eras = spark.createDataFrame([("A#1", "ACME"), ("B#1", "BETA GLOBAL LTD-SPON ADR"), ("B#2", "BETA GLOBAL HLDGS"), ("G#1", "GAMMA FOODS"), ("N#1", None)], "symbol_era_id string, identity_issuer string")
    out = dict(linking.match_names(eras, linking.name_index(registry)).collect())
    assert out == {"A#1": None, "B#1": "3", "B#2": "3", "G#1": None, "N#1": None}


@pytest.mark.parametrize(("sic", "division"), [("7372", "I"), ("1800", None), ("9995", None), ("", None), ("x", None), ("100", "A"), (None, None)])
def test_sic_divisions(spark, sic, division):
    assert _one(spark, classify.sic_division(F.lit(sic).cast("string"))) == division


@pytest.mark.parametrize(
    ("symbol", "kind"),
    [("ABC", "probable_operating_company"), ("ABCDW", "probable_warrant"), ("WT", "probable_warrant"), ("A+", "probable_warrant"), ("ABCDU", "probable_unit"), ("X=", "probable_unit"), ("X RT", "probable_right"), ("X^", "probable_right"), ("AB.PRC", "probable_preferred"), ("A-W", "probable_preferred"), ("AB-C*", "probable_preferred"), ("AB.C", "probable_share_class"), ("TOOLONG", "unknown_instrument"), (None, "unknown_instrument")],
)
def test_instruments(spark, symbol, kind):
    none = F.lit(None).cast("string")
    assert _one(spark, classify.instrument_type(F.lit(symbol).cast("string"), none, none)) == kind


def test_instrument_hints_come_first_and_issuers_late(spark):
    assert _one(spark, classify.instrument_type(F.lit("ABCDW"), F.lit("etf"), F.lit(""))) == "probable_fund_or_trust"
    assert _one(spark, classify.instrument_reason(F.lit("ABC"), F.lit(None).cast("string"), F.lit("Acme Trust"))) == "issuer_name_fund_or_trust"


@pytest.mark.parametrize(("tickers", "status"), [(None, None), ([], "terminal"), (["AAA", None], "still_active_same_symbol"), (["BBB", None], "renamed_or_successor")])
def test_continuity(spark, tickers, status):
    df = spark.createDataFrame([("AAA", tickers)], "s string, t array<string>")
    assert df.select(classify.continuity(F.col("s"), F.col("t"))).first()[0] == status


def test_cik_tiers_in_order(spark):
    schema = "identity_tier string, identity_method string, identity_entity_id string, identity_source_url string, source_classification string, sec_current_confidence string, sec_cik string, name_matched_cik string, edgar_matched_cik string"
    rows = [
        ("verified", "sec_date_scoped_display_names", "0000012", None, "stable_candidate", "sec_current_match", "0000000099", "7", "8"),
        ("verified", "legacy_historical_override", None, "https://x/data/00034/a.txt", "stable_candidate", "sec_current_match", "0000000099", "7", "8"),
        ("verified", "legacy_historical_override", None, "https://x/none", "stable_candidate", "sec_current_match", "0000000099", "7", "8"),
        (None, None, None, None, "delisted_or_acquired_candidate", "sec_current_match", "0000000099", "7", "8"),
        (None, None, None, None, "delisted_or_acquired_candidate", "sec_current_match", "0000000099", None, "8"),
        (None, None, None, None, None, None, None, None, None),
    ]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, schema).select(classify.resolved_cik()).collect()]
    assert [(g[0], g[2]) for g in got] == [("12", "A"), ("34", "B"), ("99", "C"), ("7", "D"), ("8", "E"), (None, None)]


ERA = "symbol string, symbol_era_id string, first_day string, last_day string, trade_rows long, issuer string, cik string"


def test_successors_need_a_short_gap_another_symbol_and_reciprocity(spark):
    rows = [
        ("OLD", "OLD#001", "20200101", "20220608", 1000, "Acme Inc", "1"), ("NEW", "NEW#001", "20220609", "20230101", 900, "Acme Holdings", "1"), ("LITE", "LITE#001", "20220609", "20230101", 10, None, None),
        ("OLD", "OLD#002", "20220610", "20230101", 5, None, None), ("FAR", "FAR#001", "20220701", "20230101", 5, None, None),
    ]
    pairs = linking.successor_pairs(spark.createDataFrame(rows, ERA))
    got = {(r["a_symbol_era_id"], r["b_symbol_era_id"]): r for r in pairs.collect()}
    assert set(got) == {("OLD#001", "NEW#001"), ("OLD#001", "LITE#001")}
    best = got["OLD#001", "NEW#001"]
    assert (best["boundary_score"], best["volume_score"], best["issuer_score"], best["cik_score"]) == (1.0, 0.9, 1.0, 1.0)
    assert [(r["a_symbol_era_id"], r["b_symbol_era_id"]) for r in linking.mutual_best(pairs).collect()] == [("OLD#001", "NEW#001")]


SPAN = "symbol string, symbol_era_id string, first_day string, last_day string"


def test_remap_tiers_and_ambiguity(spark):
    old = spark.createDataFrame([("A", "A#001", "2020-01-01", "2020-02-01"), ("B", "B#001", "2020-01-01", "2020-02-01"), ("C", "C#001", "2020-01-01", "2020-02-01"), ("D", "D#001", "2020-01-01", "2020-02-01"), ("E", "E#001", "2020-01-01", "2020-02-01")], SPAN)
    new = spark.createDataFrame([("A", "A#001", "20200101", "20200201"), ("B", "B#002", "20200101", "20200201"), ("C", "C#001", "20200101", "20200301"), ("D", "D#009", "20191201", "20200201")], SPAN)
    got = {r["old_era_id"]: (r["new_era_id"], r["match_kind"]) for r in linking.remap_ids(old, new).collect()}
    assert got == {"A#001": ("A#001", "unchanged"), "B#001": ("B#002", "id_shift"), "C#001": ("C#001", "last_day_shift"), "D#001": ("D#009", "first_day_shift")}
    twice = new.unionByName(spark.createDataFrame([("A", "A#002", "20200101", "20200201")], SPAN))
    with pytest.raises(PySparkException):
        linking.remap_ids(old, twice).collect()


FACTS = "fact_id string, symbol_era_id string, verification_state string, created_at string, n int"


def test_best_latest_merge_and_replace(spark):
    rows = spark.createDataFrame([("f1", "A#1", "candidate", "1", 1), ("f2", "A#1", "corroborated", "2", 2), ("f3", "A#1", "corroborated", "3", 3), ("f4", None, "verified", "1", 4)], FACTS)
    assert [r["fact_id"] for r in facts.best_facts(rows, [F.col("n")]).collect()] == ["f2"]
    assert [r["fact_id"] for r in facts.latest_facts(rows.filter("symbol_era_id is not null")).collect()] == ["f3"]
    fresh = spark.createDataFrame([("f1", "A#1", "verified", "9", 8), ("f9", "B#1", "candidate", "9", 9), ("f9", "B#1", "verified", "9", 10)], FACTS)
    merged = {r["fact_id"]: r["n"] for r in facts.merge(rows, fresh, [F.col("n")]).collect()}
    assert merged == {"f1": 1, "f2": 2, "f3": 3, "f4": 4, "f9": 9}
    replaced = {r["fact_id"]: r["n"] for r in facts.replace(rows, fresh, [F.col("n")]).collect()}
    assert replaced == {"f1": 8, "f2": 2, "f3": 3, "f4": 4, "f9": 10}
    again = facts.merge(facts.merge(rows, fresh, [F.col("n")]), fresh, [F.col("n")])
    assert again.count() == 5


def test_fact_ids_depend_on_content_only(spark):
    df = spark.createDataFrame([("A", "x", "t1"), ("A", "x", "t2"), ("A", "y", "t1")], "symbol string, issuer string, created_at string")
    a, b, c = (r[0] for r in df.select(facts.fact_id("identity", df.columns)).collect())
    assert a == b != c and a.startswith("identity:") and len(a) == len("identity:") + 24


def test_gaps_are_bridged_between_the_same_entity_only(spark):
    eras = spark.createDataFrame([("A", f"A#00{i}", f"2020010{2 * i}", f"2020010{2 * i + 1}") for i in range(1, 4)] + [("B", f"B#00{i}", f"2020010{2 * i}", f"2020010{2 * i + 1}") for i in range(1, 4)], SPAN)
    known = spark.createDataFrame([("A#001", "0012", "common"), ("A#003", "12", "common"), ("B#001", "1", "common"), ("B#003", "2", "common")], "symbol_era_id string, entity_id string, instrument string")
    out = facts.bridged_gaps(eras, known).collect()
    assert [(r["symbol_era_id"], r["entity_id"]) for r in out] == [("A#002", "12")]


SHOT = "snapshot_date string, symbol string, issuer string, is_enabled string, lit string"


def test_snapshots(spark):
    rows = spark.createDataFrame([("2020-01-01", "A", "Acme", "1", "1"), ("2020-01-01", "B", "Beta ETF", "1", "1"), ("2020-01-02", "A", "Acme Inc", "1", "0"), ("2020-01-02", "C", "", "1", "1")], SHOT)
    out = {r["symbol"]: r for r in listings.lifecycle(rows).collect()}
    assert (out["A"]["iex_issuer_variants"], out["A"]["iex_latest_issuer"], out["A"]["iex_seen_days"]) == ("Acme | Acme Inc", "Acme Inc", 2)
    assert out["B"]["iex_removed_after_seen"] and out["B"]["iex_product_hint"] == "etf" and out["C"]["iex_issuer_variant_count"] == 0
    got = {r["symbol"]: (r["event_type"], r["change_fields"]) for r in listings.differences(rows).collect()}
    assert got == {"A": ("changed", "issuer,lit"), "B": ("removed", None), "C": ("added", None)}
    step = listings.daily_changes(rows).first()
    assert (step["added_count"], step["removed_count"], step["changed_count"], step["net_count_change"]) == (1, 1, 1, 0)
    assert listings.valid_snapshots(rows, 3).count() == 0


@pytest.mark.parametrize(("text", "date"), [("2020-03-04", "2020-03-04"), ("March 4, 2020", "2020-03-04"), ("03/04/2020", "2020-03-04"), ("20200304", "2020-03-04"), ("soon", None), ("2020-13-40", None), (None, None)])
def test_loose_dates(spark, text, date):
    got = _one(spark, names.loose_date(F.lit(text).cast("string")))
    assert (str(got) if got else None) == date


def test_document_graph_and_reasons(spark):
    rows = [("A#1", ["issuer_name_match", "event_language", "completion_language"], 99, "u1"), ("A#1", [], 0, "u2"), ("A#1", ["event_language"], 0, "u3"), ("A#1", ["event_language"], 0, "u0"), ("B#1", ["nonsense"], 250, "u1")]
    out = {r["symbol_era_id"]: r for r in worklists.document_graph(spark.createDataFrame(rows, "symbol_era_id string, flags array<string>, triage_score int, url string")).collect()}
    assert (out["A#1"]["bucket"], out["A#1"]["score"], out["A#1"]["documents"], out["A#1"]["top_documents"]) == ("auto_verified_candidate", 89, 3, "u1 | u0 | u3")
    assert (out["B#1"]["bucket"], out["B#1"]["score"]) == ("manual_review", 15)


def test_leads_keep_the_windows_of_an_era_apart(spark):
    triage = spark.createDataFrame(
        [("A", "A#1", "20200101", "20200131", "1", "medium_confidence_lead", 50, "r", "0007", "ACME INC (A) (CIK 7)", " sc 13e3", "2020-01-09", "1-2-3"), ("A", "A#1", "20200101", "20200131", "2", "high_confidence_lead", 40, "r", "1", "X", "8-K", "d", "1"), ("A", "A#1", "20200601", "20200630", "1", "manual_review_lead", 9, "r", None, None, None, None, None)],
        "symbol string, symbol_era_id string, first_day string, last_day string, triage_rank string, triage_bucket string, triage_score int, triage_reason string, cik string, entity string, form string, filed_at string, accession_no string",
    )
    windows = spark.createDataFrame([("A", "A#1", "20200101", "20200131", "first", "x"), ("A", "A#1", "20200601", "20200630", "last", "y")], "symbol string, symbol_era_id string, first_day string, last_day string, lifecycle_anchor string, form string")
    got = {r["lifecycle_anchor"]: r for r in worklists.lead_candidates(windows, triage, anchored=True).collect()}
    assert got["first"]["proposed_historical_event_type"] == "trading_commencement_or_symbol_lifecycle_lead" and got["first"]["primary_source_url"].endswith("/data/7/123/")
    assert got["last"]["proposed_historical_issuer_name"] == "" and got["last"]["primary_source_url"] is None and got["last"]["form"] is None
    plain = worklists.lead_candidates(windows.select("symbol", "symbol_era_id").distinct(), triage, "medium_confidence_lead").collect()
    assert [(r["proposed_historical_issuer_name"], r["proposed_historical_event_type"]) for r in plain] == [("ACME INC", "going_private_lead")]


def test_the_review_queue_joins_its_tables_once_each(spark):
    eras = spark.createDataFrame([("ABC", "ABC#1", "partial_window_candidate", "sec_unmatched", 5), ("XYZ", "XYZ#1", "stable_candidate", "sec_unmatched", 5)], "symbol string, symbol_era_id string, source_classification string, sec_current_confidence string, trade_rows int")
    listings = spark.createDataFrame([("ABC#1", "iex_snapshot_unmatched", "Acme", "etf", True, 1)], "symbol_era_id string, iex_entity_confidence string, iex_latest_issuer string, iex_product_hint string, iex_seen_in_latest boolean, other int")
    overrides = spark.createDataFrame([], "symbol_era_id string, historical_identity_status string")
    ledger = spark.createDataFrame([("ABC#1", "review_ready")], "symbol_era_id string, resolution_status string")
    facts = spark.createDataFrame([("ABC#1", "f")], "symbol_era_id string, fact string")
    rows = worklists.joined_review_queue(eras, listings, overrides, ledger, facts).collect()
    assert [(r["symbol_era_id"], r["resolution_workflow_status"], r["instrument_type"], r["fact"]) for r in rows] == [("ABC#1", "ledger_review_ready", "probable_fund_or_trust", "f")]


def test_quarantined_days_are_left_out(spark):
    days = spark.createDataFrame([("20240105", 100, 60), ("20240106", 100, 60), ("20240108", 100, 0), ("20240109", 100, 5)], "day string, total_rows long, trade_rows long")
    manifest = summaries.validity_manifest(days)
    row = manifest.first()
    assert (row["scanned_day_count"], row["valid_day_count"]) == (4, 1)
    assert [(x["day"], x["reason"]) for x in row["quarantined_days"]] == [("20240106", "weekend_session"), ("20240108", "no_trade_reports"), ("20240109", "low_trade_share")]
    assert [r["day"] for r in summaries.without_quarantined(days, manifest).collect()] == ["20240105"]
