import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tapeline.functions import evidence
from tapeline.operators import facts, filings, worklists
from tapeline.plans.registry import _near
from tapeline.sources import files, messages

DAY = datetime.date(2020, 3, 4)


def _rows(spark, *texts):
    return spark.createDataFrame([(t, DAY) for t in texts], "text string, last_day date")


FAR = "nothing of note here " * 40


ENDS = [
    ("Acme Foods completed the merger on March 4, 2020.", None, "terminal_text_verified_ready"),
    ("Acme Foods merger became effective on March 4, 2020.", "", "terminal_text_verified_ready"),
    ("Acme Foods completed the merger on February 19, 2020.", "", "terminal_text_verified_ready"),
    ("Acme Foods completed the merger on February 18, 2020.", "", "date_mismatch_review"),
    ("Acme Foods completed the merger on 2020-03-05.", "", "terminal_text_verified_ready"),
    ("Acme Foods completed the merger on March 99, 2020.", "", "missing_terminal_date_review"),
    ("Acme Foods met on March 4, 2020.", "", "no_terminal_text_review"),
    ("Other Co completed the merger on March 4, 2020.", "", "weak_identity_review"),
    ("Other Co, ticker ABC, completed the merger on March 4, 2020.", "", "terminal_text_verified_ready"),
    ("Acme Foods completed the merger on March 4, 2020.", "ACME FOODS (ZZZ) (CIK 1)", "reject_symbol_collision"),
    ("Acme Foods completed the merger on March 4, 2020.", "ACME FOODS (ABC) (CIK 1)", "terminal_text_verified_ready"),
    ("Acme Foods completed the merger on March 4, 2020 and will be delisted.", "", "prospective_close_review"),
    ("Acme Foods effective time was March 4, 2020.", "", "terminal_text_review"),
    ("Acme Foods completed the merger. " + FAR + "It was delisted on March 4, 2020.", "", "terminal_text_verified_ready"),
    ("Acme Foods will be delisted. " + FAR + "It completed the merger on March 4, 2020.", "", "terminal_text_verified_ready"),
    (None, None, "no_terminal_text_review"),
]


def test_ends_need_proof_at_every_gate(spark):
    rows = spark.createDataFrame([(k, "abc ", "Acme Foods Inc", entity, text, DAY) for k, (text, entity, _) in enumerate(ENDS)], "k int, symbol string, issuer string, entity string, text string, last_day date")
    got = {r["k"]: r["terminal_text_bucket"] for r in filings.terminal_text(rows).collect()}
    assert [(text, got[k]) for k, (text, _, _) in enumerate(ENDS)] == [(text, bucket) for text, _, bucket in ENDS]


ANCHORS = [
    ("first", "Acme Foods began  trading under the symbol ABC on March 4, 2020.", "lifecycle_text_verified_ready"),
    ("first", "Acme Foods began trading on March 4, 2020.", "first_day_lifecycle_review"),
    ("first", "Acme Foods (ABC) commenced trading on March 19, 2020.", "date_mismatch_review"),
    ("first", "Acme Foods (ABC) commenced trading on March 18, 2020.", "lifecycle_text_verified_ready"),
    ("last", "Acme Foods (ABC) was delisted on June 5, 2020.", "lifecycle_text_verified_ready"),
    ("last", "Acme Foods became effective on June 5, 2020.", "missing_lifecycle_date_review"),
    ("last", "Acme Foods (ABC, XYZ) was delisted on June 5, 2020.", "reject_symbol_collision"),
    ("last", "Acme Foods was delisted on June 5, 2020, subject to review.", "prospective_language_review"),
    ("last", "It was delisted on June 5, 2020.", "weak_identity_review"),
    ("last", None, "weak_identity_review"),
]


def test_first_and_last_days_need_proof_at_every_gate(spark):
    schema = "k int, symbol string, issuer string, entity string, text string, lifecycle_anchor string, first_day date, last_day date"
    rows = spark.createDataFrame([(k, "ABC", "Acme Foods Inc", None, text, anchor, DAY, datetime.date(2020, 6, 5)) for k, (anchor, text, _) in enumerate(ANCHORS)], schema)
    got = {r["k"]: r["lifecycle_text_bucket"] for r in filings.lifecycle_text(rows).collect()}
    assert [(text, got[k]) for k, (_, text, _) in enumerate(ANCHORS)] == [(text, bucket) for _, text, bucket in ANCHORS]


def test_dates_and_their_places(spark):
    text = "Sept. 5th, 2019; 2020-1-2 and 03/04/2021, March 160 7, 2022, May 40, 2020."
    got = spark.range(1).select(evidence.dates_in(evidence.filing_text(F.lit(text))).alias("x")).first()["x"]
    assert [(r["date"].isoformat(), r["start"]) for r in got] == [("2019-09-05", 0), ("2020-01-02", 17), ("2021-03-04", 30), ("2022-03-07", 42)]


def test_the_date_of_the_action_counts(spark):
    text = "Filed January 1, 2019. The merger of Acme, signed on 2019-12-31 in the presence of all who had a hand in it, closed: it completed the merger on March 5, 2020. See also April 1, 2021."
    got = _rows(spark, text).select(evidence.action(F.col("text"), F.col("last_day")).alias("x")).first()["x"]
    assert got["date"] == datetime.date(2020, 3, 5) and got["clause"] == text[23:158]
    assert _rows(spark, "On March 5, 2020 nothing.").select(evidence.action_date(F.col("text"), F.col("last_day"))).first()[0] is None


@pytest.mark.parametrize(
    ("text", "change"),
    [
        ("its ticker symbol changed from FB to META.", ("FB", "META")),
        ("ceased trading under the symbol ABC and began trading today under the new symbol XYZ", ("ABC", "XYZ")),
        ("now trades under the new symbol XYZ, formerly ABC.", ("ABC", "XYZ")),
        ("the symbol changed from ABC to XYZ. Earlier it went from the symbol QQQ to ABC.", ("ABC", "XYZ")),
        ("nothing", (None, None)),
        (None, (None, None)),
    ],
)
def test_symbol_changes(spark, text, change):
    assert tuple(_rows(spark, text).select(evidence.symbol_change(F.col("text"))).first()[0]) == change


SAYS = "Acme said its ticker symbol changed from FB to META on June 9, 2022."


PROOFS = [
    ("fb", SAYS, ("0001", "2022-06-10", ["meta"]), "verified"),
    ("fb", SAYS, ("0001", "2022-06-08", ["META"]), "event_candidate"),
    ("fb", SAYS, ("2", "2022-06-10", ["META"]), "event_candidate"),
    ("fb", SAYS, ("1", "2022-06-10", ["FB"]), "event_candidate"),
    ("zz", SAYS, ("1", "2022-06-10", ["META"]), "event_candidate"),
    ("fb", "Its ticker symbol changed from FB to META. On June 9, 2022 Acme met.", ("1", "2022-06-10", ["META"]), "event_candidate"),
    ("fb", None, None, "event_candidate"),
]


def test_a_change_of_symbol_needs_two_sources(spark):
    schema = "k int, symbol string, text string, boundary date, subject_cik string, confirmations array<struct<cik:string,filing_date:date,tickers:array<string>>>"
    rows = [(k, symbol, text, DAY, "1", [(c[0], datetime.date.fromisoformat(c[1]), c[2])] if c else None) for k, (symbol, text, c, _) in enumerate(PROOFS)]
    got = {r["k"]: r["verification_state"] for r in filings.symbol_change_proof(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k] for k in range(len(PROOFS))] == [state for *_, state in PROOFS]


def test_verdicts_of_activity(spark):
    d = lambda s: F.lit(s).cast("date")
    verdict = lambda older, *days: spark.range(1).select(evidence.activity_verdict(d("2020-01-01"), d("2020-12-31"), F.array(*map(d, days)).cast("array<date>"), F.lit(older))).first()[0]
    assert [verdict(False, "2019-01-01", "2020-06-01"), verdict(False, "2018-01-01", "2019-01-01"), verdict(False), verdict(True)] == ["plausible", "disjoint", "disjoint", "unknown"]
    assert [verdict(False, "2021-01-01"), verdict(True, "2021-01-01"), verdict(False, "2019-01-01", "2021-01-01")] == ["disjoint", "unknown", "unknown"]


def test_messages_fill_only_their_own_columns(spark):
    rows = spark.createDataFrame(
        [("trade_report", 1, "AAA  ", 12.34, 100, 7, 0x20, None), ("quote_update", 2, "AAA", None, None, None, 1, 9.99), ("system_event", 3, "", None, None, None, None, None), ("mystery", 4, "X", 1.0, 1, 1, 1, None)],
        "type string, timestamp long, symbol string, price double, size long, trade_id long, flags int, bid_price double",
    )
    main, quote = messages.normalized(rows.withColumn("event", F.lit("O")))
    got = {r["type"]: r for r in main.collect()}
    assert set(got) == {"TradeReport", "SystemEvent", "mystery"}
    t = got["TradeReport"]
    assert (t["symbol"], t["price"], t["price_int"], t["size"], t["sale_flags"], t["system_event"]) == ("AAA", 12.34, 123400, 100, "odd_lot", None)
    assert (got["SystemEvent"]["system_event"], got["SystemEvent"]["system_event_str"], got["SystemEvent"]["symbol"]) == (79.0, "start_of_messages", None)
    assert got["mystery"]["price"] is None
    q = quote.first()
    assert (q["bid_price"], q["bid_price_int"], q["ask_price"], q["ask_price_int"]) == (9.99, 99900, None, None)


def test_verified_overrides_must_survive_a_migration(spark):
    rows = spark.createDataFrame([("A#1", "merger"), ("B#1", "merger_lead")], "symbol_era_id string, status string")
    mapping = spark.createDataFrame([("B#1", "B#2")], "old_era_id string, new_era_id string")
    assert [tuple(r) for r in facts.migrated(rows, mapping, False).select("symbol_era_id", "verification_state").collect()] == [("B#2", "event_candidate")]
    with pytest.raises(PySparkException):
        facts.migrated(rows, mapping, True).collect()


def test_a_changed_cohort_is_noticed(spark):
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "a string, b int")
    stored = facts.check_cohort(rows, ["a", "b"], None)
    assert facts.check_cohort(rows.orderBy("b", ascending=False), ["a", "b"], stored) == stored
    with pytest.raises(ValueError, match="changed"):
        facts.check_cohort(rows.limit(1), ["a", "b"], stored)


def test_templates_and_parents(spark):
    rows = spark.createDataFrame([("ABC-A", "ABC-A#001")], "symbol string, symbol_era_id string")
    assert worklists.template(rows, ["symbol", "none"], ["note", "symbol"]).columns == ["symbol", "note"]
    roots = spark.createDataFrame([("ABC", "ABC#001", 5, "v"), ("ABC", "ABC#002", 5, "u"), ("ABC", "ABC#003", 1, "a")], "symbol string, symbol_era_id string, evidence_score int, url string")
    assert worklists.parent_links(rows, roots).first()["parent_era_id"] == "ABC#002"


def test_registry_documents_of_another_shape_are_an_error(spark):
    doc = spark.createDataFrame([(["cik"], [["1"]])], "fields array<string>, data array<array<string>>")
    with pytest.raises(PySparkException):
        files.registry_document(doc).collect()


def test_near_is_written_out():
    assert _near("SELECT near(f(a, b), 2) AS x") == "SELECT (floor((f(a, b)) * 100.0::DOUBLE + 0.31415926::DOUBLE) / 100.0::DOUBLE) AS x"
