import datetime

from pyspark.sql import functions as F

from tapeline.functions import names
from tapeline.operators import companies


def test_searches_go_from_the_whole_name_to_its_first_word(spark):
    got = lambda x: spark.range(1).select(names.query_variants(F.lit(x))).first()[0]
    assert got("MICHAELS COS  INC-CL A") == ["MICHAELS COS INC-CL A", "MICHAELS COMPANIES INC-CL A", "MICHAELS COS INC", "MICHAELS COMPANIES INC", "MICHAELS COS", "MICHAELS COMPANIES", "MICHAELS"]
    assert got("Acme") == ["Acme"] and got("") == [] and got(None) == []
    assert got("acme ACME") == ["acme ACME", "acme"]


def test_names_of_one_company(spark):
    same = lambda a, b, broad=False: spark.range(1).select(names.same_company(F.lit(a), F.lit(b), broad)).first()[0]
    assert same("ACME INC-CL A", "Acme Corp") and same("MICHAELS COS INC", "Michaels Companies, Inc.") and same("TPG PACE BENEFICIAL FIN", "TPG Pace Beneficial Finance Corp.")
    assert not same("INTERCEPT PHARMACEUTICALS IN", "Intercept Pharmaceuticals, Inc.") and same("INTERCEPT PHARMACEUTICALS IN", "Intercept Pharmaceuticals, Inc.", True)
    assert not same("ACME ACQUISITION II", "Acme Acquisition III") and not same("ACME", None) and not same("", "")


D = datetime.date
ERA = (D(2018, 1, 2), D(2020, 6, 30))
IN, BEFORE, AFTER = [D(2019, 5, 5)], [D(2013, 1, 1), D(2014, 1, 1)], [D(2022, 1, 1)]
SPAN = [D(2017, 1, 1), D(2019, 5, 5), D(2021, 1, 1)]
# name, former names, sic, entity type, filing dates, substantive dates, older shards, election
REGISTRANTS = {
    "1": ("Acme Inc", [], "7372", "operating", IN, IN, False, False),
    "2": ("Acme Corp", [], "7372", "operating", BEFORE, BEFORE, False, False),
    "3": ("Beta Corp", ["Old Beta Inc"], "100", "operating", AFTER, [], False, False),
    "4": ("Gamma Inc", [], None, "operating", IN, IN, False, False),
    "5": ("Delta Capital Corp", [], "", "operating", IN, IN, False, True),
    "6": ("Zeta Inc", [], "1", "operating", IN, [], False, False),
    "7": ("Zeta Holdings", [], "1", "operating", SPAN, [], False, False),
    "8": ("Eta Inc", [], "1", "operating", [D(2017, 1, 1), D(2021, 1, 1)], [], False, False),
    "9": ("Eta Corp", [], "1", "operating", IN, [], False, False),
    "10": ("Iota Therapeutics Inc", [], "1", "operating", IN, [], False, False),
}
SEARCH = {
    "acme inc": ["1", "2"], "old beta": ["3"], "gamma inc": ["4"], "delta capital": ["5"], "zeta": ["6", "7"], "eta inc": ["8", "9"], "kappa": [str(k) for k in range(100, 121)], "lambda": ["999"], "mu": ["1"], "iota": [str(k) for k in range(100, 130)],
}
EXPECTED = {
    "ACME INC-CL A": ("matched", "1", "filing_activity_tiebreak", False),
    "OLD BETA HLDGS": ("no_validated_match", None, None, True),
    "GAMMA INC": ("no_validated_match", None, None, False),
    "DELTA CAPITAL CORP": ("matched", "5", "verified_bdc_election", False),
    "ZETA INC": ("matched", "7", "filing_window_containment_tiebreak", False),
    "ETA INC": ("ambiguous_candidates", None, None, False),
    "KAPPA CORP": ("ambiguous_candidates", None, None, False),
    "LAMBDA CORP": ("fetch_error", None, None, False),
    "MU CORP": ("no_validated_match", None, None, False),
    "NU CORP": ("no_candidates", None, None, False),
    "IOTA THERAPEUTICS IN": ("matched", "10", "ticker_lookup", False),
}


def _run(spark, span, tickers=True):
    issuers = spark.createDataFrame([(n, *span, "IOT" if n.startswith("IOTA") else None) for n in EXPECTED], "identity_issuer string, first_day date, last_day date, ticker string")
    search = spark.createDataFrame([(q.upper(), cik, k) for q, found in SEARCH.items() for k, cik in enumerate(found)], "query string, cik string, rank int")
    many = {str(k): (f"Other {k}", [], "1", "operating", IN, [], False, False) for k in range(100, 130)}
    schema = "cik string, entity_name string, former_names array<string>, sic string, entity_type string, filing_dates array<date>, substantive_filing_dates array<date>, has_older_shards boolean, bdc_election_filed boolean"
    registrants = spark.createDataFrame([(k, *v) for k, v in (REGISTRANTS | many).items()], schema).withColumn("sic_description", F.lit("d"))
    known = spark.createDataFrame([("iot", "10")], "ticker string, cik string") if tickers else None
    return {r["identity_issuer"]: r for r in companies.company_matches(issuers, search, registrants, known).collect()}


def test_company_search(spark):
    got = _run(spark, ERA)
    assert {n: (r["match_status"], r["matched_cik"], r["match_basis"], r["identity_disproven"]) for n, r in got.items()} == EXPECTED
    lead = got["GAMMA INC"]
    assert (lead["blank_sic_lead_cik"], lead["blank_sic_lead_name"], lead["blank_sic_lead_high_confidence"]) == ("4", "Gamma Inc", True)
    assert got["KAPPA CORP"]["candidate_count"] == 21 and got["ETA INC"]["candidate_count"] == 2


def test_without_days_filings_decide_nothing(spark):
    got = _run(spark, (None, None), tickers=False)
    assert {n: got[n]["match_status"] for n in ("ACME INC-CL A", "OLD BETA HLDGS", "DELTA CAPITAL CORP", "ZETA INC", "IOTA THERAPEUTICS IN")} == {
        "ACME INC-CL A": "ambiguous_candidates", "OLD BETA HLDGS": "matched", "DELTA CAPITAL CORP": "no_validated_match", "ZETA INC": "ambiguous_candidates", "IOTA THERAPEUTICS IN": "ambiguous_candidates",
    }
    assert got["GAMMA INC"]["blank_sic_lead_cik"] is None
