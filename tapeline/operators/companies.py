"""Issuers matched to registrants by what a company search found; ambiguity never matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import evidence, names

#: Candidates of one search that are looked at; more say only that the search is too broad.
MOST = 20


def _named(issuer: Column, broad: bool) -> Column:
    """The registrant's name, the present one or the first former one, that is the issuer's."""
    former = F.filter(F.coalesce("former_names", F.array().cast("array<string>")), lambda x: names.same_company(issuer, x, broad))
    return F.when(names.same_company(issuer, F.col("entity_name"), broad), F.col("entity_name")).otherwise(F.get(former, F.lit(0)))


def _judged(rows: DataFrame, broad: bool) -> DataFrame:
    """Candidates with what decides on them; needs the issuer's columns and the registrant's."""
    c = F.col
    era, dated = (c("first_day"), c("last_day")), c("first_day").isNotNull() & c("last_day").isNotNull()
    rows = rows.withColumn("name", _named(c("identity_issuer"), broad)).withColumn("coded", F.coalesce(c("sic") != "", F.lit(False)))
    rows = rows.withColumns(
        {
            "verdict": F.when(dated, evidence.activity_verdict(*era, c("filing_dates"), c("has_older_shards"))),
            "contains": dated & evidence.contains_era(*era, c("filing_dates")),
            "operating": F.coalesce(dated & (c("entity_type") == "operating") & F.exists("substantive_filing_dates", lambda d: d.between(*era)), F.lit(False)),
        }
    )
    return rows.withColumns({"valid": c("coded") & c("name").isNotNull(), "blank": ~c("coded") & c("name").isNotNull()})


def _first(condition: Column) -> Column:
    """The first candidate, in the order of the search, that meets a condition."""
    return F.min(F.when(condition, F.struct("rank", "cik", "name", "sic", "sic_description", "operating")))


def company_matches(issuers: DataFrame, search: DataFrame, registrants: DataFrame, tickers: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """One row per issuer: match_status, matched_cik, candidate_name, sic, match_basis and more.

    ``issuers`` has identity_issuer (once each), first_day and last_day (dates or null) and ticker
    (or null); ``search`` query, cik and rank for each candidate that a query found; ``registrants``
    cik, entity_name, former_names, sic, sic_description, entity_type, filing_dates,
    substantive_filing_dates, has_older_shards and bdc_election_filed; ``tickers`` ticker and cik.

    The searches of ``names.query_variants`` count in their order until one decides. A candidate
    needs the issuer's name and a SIC code; a single one matches unless its filings prove that it was
    not active in the era; of several, the one plausible matches if all others are disproven, or
    the only one whose filings span the era. A registrant without a code matches if it elected to be
    a business development company, and is a lead if its filings are plausible. A candidate that
    is not among the registrants makes the issuer a fetch_error. What names leave open, the
    issuer's ticker may settle, with a broader comparison of names.
    """
    c = F.col
    key = ["identity_issuer", "first_day", "last_day"]
    queries = issuers.select(*key, F.posexplode(names.query_variants(c("identity_issuer"))).alias("turn", "query")).withColumn("query", F.lower("query"))
    found = search.select(F.lower("query").alias("query"), "cik", "rank")
    known = registrants.withColumn("there", F.lit(True))
    rows = _judged(queries.join(found, "query").join(known, "cik", "left"), broad=False)
    plausible = c("valid") & (c("verdict") == "plausible")
    each = rows.groupBy(*key, "turn").agg(
        F.count("*").alias("candidates"),
        F.count_if(c("there").isNull()).alias("unknown"),
        F.count_if("valid").alias("n"),
        F.count_if(plausible).alias("plausible"),
        F.count_if(c("valid") & c("contains") & (c("verdict") == "plausible")).alias("containing"),
        F.count_if(c("valid") & (F.coalesce("verdict", F.lit("unknown")) == "unknown")).alias("open"),
        _first(c("valid")).alias("one"),
        _first(plausible).alias("live"),
        _first(plausible & c("contains")).alias("spanning"),
        _first(c("blank") & c("operating") & F.coalesce("bdc_election_filed", F.lit(False))).alias("bdc"),
        _first(c("blank") & (c("verdict") == "plausible")).alias("lead"),
        F.max(F.when(c("valid"), c("verdict"))).alias("verdict"),
    )
    narrow, several = c("candidates") <= most, c("n") > 1
    disproven = narrow & (c("unknown") == 0) & c("bdc").isNull() & (c("n") == 1) & F.coalesce(c("verdict") == "disjoint", F.lit(False))
    outcome = lambda status, basis, got, count: F.struct(F.lit(status).alias("status"), F.lit(basis).alias("basis"), got.alias("got"), count.cast("long").alias("count"))
    nobody, none = F.lit(None).cast(each.schema["one"].dataType), F.lit(None).cast("long")
    decided = (
        F.when(~narrow, outcome("ambiguous_candidates", None, nobody, c("candidates")))
        .when(c("unknown") > 0, outcome("fetch_error", None, nobody, none))
        .when(c("bdc").isNotNull(), outcome("matched", "verified_bdc_election", c("bdc"), none))
        .when((c("n") == 1) & ~disproven, outcome("matched", "single_validated_candidate", c("one"), none))
        .when(several & (c("open") == 0) & (c("plausible") == 1), outcome("matched", "filing_activity_tiebreak", c("live"), none))
        .when(several & (c("open") == 0) & (c("plausible") > 1) & (c("containing") == 1), outcome("matched", "filing_window_containment_tiebreak", c("spanning"), none))
        .when(several, outcome("ambiguous_candidates", None, nobody, c("n")))
    )
    each = each.withColumns({"decided": decided, "disproven": disproven, "lead": F.when(narrow & (c("unknown") == 0), c("lead"))})
    per_issuer = each.groupBy("identity_issuer").agg(
        F.min_by("decided", F.when(c("decided").isNotNull(), c("turn"))).alias("decided"),
        F.min(F.when(c("decided").isNotNull(), c("turn"))).alias("stop"),
        F.min(F.when(c("disproven"), c("turn"))).alias("wrong"),
        F.min(F.when(c("lead").isNotNull(), F.struct("turn", "lead"))).alias("lead"),
    )
    out = issuers.join(per_issuer, "identity_issuer", "left")
    before = lambda x: x.isNotNull() & (c("stop").isNull() | (x < c("stop")))
    seen = F.when(c("stop").isNull() & c("wrong").isNull() & c("lead").isNull() & c("_any").isNull(), "no_candidates").otherwise("no_validated_match")
    out = out.join(each.select("identity_issuer", F.lit(True).alias("_any")).distinct(), "identity_issuer", "left")
    lead = F.when(c("lead").isNotNull() & (c("stop").isNull() | (c("lead.turn") <= c("stop"))) & (F.coalesce(c("decided.status"), F.lit("")).isin("", "ambiguous_candidates")), c("lead.lead"))
    out = out.select(
        *key, "ticker", F.coalesce("decided.status", seen).alias("match_status"), c("decided.got").alias("got"), c("decided.basis").alias("match_basis"), c("decided.count").alias("candidate_count"),
        before(c("wrong")).alias("identity_disproven"), lead.alias("lead"),
    )
    if tickers is not None:
        out = _by_ticker(out, tickers, known)
    return out.select(
        "identity_issuer", "match_status", c("got.cik").alias("matched_cik"), "candidate_count", c("got.name").alias("candidate_name"), c("got.sic").alias("sic"), c("got.sic_description").alias("sic_description"),
        "match_basis", "identity_disproven", c("lead.cik").alias("blank_sic_lead_cik"), c("lead.name").alias("blank_sic_lead_name"), F.coalesce("lead.operating", F.lit(False)).alias("blank_sic_lead_high_confidence"),
    )


def _by_ticker(out: DataFrame, tickers: DataFrame, known: DataFrame) -> DataFrame:
    """What is not matched by name yet, by the registrant that the issuer's ticker belongs to."""
    c = F.col
    one = tickers.groupBy(F.upper("ticker").alias("_ticker")).agg(F.min("cik").alias("cik"))  # a ticker's registry names one registrant
    rows = out.withColumn("_ticker", F.when(~c("match_status").isin("matched", "fetch_error"), F.upper("ticker"))).join(one, "_ticker", "left")
    rows = _judged(rows.join(known, "cik", "left").withColumn("rank", F.lit(0)), broad=True)
    asked = c("cik").isNotNull()
    wrong = asked & c("valid") & F.coalesce(c("verdict") == "disjoint", F.lit(False))
    error, match = asked & c("there").isNull(), asked & c("valid") & ~wrong
    got = F.struct("rank", "cik", "name", "sic", "sic_description", "operating").cast(out.schema["got"].dataType)
    status = F.when(error, "fetch_error").when(match, "matched").otherwise(c("match_status"))
    kept = lambda name: F.when(error | match, F.lit(None)).otherwise(c(name))
    return rows.withColumns(
        {
            "match_status": status, "got": F.when(match, got).otherwise(c("got")), "match_basis": F.when(match, "ticker_lookup").otherwise(c("match_basis")),
            "candidate_count": kept("candidate_count"), "lead": kept("lead"), "identity_disproven": c("identity_disproven") | wrong,
        }
    ).select(*out.columns)
