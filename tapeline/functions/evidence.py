"""What a filing's text says of a symbol's end or change: flags, scores, buckets, dates; column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of the review of a symbol's end, and of its first or last day, and what each flag is worth.
TERMINAL = (
    "completed the merger", "consummated the merger", "closing of the merger", "became effective", "effective time", "transaction closed", "shares ceased trading", "delisted", "suspended from trading", "form 25", "terminated registration",
)
COMPLETION = ("completed the merger", "consummated the merger", "closing of the merger", "became effective", "effective time", "transaction closed")
DELISTING = ("shares ceased trading", "delisted", "suspended from trading", "form 25", "terminated registration")
ACTUAL = (
    "completed the merger", "completed its merger", "consummated the merger", "completed its acquisition", "transaction closed", "has merged", "announcing the closing", "closed the merger", "became effective", "shares ceased trading", "was suspended",
    "ceased being traded", "delisted", "suspended from trading", "form 25", "terminated registration",
)
PROSPECTIVE = ("expected to occur", "expect to close", "expected to close", "subject to the satisfaction", "subject to satisfaction", "expects to complete", "will close", "will be delisted", "intends to delist", "will cease trading")
LAST_DAY = ("completed the merger", "consummated the merger", "closing of the merger", "transaction closed", "shares ceased trading", "suspended from trading", "delisted", "form 25", "terminated registration")
FIRST_DAY = ("began trading", "commenced trading", "will begin trading", "listed on", "started trading", "under the ticker symbol", "under the symbol", "changed its ticker", "ticker symbol changed", "changed its name")
LIFECYCLE_PROSPECTIVE = ("expected to", "anticipates", "subject to", "intends to", "will begin trading")
ENDINGS = (
    "completed the merger", "consummated the merger", "merger became effective", "mergers became effective", "transaction closed", "completed the acquisition", "acquisition was completed", "completion of the acquisition", "ceased trading",
    "suspended from trading", "was delisted", "were delisted",
)
RENAMINGS = ("ticker symbol will change", "ticker symbol changed", "change from", "ceased trading under", "began trading under", "commenced trading under")
ACTIONS = ENDINGS + RENAMINGS
NOT_YET = ("will", "expects to", "expected to", "intends to", "subject to", "once ", "may be", "could be", "would be")
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
#: Characters on either side of a phrase that are read with it, and days that a date may lie from the day it is to prove.
RADIUS, NEAR_DAYS = 320, 14
#: Characters within which two places can be in one sentence, on either side of a clause, and of a clause.
SENTENCE, MARGIN, CLAUSE = 2000, 500, 1000
VERIFIER_WEIGHTS = {"issuer_name_match": 20, "symbol_match": 10, "event_language": 25, "completion_language": 35, "delisting_language": 25, "going_private_form": 15}
TERMINAL_WEIGHTS = {
    "issuer_name_match": 20, "direct_ticker_evidence": 20, "terminal_language": 25, "completion_language": 20, "delisting_language": 20, "terminal_date_extracted": 15, "terminal_date_near_original_last": 25,
    "actual_terminal_language": 20, "prospective_close_language": -50, "parenthetical_ticker_collision": -100, "ambiguous_issuer_token_match": -30,
}
LIFECYCLE_WEIGHTS = {
    "issuer_name_match": 20, "direct_ticker_evidence": 25, "terminal_language": 30, "first_day_lifecycle_language": 25, "lifecycle_date_extracted": 15, "lifecycle_date_near_anchor": 25, "prospective_language": -40,
    "parenthetical_ticker_collision": -100, "ambiguous_issuer_token_match": -30, "short_symbol_without_direct_context": -20,
}
#: Patterns of a change of symbol, the old one first; in the last one the new symbol comes first.
CHANGES = (
    r"CEASED\s+TRADING\s+UNDER\s+(?:THE\s+)?(?:TICKER\s+)?SYMBOL\s+([A-Z0-9.^+=-]+)\s+AND\s+BEGAN\s+TRADING.*?UNDER\s+(?:THE\s+)?(?:NEW\s+)?(?:TICKER\s+)?SYMBOL\s+([A-Z0-9.^+=-]+)",
    r"(?:TICKER\s+)?SYMBOL\s+(?:WILL\s+)?CHANGE(?:D)?\s+FROM\s+([A-Z0-9.^+=-]+)\s+TO\s+([A-Z0-9.^+=-]+)",
    r"FROM\s+(?:THE\s+)?(?:TICKER\s+)?SYMBOL\s+([A-Z0-9.^+=-]+)\s+TO\s+([A-Z0-9.^+=-]+)",
    r"UNDER\s+(?:THE\s+)?(?:NEW\s+)?(?:TICKER\s+)?SYMBOL\s+([A-Z0-9.^+=-]+).*?FORMERLY\s+([A-Z0-9.^+=-]+)",
)
_MARK = "\uffff"


def plain(text: Column) -> Column:
    """Upper-case words of a text, a space between them."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+", " "))


def says(text: Column, phrases: Iterable[str]) -> Column:
    """Whether a plain text holds one of the phrases."""
    return text.rlike("|".join(p.upper() for p in phrases))


def names_issuer(issuer: Column, text: Column) -> Column:
    """Whether two of the issuer's words of four letters (or the only one) stand in a plain text."""
    words = F.filter(F.split(plain(issuer), " "), lambda w: F.length(w) >= 4)
    return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.contains(text, w))) >= F.least(F.lit(2), F.size(words)))


def names_symbol(symbol: Column, text: Column) -> Column:
    spaced = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (F.length(symbol) > 1) & F.contains(spaced(text), spaced(plain(symbol)))


def _flags(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))


def score(flags: Column, weights: dict[str, int]) -> Column:
    """Sum of what the flags are worth."""
    return sum((F.when(F.array_contains(flags, name), w).otherwise(0) for name, w in weights.items()), F.lit(0))


def verifier_flags(issuer: Column, symbol: Column, form: Column, text: Column) -> Column:
    t = plain(text)
    return _flags(
        {
            "issuer_name_match": names_issuer(issuer, t),
            "symbol_match": names_symbol(symbol, t),
            "event_language": says(t, TERMINAL),
            "completion_language": says(t, COMPLETION),
            "delisting_language": says(t, DELISTING),
            "going_private_form": F.upper(F.trim(form)).isin("SC 13E3", "SC 13E3/A"),
        }
    )


def verifier_bucket(flags: Column) -> Column:
    has = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    identity, event, points = has("issuer_name_match", "symbol_match"), has("event_language", "completion_language"), score(flags, VERIFIER_WEIGHTS)
    return F.when((points >= 70) & identity & event, "strong_review_candidate").when((points >= 45) & event, "moderate_review_candidate").otherwise("weak_review_candidate")


def places(text: Column, pattern: str) -> Column:
    """Array of (s, e, v): start, end (exclusive, from 0) and text of each match."""
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        one = F.array(F.struct(a["at"].alias("s"), end.alias("e"), x.alias("v")))
        return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), F.when(a["hit"], F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))
    return F.aggregate(pieces, begin, step, lambda a: a["out"])


def tickers_in_brackets(text: Column) -> Column:
    """Symbols that stand in round brackets, alone or between commas."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(([^)]*)\)"), F.lit(1))
    parts = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.rlike(r"^[A-Z][A-Z0-9.\-]{0,7}$") & (x != "CIK"))))


def direct_ticker(symbol: Column, text: Column, words: Column) -> Column:
    """Whether a text (``words``: in plain form) names a symbol of two letters or more as one."""
    quoted = F.concat(F.lit(r"\Q"), symbol, F.lit(r"\E"))
    before = F.concat(F.lit(r"\b(?:TICKER|SYMBOL|NASDAQ|NYSE|NYSEAMERICAN|OTC)\s+"), quoted, F.lit(r"\b"))
    after = F.concat(F.lit(r"\b"), quoted, F.lit(r"\s+(?:COMMON|ORDINARY|SHARES|STOCK)\b"))
    named = F.array_contains(tickers_in_brackets(text), symbol) | F.rlike(words, before) | F.rlike(words, after)
    return F.coalesce((F.length(symbol) > 1) & named, F.lit(False))


def first_date(words: Column) -> Column:
    """The first date of a plain text that is written with a month's name; without any, its first one in digits."""
    named = F.regexp_extract_all(words, F.lit(rf"\b((?:{'|'.join(MONTHS)}) [0-9]{{1,2}} [0-9]{{4}})\b"), F.lit(1))
    found = F.filter(F.transform(named, lambda d: F.try_to_date(F.initcap(d), "MMMM d yyyy")), lambda d: d.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.try_to_date(F.regexp_extract(words, r"\b([0-9]{4} [0-9]{2} [0-9]{2})\b", 1), "yyyy MM dd"))


def _around(text: Column, start: Column, end: Column) -> Column:
    left = F.greatest(start - RADIUS, F.lit(0))
    return F.substring(text, left + 1, F.least(end + RADIUS, F.length(text)) - left)


def _best(snippets: Column, quality) -> Column:
    """The snippet of most quality, the first of equals, without spaces at its ends; empty without any."""
    ranked = F.transform(snippets, lambda x, i: F.struct(quality(x).alias("q"), (-i).alias("i"), x.alias("x")))
    return F.coalesce(F.trim(F.array_max(ranked)["x"]), F.lit(""))


def terminal_snippet(words: Column) -> Column:
    """The part of a plain text that says most of a symbol's end."""

    def of(phrase: str) -> Column:
        n = F.size(F.split(words, phrase)) - 1
        start = lambda k: F.length(F.call_function("substring_index", words, F.lit(phrase), k))
        starts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start)
        return F.when(n > 0, F.transform(starts, lambda p: _around(words, p, p))).otherwise(F.array().cast("array<string>"))

    quality = lambda x: F.when(first_date(x).isNotNull(), 40).otherwise(0) + F.when(says(x, COMPLETION), 25).otherwise(0) + F.when(says(x, DELISTING), 25).otherwise(0)
    return _best(F.flatten(F.array(*[of(p.upper()) for p in TERMINAL])), quality)


def lifecycle_snippet(text: Column, anchor: Column) -> Column:
    """The part of a text that says most of a symbol's first or last day (``anchor``)."""

    def of(phrases: Iterable[str]) -> Column:
        found = [F.transform(places(text, "(?i)" + r"\s+".join(p.split())), lambda x: _around(text, x["s"], x["e"])) for p in phrases]
        return F.flatten(F.array(*found))

    def quality(x: Column) -> Column:
        words = plain(x)
        return F.when(first_date(words).isNotNull(), 40).otherwise(0) + F.when(says(words, LAST_DAY), 25).otherwise(0) + F.when(says(words, FIRST_DAY), 20).otherwise(0)

    return _best(F.when(anchor == "first", of(FIRST_DAY)).otherwise(of(LAST_DAY)), quality)


def filing_text(html: Column) -> Column:
    """A filing's text: entities read, tags dropped, space squeezed, and the trace of a lost hard space before a day taken out."""
    out = F.coalesce(html, F.lit(""))
    for entity, sign in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]+>", " "), r"[\s\u00a0]+", " "))
    return F.regexp_replace(out, rf"(?i)\b({_MONTH})\.?\s+160\s+([0-9]{{1,2}}(?:ST|ND|RD|TH)?\b)", "$1 $2")


#: Months and their short forms, the longer ones first.
_MONTH = "|".join([*MONTHS, "SEPT", *(m[:3] for m in MONTHS if len(m) > 3)])


def dates_in(text: Column) -> Column:
    """All dates of a filing's text in the order of their places: array of (start, end, date, raw)."""

    def of(pattern: str, day) -> Column:
        rows = F.transform(places(text, pattern), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), day(x["v"]).alias("date"), x["v"].alias("raw")))
        return F.filter(rows, lambda x: x["date"].isNotNull())

    def named(v: Column) -> Column:
        part = lambda k: F.regexp_extract(v, rf"(?i)({_MONTH})\.?\s+([0-9]{{1,2}})(?:ST|ND|RD|TH)?,?\s+([0-9]{{4}})", k)
        return F.try_to_date(F.concat_ws(" ", F.initcap(F.substring(part(1), 1, 3)), part(2), part(3)), "MMM d yyyy")

    def digits(*order: int):
        return lambda v: F.try_to_date(F.concat_ws("-", *[F.get(F.split(v, "[-/]"), F.lit(k)) for k in order]), "yyyy-M-d")

    found = [
        of(rf"(?i)\b(?:{_MONTH})\.?\s+[0-9]{{1,2}}(?:ST|ND|RD|TH)?,?\s+[0-9]{{4}}\b", named),
        of(r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b", digits(0, 1, 2)),
        of(r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b", digits(2, 0, 1)),
    ]
    return F.array_sort(F.concat(*found))


def action(text: Column, boundary: Column, phrases: Iterable[str] = ACTIONS) -> Column:
    """Struct of the date that a filing's text gives an action, and the clause that says so; nulls without one.

    Dates in one sentence with an action come first, then those nearest to an action, then those
    nearest to ``boundary`` (a date, may be null), then the first.
    """
    actions = F.transform(F.flatten(F.array(*[places(text, f"(?i){p}") for p in phrases])), lambda x: x["s"])

    def ranked(dates: Column, at: Column) -> Column:
        def one(d: Column) -> Column:
            def together(p: Column) -> Column:
                left, right = F.least(p, d["start"]), F.greatest(p, d["start"])
                return (right - left <= SENTENCE) & ~F.substring(text, left + 1, right - left).rlike(r"[.!?]\s+(?=[A-Z])")

            nearest = F.array_min(F.transform(at, lambda p: F.struct(F.abs(p - d["start"]).alias("gap"), p.alias("p"))))
            distance = F.coalesce(F.abs(F.datediff(d["date"], boundary)), F.lit(0))
            return F.struct(F.when(F.exists(at, together), 0).otherwise(1).alias("apart"), nearest["gap"].alias("gap"), distance.alias("distance"), d["start"].alias("start"), d["date"].alias("date"), nearest["p"].alias("p"))

        return F.array_min(F.transform(dates, one))

    best = F.when((F.size(actions) > 0), ranked(dates_in(text), actions))
    first, last = F.least(best["start"], best["p"]), F.greatest(best["start"], best["p"])
    tail = F.length(F.substring_index(F.substring(text, F.lit(1), first), ".", -1))
    left = F.greatest(first - tail, first - MARGIN)
    stop = F.call_function("locate", F.lit("."), text, last + 1)
    right = F.when(stop > 0, stop).otherwise(F.least(last + MARGIN, F.length(text)))
    return F.struct(best["date"].alias("date"), F.substring(F.trim(F.substring(text, left + 1, right - left)), 1, CLAUSE).alias("clause"))


def action_date(text: Column, boundary: Column, phrases: Iterable[str] = ACTIONS) -> Column:
    """The date of ``action``."""
    return action(text, boundary, phrases)["date"]


def terminal_bucket(flags: Column) -> Column:
    """Where a text on a symbol's end goes; absence of evidence never passes."""
    has = lambda name: F.array_contains(flags, name)
    return (
        F.when(has("parenthetical_ticker_collision"), "reject_symbol_collision")
        .when(~has("terminal_language"), "no_terminal_text_review")
        .when(~has("terminal_date_extracted"), "missing_terminal_date_review")
        .when(~has("terminal_date_near_original_last"), "date_mismatch_review")
        .when(has("ambiguous_issuer_token_match"), "ambiguous_identity_review")
        .when(has("prospective_close_language"), "prospective_close_review")
        .when(~(has("issuer_name_match") | has("direct_ticker_evidence")), "weak_identity_review")
        .when((has("completion_language") | has("delisting_language")) & has("actual_terminal_language"), "terminal_text_verified_ready")
        .otherwise("terminal_text_review")
    )


def lifecycle_bucket(flags: Column, anchor: Column) -> Column:
    """The same for a text on a symbol's first or last day."""
    has = lambda name: F.array_contains(flags, name)
    ready = F.when(anchor == "first", has("first_day_lifecycle_language") & has("direct_ticker_evidence")).otherwise(has("terminal_language"))
    return (
        F.when(has("parenthetical_ticker_collision"), "reject_symbol_collision")
        .when(~(has("issuer_name_match") | has("direct_ticker_evidence")), "weak_identity_review")
        .when(~has("lifecycle_date_extracted"), "missing_lifecycle_date_review")
        .when(~has("lifecycle_date_near_anchor"), "date_mismatch_review")
        .when(has("ambiguous_issuer_token_match"), "ambiguous_identity_review")
        .when(has("prospective_language"), "prospective_language_review")
        .when(ready, "lifecycle_text_verified_ready")
        .otherwise(F.when(anchor == "first", "first_day_lifecycle_review").otherwise("last_day_lifecycle_review"))
    )


def symbol_change(text: Column) -> Column:
    """Struct of old and new symbol that one of the patterns finds in a notice, the first that does; nulls without one."""
    upper = F.regexp_replace(F.upper(filing_text(text)), "[^A-Z0-9.^+=-]+", " ")
    out = F.struct(F.lit(None).cast("string").alias("old_symbol"), F.lit(None).cast("string").alias("new_symbol"))
    for k in range(len(CHANGES) - 1, -1, -1):
        one, two = (F.regexp_replace(F.regexp_extract(upper, CHANGES[k], g), r"^[.]+|[.]+$", "") for g in (1, 2))
        old, new = (two, one) if k == len(CHANGES) - 1 else (one, two)
        out = F.when(upper.rlike(CHANGES[k]), F.struct(F.nullif(old, F.lit("")).alias("old_symbol"), F.nullif(new, F.lit("")).alias("new_symbol"))).otherwise(out)
    return out


def required(flags: Column, names: Iterable[str]) -> Column:
    """Whether all the named flags are there."""
    return F.size(F.array_except(F.array(*map(F.lit, names)), flags)) == 0


def activity_verdict(first: Column, last: Column, filings: Column, older: Column | None = None) -> Column:
    """Whether a registrant's filing dates (array) can belong to an era: plausible, disjoint or unknown.

    Disjoint is only what the dates prove: ``older`` says that there are older ones which are not known.
    """
    older = F.lit(False) if older is None else F.coalesce(older, F.lit(False))
    none = F.coalesce(F.size(filings), F.lit(0)) < 1
    early = F.when(older, "unknown").otherwise("disjoint")
    usable = F.coalesce(first <= last, F.lit(False))
    return (
        F.when(~usable, "unknown").when(none, early).when(F.array_max(filings) < first, "disjoint").when(F.array_min(filings) > last, early)
        .when(F.exists(filings, lambda d: d.between(first, last)), "plausible").otherwise("unknown")
    )


def contains_era(first: Column, last: Column, filings: Column) -> Column:
    """Whether the time from the first to the last filing covers an era."""
    return F.coalesce((F.array_min(filings) <= first) & (F.array_max(filings) >= last), F.lit(False))
