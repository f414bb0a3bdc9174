"""Reviews of filings' texts: of a symbol's end, of its first or last day, and of a change of symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import evidence as e


def _prepared(rows: DataFrame) -> DataFrame:
    """Adds the symbol, the text and its plain form as ``_symbol``, ``_text`` and ``_words``, each worked out once."""
    rows = rows.withColumn("_symbol", F.upper(F.trim(F.coalesce("symbol", F.lit("")))))
    return rows.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", e.plain(F.col("_text")))


def _flagged(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in sorted(rules.items())]))


def _done(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def terminal_text(rows: DataFrame, most_days: int = e.NEAR_DAYS) -> DataFrame:
    """What filings' texts prove of symbols' ends.

    Needs symbol, issuer, entity (the registrant as listed, with symbols in brackets), text and
    last_day (a date). Language and date count in the one snippet that says most, names in the
    whole text. Adds terminal_text_bucket, _score, _flags, _date, _snippet, days_terminal_text_to_last
    and ticker_match_status. A null text is an empty one.
    """
    c = F.col
    rows = _prepared(rows).withColumn("terminal_text_snippet", e.terminal_snippet(c("_words")))
    snippet, symbol = c("terminal_text_snippet"), c("_symbol")
    rows = rows.withColumns({"terminal_text_date": e.first_date(snippet), "_tickers": e.tickers_in_brackets(c("entity")), "_named": e.direct_ticker(symbol, c("_text"), c("_words"))})
    rows = rows.withColumn("_direct", c("_named") | F.array_contains("_tickers", symbol) | e.direct_ticker(symbol, snippet, snippet))
    rows = rows.withColumn("days_terminal_text_to_last", F.datediff("last_day", "terminal_text_date"))
    flags = _flagged(
        {
            "issuer_name_match": e.names_issuer(c("issuer"), c("_words")),
            "direct_ticker_evidence": c("_direct"),
            "terminal_language": e.says(snippet, e.TERMINAL),
            "completion_language": e.says(snippet, e.COMPLETION),
            "delisting_language": e.says(snippet, e.DELISTING),
            "actual_terminal_language": e.says(snippet, e.ACTUAL),
            "prospective_close_language": e.says(snippet, e.PROSPECTIVE),
            "terminal_date_extracted": c("terminal_text_date").isNotNull(),
            "terminal_date_near_original_last": F.abs("days_terminal_text_to_last") <= most_days,
            "parenthetical_ticker_collision": F.size(F.array_remove("_tickers", symbol)) > 0,
            "ambiguous_issuer_token_match": F.array_contains(F.split(e.plain(c("issuer")), " "), symbol) & ~c("_direct"),
        }
    )
    status = (
        F.when(F.array_contains("_tickers", symbol), "parenthetical_match").when(F.size("_tickers") > 0, "parenthetical_collision")
        .when(c("_named"), "direct_text_match").otherwise("no_direct_ticker_evidence")
    )
    rows = rows.withColumns({"terminal_text_flags": flags, "ticker_match_status": status})
    flags = c("terminal_text_flags")
    return _done(rows.withColumns({"terminal_text_bucket": e.terminal_bucket(flags), "terminal_text_score": e.score(flags, e.TERMINAL_WEIGHTS)}))


def lifecycle_text(rows: DataFrame, most_days: int = e.NEAR_DAYS) -> DataFrame:
    """What filings' texts prove of symbols' first or last days.

    Needs symbol, issuer, entity, text, lifecycle_anchor ("first" or "last") and the days first_day
    and last_day (dates). Adds lifecycle_text_bucket, _score, _flags, _date, _snippet and
    days_lifecycle_text_to_anchor. A null text is an empty one.
    """
    c = F.col
    anchor = c("lifecycle_anchor")
    rows = _prepared(rows).withColumn("lifecycle_text_snippet", e.lifecycle_snippet(c("_text"), anchor))
    raw, symbol = c("lifecycle_text_snippet"), c("_symbol")
    rows = rows.withColumn("_snippet", e.plain(raw))
    snippet = c("_snippet")
    rows = rows.withColumns({"lifecycle_text_date": e.first_date(snippet), "_tickers": F.array_union(e.tickers_in_brackets(c("entity")), e.tickers_in_brackets(raw))})
    rows = rows.withColumn("_direct", F.array_contains("_tickers", symbol) | e.direct_ticker(symbol, c("_text"), c("_words")) | e.direct_ticker(symbol, raw, snippet))
    rows = rows.withColumn("days_lifecycle_text_to_anchor", F.datediff(F.when(anchor == "first", c("first_day")).otherwise(c("last_day")), "lifecycle_text_date"))
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    flags = _flagged(
        {
            "issuer_name_match": e.names_issuer(c("issuer"), c("_words")),
            "direct_ticker_evidence": c("_direct"),
            "terminal_language": e.says(snippet, e.LAST_DAY),
            "first_day_lifecycle_language": e.says(snippet, e.FIRST_DAY),
            "prospective_language": e.says(snippet, e.LIFECYCLE_PROSPECTIVE),
            "lifecycle_date_extracted": c("lifecycle_text_date").isNotNull(),
            "lifecycle_date_near_anchor": F.abs("days_lifecycle_text_to_anchor") <= most_days,
            "parenthetical_ticker_collision": F.size(F.array_remove("_tickers", symbol)) > 0,
            "ambiguous_issuer_token_match": F.array_contains(F.split(e.plain(c("issuer")), " "), symbol) & ~c("_direct"),
            "short_symbol_without_direct_context": (F.length(symbol) <= 2) & ~F.contains(padded(c("_words")), padded(symbol)),
        }
    )
    rows = rows.withColumn("lifecycle_text_flags", flags)
    flags = c("lifecycle_text_flags")
    return _done(rows.withColumns({"lifecycle_text_bucket": e.lifecycle_bucket(flags, anchor), "lifecycle_text_score": e.score(flags, e.LIFECYCLE_WEIGHTS)}))


def symbol_change_proof(rows: DataFrame) -> DataFrame:
    """Whether an announcement and a later filing prove a change of symbol.

    Needs symbol, text, boundary (a date or null), subject_cik and confirmations, an array of (cik,
    filing_date, tickers). Proof takes the era's own symbol as the old one, a date of action, both
    symbols and the date in one clause, and a filing of the same registrant on or after that date
    under the new symbol. Adds verification_state, event_date, old_symbol, new_symbol, flags and
    snippet.
    """
    c = F.col
    number = lambda x: F.ltrim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\D", ""), F.lit("0"))
    rows = rows.withColumn("_text", e.filing_text(c("text")))
    rows = rows.withColumns({"_change": e.symbol_change(c("text")), "_action": e.action(c("_text"), c("boundary"), e.RENAMINGS)})
    rows = rows.withColumns({"old_symbol": c("_change.old_symbol"), "new_symbol": c("_change.new_symbol"), "event_date": c("_action.date"), "snippet": F.coalesce("_action.clause", F.lit(""))})
    rows = rows.withColumn("_clauses", F.split("snippet", r"(?<=[.!?])\s+"))

    def proves(clause: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(F.upper(clause), F.lit("[A-Z0-9.^+=-]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^[.]+|[.]+$", ""))
        dates = F.transform(e.dates_in(clause), lambda x: x["date"])
        return F.array_contains(tokens, c("old_symbol")) & F.array_contains(tokens, c("new_symbol")) & F.array_contains(dates, c("event_date"))

    def confirms(x: Column) -> Column:
        tickers = F.transform(x["tickers"], lambda y: F.upper(y))
        return F.array_contains(tickers, c("new_symbol")) & (number(x["cik"]) == number(c("subject_cik"))) & (x["filing_date"] >= c("event_date"))

    rows = rows.withColumns({"_confirmed": F.coalesce(F.exists("confirmations", confirms), F.lit(False)), "_together": F.coalesce(F.exists("_clauses", proves), F.lit(False))})
    ready = F.coalesce((c("old_symbol") == F.upper("symbol")) & c("new_symbol").isNotNull() & c("event_date").isNotNull() & c("_confirmed") & c("_together"), F.lit(False))
    flags = F.array(F.when(c("_confirmed"), "two_source_temporal_proof").otherwise("confirmation_missing"), F.when(ready, "same_clause_symbols").otherwise("symbol_clause_unproven"))
    return _done(rows.withColumns({"verification_state": F.when(ready, "verified").otherwise("event_candidate"), "event_type": F.lit("symbol_change"), "flags": flags}))
