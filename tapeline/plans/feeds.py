"""Queries on feeds, documents, runs and other inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import market, names
from tapeline.operators import companies, facts, linking, summaries, worklists
from tapeline.plans import book as b
from tapeline.plans.registry import Inputs, near, query
from tapeline.sources import files, sinks

_TYPES = ["trade_report", "quote_update", "trade_break", "system_event", "mystery", "official_price"]


def _feed(t: Inputs) -> DataFrame:
    """Events as messages of mixed types."""
    e = t.table("events")
    kind = b.pick(_TYPES, F.col("event_id") % 17)
    return e.select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"), (F.unix_micros("ts") * 1000).alias("timestamp"), kind.alias("raw_type"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in market.MESSAGE_TYPES.items() for x in kv]), kind), kind).alias("type"), F.concat(F.substring(F.upper("event_type"), 1, 1), F.col("user_id").cast("string")).alias("symbol"), "value")


_FEED = f"SELECT event_id, strftime(ts, '%Y%m%d') AS day, epoch_us(ts) * 1000 AS ns, {b.sql_pick(_TYPES, 'event_id % 17')} AS raw_type, upper(substr(event_type, 1, 1)) || user_id AS symbol, value FROM events"


@query(f"SELECT part, raw_type, count(*) AS rows FROM (SELECT CASE raw_type WHEN 'quote_update' THEN 'quote' WHEN 'mystery' THEN 'unknown' ELSE 'main' END AS part, raw_type FROM ({_FEED})) GROUP BY ALL")
def message_split(t: Inputs) -> DataFrame:
    parts = sinks.split_messages(_feed(t))
    out = [p.groupBy("raw_type").agg(F.count("*").alias("rows")).withColumn("part", F.lit(n)) for p, n in zip(parts, ("main", "quote", "unknown"), strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"SELECT CAST(sum(n) AS BIGINT) AS unknown, max(n) AS longest_run, sum(n) > 100 OR max(n) > 3 AS abort FROM (SELECT day, g, count(*) AS n FROM (SELECT *, sum(CASE WHEN raw_type <> 'mystery' THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ns ROWS UNBOUNDED PRECEDING) AS g FROM ({_FEED})) WHERE raw_type = 'mystery' GROUP BY ALL)")
def quarantine_verdict(t: Inputs) -> DataFrame:
    return sinks.quarantine_verdict(_feed(t), 100, 3)


@query(f"SELECT substr(symbol, 1, 1) AS letter, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM ({_FEED}) GROUP BY 1")
def letter_split(t: Inputs) -> DataFrame:
    return _feed(t).groupBy(F.substring("symbol", 1, 1).alias("letter")).agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"))


@query(
    "SELECT f AS flags, nullif(concat_ws('|', CASE WHEN f & 128 <> 0 THEN 'iso' END, CASE WHEN f & 64 <> 0 THEN 'extended_hours' END, CASE WHEN f & 32 <> 0 THEN 'odd_lot' END, CASE WHEN f & 16 <> 0 THEN 'trade_through_exempt' END, CASE WHEN f & 8 <> 0 THEN 'single_price_cross' END), '') AS sale_flags, concat_ws('|', CASE WHEN f & 128 <> 0 THEN 'INTERMARKET_SWEEP' END, CASE WHEN f & 64 <> 0 THEN 'EXTENDED_HOURS' ELSE 'REGULAR_HOURS' END, CASE WHEN f & 32 <> 0 THEN 'ODD_LOT' END, CASE WHEN f & 16 <> 0 THEN 'TRADE_THROUGH_EXEMPT' END, CASE WHEN f & 8 <> 0 THEN 'SINGLE_PRICE_CROSS' END) AS sale_condition, count(*) AS rows FROM (SELECT CAST(event_id % 256 AS INTEGER) AS f FROM events) GROUP BY 1"
)
def sale_flags(t: Inputs) -> DataFrame:
    f = F.col("flags")
    rows = t.table("events").select((F.col("event_id") % 256).cast("int").alias("flags"))
    return rows.groupBy("flags", market.sale_labels(f).alias("sale_flags"), market.report_labels(f).alias("sale_condition")).agg(F.count("*").alias("rows"))


@query("SELECT 'price' AS \"column\", count(*) AS rows, count(*) FILTER (price IS NULL) AS nulls, count(*) FILTER (price IS NULL AND price_int IS NOT NULL) AS fillable FROM messages", "messages")
def price_audit(t: Inputs) -> DataFrame:
    return sinks.price_audit(t.messages, {"price": "price_int"})


@query("SELECT day, symbol, trade_id, near(min(coalesce(price, price_int / 10000.0)), 4) AS lo, count(*) AS rows FROM messages GROUP BY ALL", "messages")
def price_repair(t: Inputs) -> DataFrame:
    return sinks.price_repair(t.messages, {"price": "price_int"}).groupBy("day", "symbol", "trade_id").agg(near(F.min("price")).alias("lo"), F.count("*").alias("rows"))


_INDEX = "SELECT strftime(o_orderdate, '%Y%m%d') AS day, o_orderstatus AS feed, o_orderpriority AS version, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CAST(o_orderkey AS VARCHAR) AS link FROM orders"


def _index(t: Inputs) -> DataFrame:
    return t.table("orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.col("o_orderstatus").alias("feed"), F.col("o_orderpriority").alias("version"), F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderkey").cast("string").alias("link"))


@query(f"SELECT day, feed, link, version, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY day, feed ORDER BY size_bytes DESC, version DESC, link DESC) AS k FROM ({_INDEX})) WHERE k = 1")
def best_record_per_day(t: Inputs) -> DataFrame:
    return files.best_record_per_day(_index(t))


@query(f"SELECT DISTINCT day FROM ({_INDEX}) WHERE feed = 'P' AND day BETWEEN '19960101' AND '19981231' AND day NOT IN (SELECT strftime(l_shipdate, '%Y%m%d') FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)")
def missing_days(t: Inputs) -> DataFrame:
    done = t.table("lineitem").filter("l_returnflag = 'R' and l_quantity >= 49").select(F.date_format("l_shipdate", "yyyyMMdd").alias("day"))
    return files.missing_days(_index(t), done, "P", "19960101", "19981231")


@query(f"SELECT feed, version, count(*) AS records, count(DISTINCT day) AS days, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ({_INDEX}) GROUP BY ALL")
def index_summary(t: Inputs) -> DataFrame:
    return _index(t).groupBy("feed", "version").agg(F.count("*").alias("records"), F.count_distinct("day").alias("days"), F.sum("size_bytes").alias("bytes"))


@query("SELECT day FROM (SELECT strftime(l_shipdate, '%Y%m%d') AS day, l_quantity >= 48 AS s FROM lineitem) GROUP BY day HAVING count(DISTINCT s) = 2")
def complete_days(t: Inputs) -> DataFrame:
    rows = t.table("lineitem").select(F.date_format("l_shipdate", "yyyyMMdd").alias("day"), F.when(F.col("l_quantity") >= 48, "main").otherwise("quote").alias("kind"))
    return files.complete_days(rows)


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS rows FROM events GROUP BY ALL")
def json_facts(t: Inputs) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return t.table("events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("rows"))


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS sec_cik, s_name AS sec_name, 'T-' || s_suppkey AS sec_ticker, 'T' || s_suppkey AS sec_symbol_key FROM supplier WHERE s_suppkey % 9 <> 0")
def registry_document(t: Inputs) -> DataFrame:
    k = F.col("s_suppkey")
    ticker = F.when(k % 9 != 0, F.concat(F.lit("t-"), k.cast("string"))).otherwise("")
    row = F.array(k.cast("string"), F.col("s_name"), ticker, F.lit("X"))
    doc = t.table("supplier").groupBy((k % 5).alias("page")).agg(F.collect_list(row).alias("data")).withColumn("fields", F.array(*map(F.lit, ("cik", "name", "ticker", "exchange"))))
    return files.registry_document(doc).drop("sec_exchange")


@query("SELECT upper('t' || c_custkey) AS ticker, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN strftime(DATE '2000-01-01' + CAST(c_custkey % 900 AS INTEGER), '%Y-%m-%d') END AS event_date, c_custkey % 7 = 0 AS failed FROM customer WHERE c_custkey % 50 <> 3")
def delisting_lines(t: Inputs) -> DataFrame:
    k = F.col("c_custkey")
    date = F.when(k % 7 != 0, F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (k % 900).cast("int")), "MM/dd/yyyy")).otherwise("soon")
    line = F.when(k % 50 == 3, "File Creation Time: 1").otherwise(F.concat_ws("|", F.concat(F.lit(" t"), k.cast("string")), F.col("c_name"), date))
    out = files.delisting_lines(t.table("customer").select(line.alias("value")))
    return out.withColumn("event_date", F.col("event_date").cast("string"))


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Name ' || s_suppkey ELSE s_name END AS issuer, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CASE WHEN s_suppkey % 3 = 0 THEN 'AB,CD' ELSE '' END AS tickers, '2020-01-0' || (s_suppkey % 9 + 1) AS filing_date FROM supplier")
def search_hits(t: Inputs) -> DataFrame:
    k = F.col("s_suppkey")
    cik = F.concat(F.lit("(CIK "), F.lpad(k.cast("string"), 10, "0"), F.lit(")"))
    display = F.when(k % 3 == 0, F.concat(F.lit("Name "), k.cast("string"), F.lit("  (AB, CD)  "), cik)).otherwise(F.concat(F.col("s_name"), F.lit(" "), cik))
    source = F.struct(F.array(display, display).alias("display_names"), F.concat(F.lit("2020-01-0"), (k % 9 + 1).cast("string")).alias("file_date"))
    hit = F.struct(k.cast("string").alias("_id"), source.alias("_source"))
    payload = F.to_json(F.struct(F.struct(F.collect_list(hit).alias("hits")).alias("hits")))
    rows = t.table("supplier").groupBy((k % 4).alias("page")).agg(payload.alias("payload"))
    return files.search_hits(rows).select("issuer", "cik", F.concat_ws(",", "tickers").alias("tickers"), "filing_date")


@query(r"SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title, length(html) AS html_chars, len(regexp_extract_all(html, '(?is)<a [^>]*>(.*?)</a>', 1)) AS links FROM pages")
def page_fields(t: Inputs) -> DataFrame:
    out = t.table("pages").select(
        "page_id",
        F.nullif(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"),
        F.length("html").cast("long").alias("html_chars"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?is)<a [^>]*>(.*?)</a>"), F.lit(1))).cast("long").alias("links"),
    )
    return out


_SQL_TEXT = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _entity, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _SQL_TEXT = f"replace({_SQL_TEXT}, '{_entity}', '{_sign}')"


@query(rf"SELECT page_id, trim(regexp_replace({_SQL_TEXT}, '\s+', ' ', 'g')) AS text FROM pages")
def page_text(t: Inputs) -> DataFrame:
    return t.table("pages").select("page_id", names.html_text(F.col("html")).alias("text"))


@query("SELECT o_orderkey AS page_id, CAST(1 AS INTEGER) AS row, o_orderstatus || '|' || o_orderpriority AS cells FROM orders WHERE o_orderkey % 3 <> 0")
def html_tables(t: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    header = F.when(k % 3 != 0, "<tr><th>Ticker</th><th>Name</th></tr>").otherwise("<tr><th>Other</th></tr>")
    html = F.concat(F.lit("<table>"), header, F.lit("<tr><td> "), F.col("o_orderstatus"), F.lit("</td>\n<td class='x'><b>"), F.col("o_orderpriority"), F.lit("</b></td></tr></table>"))
    rows = files.table_rows(t.table("orders").select(k.alias("page_id"), html.alias("html")), "ticker")
    return rows.withColumn("cells", F.concat_ws("|", "cells"))


@query("SELECT o_orderkey, 'Issuer ' || o_custkey AS issuer, CASE WHEN o_orderkey % 2 = 0 THEN 'ABC' WHEN o_orderkey % 5 <> 0 THEN 'XYZ' END AS ticker, strftime(o_orderdate, '%Y-%m-%d') AS effective_date FROM orders")
def filing_fields(t: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    ticker = F.when(k % 2 == 0, " trading symbol: ABC ").when(k % 5 == 0, " ticker symbol: THE ").otherwise(" (NYSE: XYZ) ")
    text = F.concat(F.lit("Notice\nIssuer: Issuer "), F.col("o_custkey").cast("string"), F.lit("\n"), ticker, F.lit("effective date: "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("."))
    out = t.table("orders").select(k, text.alias("text")).select("o_orderkey", *files.filing_fields("text"))
    return out.withColumn("effective_date", F.col("effective_date").cast("string"))


@query("SELECT s_suppkey, s_name AS EntityRegistrantName, CASE WHEN s_suppkey % 2 = 0 THEN 'AB|CD' ELSE 'AB' END AS TradingSymbol FROM supplier")
def inline_tags(t: Inputs) -> DataFrame:
    k = F.col("s_suppkey")
    html = F.concat(
        F.lit('<p><ix:nonNumeric id="1" name="dei:EntityRegistrantName"> <span>'), F.col("s_name"), F.lit('</span></ix:nonNumeric><dei:TradingSymbol contextRef="c">AB</dei:TradingSymbol><dei:TradingSymbol>AB</dei:TradingSymbol>'), F.when(k % 2 == 0, "<dei:TradingSymbol>CD</dei:TradingSymbol>").otherwise("")
    )
    tags = files.inline_tags("html", ("dei:EntityRegistrantName", "dei:TradingSymbol"))
    return t.table("supplier").select("s_suppkey", html.alias("html")).select("s_suppkey", *tags).withColumns({c: F.concat_ws("|", c) for c in ("EntityRegistrantName", "TradingSymbol")})


@query("SELECT symbol_era_id, CAST(date_diff('day', strptime(first_day, '%Y%m%d')::DATE, strptime(last_day, '%Y%m%d')::DATE) AS INTEGER) AS era_span_days, strftime(strptime(first_day, '%Y%m%d')::DATE - 45, '%Y%m%d') AS window_from, strftime(strptime(last_day, '%Y%m%d')::DATE + 90, '%Y%m%d') AS window_to, isodow(strptime(last_day, '%Y%m%d')) >= 6 AS ends_on_weekend FROM book", "book")
def era_windows(t: Inputs) -> DataFrame:
    first, last = F.to_date("first_day", "yyyyMMdd"), F.to_date("last_day", "yyyyMMdd")
    return b.book(t).select("symbol_era_id", F.datediff(last, first).alias("era_span_days"), F.date_format(F.date_sub(first, 45), "yyyyMMdd").alias("window_from"), F.date_format(F.date_add(last, 90), "yyyyMMdd").alias("window_to"), (F.weekday(last) >= 5).alias("ends_on_weekend"))


@query("SELECT symbol_era_id, CAST(y AS INTEGER) AS year, row_number() OVER (PARTITION BY symbol_era_id ORDER BY least(y - CAST(substr(first_day, 1, 4) AS BIGINT), CAST(substr(last_day, 1, 4) AS BIGINT) - y), y) AS place FROM (SELECT *, unnest(range(CAST(substr(first_day, 1, 4) AS BIGINT), CAST(substr(last_day, 1, 4) AS BIGINT) + 1)) AS y FROM book)", "book")
def annual_slices(t: Inputs) -> DataFrame:
    a, z = F.substring("first_day", 1, 4).cast("int"), F.substring("last_day", 1, 4).cast("int")
    rows = b.book(t).withColumn("year", F.explode(F.sequence(a, z)))
    order = Window.partitionBy("symbol_era_id").orderBy(F.least(F.col("year") - a, z - F.col("year")), "year")
    return rows.select("symbol_era_id", "year", F.row_number().over(order).cast("long").alias("place"))


@query(
    f"""SELECT symbol_era_id, stratum, accession_no, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol_era_id, stratum ORDER BY distance, accession_no) AS rank,
    CASE stratum WHEN 'deal' THEN 2 ELSE 4 END AS most FROM (SELECT 'C' || (o_custkey % 100) AS symbol_era_id, CAST(o_orderkey AS VARCHAR) AS accession_no, abs(date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE))) AS distance,
    CASE {b.sql_pick(b.FORMS, "o_orderkey")} WHEN '8-K' THEN 'operating' WHEN '6-K' THEN 'operating' WHEN '25' THEN 'regulatory' WHEN '15-12B' THEN 'regulatory' WHEN 'S-4' THEN 'deal' WHEN '425' THEN 'deal' END AS stratum FROM orders) WHERE stratum IS NOT NULL) WHERE rank <= most"""
)
def stratified_filings(t: Inputs) -> DataFrame:
    rows = t.table("orders").select(F.concat(F.lit("C"), (F.col("o_custkey") % 100).cast("string")).alias("symbol_era_id"), F.col("o_orderkey").cast("string").alias("accession_no"), b.pick(b.FORMS, F.col("o_orderkey")).alias("form"), F.to_date("o_orderdate").alias("filing_date"), F.lit("1998-06-01").cast("date").alias("boundary"))
    return worklists.stratified_filings(rows).select("symbol_era_id", "stratum", "accession_no", "rank")


_HITS = f"""SELECT 'C' || (o_custkey % 100) AS symbol_era_id, {b.sql_pick(["AB", "ACME", "Q"], "o_custkey")} AS symbol, CAST(o_orderkey AS VARCHAR) AS url, {b.sql_pick(b.STRENGTHS, "o_orderkey")} AS form_strength,
CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS filed, {b.sql_pick(["ACME INC", "", "AB CORP", "Other"], "o_orderkey // 3")} AS entity, o_orderkey % 14 AS hit_rank FROM orders"""


@query(
    f"""SELECT symbol_era_id, url, CAST(score AS BIGINT) AS triage_score, rel AS date_relation, ent AS entity_match, CAST(k AS INTEGER) AS triage_rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol_era_id ORDER BY score DESC, hit_rank, url) AS k
    FROM (SELECT *, CASE form_strength WHEN 'deal_form' THEN 60 WHEN 'exchange_exit_form' THEN 55 WHEN 'review_form' THEN 25 ELSE 5 END
    + CASE rel WHEN 'inside_symbol_era' THEN 30 WHEN 'near_after_symbol_era' THEN 20 WHEN 'near_before_symbol_era' THEN 10 WHEN 'outside_symbol_era' THEN -15 ELSE 0 END
    + CASE ent WHEN 'symbol_token_in_entity' THEN 20 WHEN 'short_symbol_no_entity_match' THEN -15 ELSE 0 END + greatest(0, 11 - hit_rank) AS score
    FROM (SELECT *, CASE WHEN filed IS NULL THEN 'unknown_date' WHEN filed BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN 'inside_symbol_era' WHEN date_diff('day', DATE '1997-12-31', filed) BETWEEN 0 AND 730 THEN 'near_after_symbol_era'
    WHEN date_diff('day', filed, DATE '1997-01-01') BETWEEN 0 AND 365 THEN 'near_before_symbol_era' ELSE 'outside_symbol_era' END AS rel,
    CASE WHEN entity = '' THEN 'unknown_entity' WHEN length(symbol) > 1 AND list_contains(string_split(upper(entity), ' '), symbol) THEN 'symbol_token_in_entity' WHEN length(symbol) <= 2 THEN 'short_symbol_no_entity_match' ELSE 'no_entity_match' END AS ent FROM ({_HITS})))) WHERE k <= 3"""
)
def hit_triage(t: Inputs) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.table("orders").select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 100).cast("string")).alias("symbol_era_id"), b.pick(["AB", "ACME", "Q"], F.col("o_custkey")).alias("symbol"), k.cast("string").alias("url"), b.pick(b.STRENGTHS, k).alias("form_strength"),
        F.when(k % 13 != 0, F.to_date("o_orderdate")).alias("filed"), F.lit("19970101").alias("first_day"), F.lit("19971231").alias("last_day"), b.pick(["ACME INC", "", "AB CORP", "Other"], F.floor(k / 3)).alias("entity"), (k % 14).alias("hit_rank"),
    )
    return worklists.triage(rows).select("symbol_era_id", "url", "triage_score", "date_relation", "entity_match", "triage_rank")


@query(
    """SELECT symbol_era_id, CASE WHEN ciks > 1 THEN 'identity_collision_hold' WHEN ciks = 1 THEN 'identity_verified_ready' WHEN ev = 0 THEN 'identity_no_evidence' ELSE 'identity_weak_hold' END AS identity_bucket, ev AS evidence, ciks
    FROM (SELECT e.symbol_era_id, count(o.o_orderkey) AS ev, count(DISTINCT o.o_custkey % 20) AS ciks FROM book e LEFT JOIN orders o ON e.symbol = 'X' || (o.o_custkey % 97) AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F'
    AND CAST(o.o_orderdate AS DATE) BETWEEN strptime(e.first_day, '%Y%m%d')::DATE - 45 AND strptime(e.last_day, '%Y%m%d')::DATE + 90 GROUP BY 1)""",
    "book",
)
def identity_buckets(t: Inputs) -> DataFrame:
    evidence = t.table("orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.concat(F.lit("X"), (F.col("o_custkey") % 97).cast("string")).alias("ticker"), (F.col("o_custkey") % 20).cast("string").alias("cik"), F.to_date("o_orderdate").alias("filing_date"))
    return worklists.identity_buckets(b.book(t), evidence).select("symbol_era_id", "identity_bucket", "evidence", "ciks")


@query(
    """SELECT symbol_era_id, CASE WHEN x % 3 = 0 THEN CASE WHEN x % 2 = 0 THEN 'form25_agree' ELSE 'form25_conflict' END WHEN x % 3 = 1 THEN CASE WHEN x % 4 = 0 THEN 'sec_name_agree' ELSE 'sec_name_conflict' END ELSE 'uncorroborated' END AS corroboration
    FROM (SELECT symbol_era_id, o_orderkey AS x FROM best)""",
    "best",
)
def corroboration(t: Inputs) -> DataFrame:
    x = F.col("o_orderkey")
    rows = b.best(t).withColumn("issuer", F.lit("The Acme Company"))
    other = rows.select("symbol_era_id", F.when(x % 3 == 0, F.when(x % 2 == 0, "ACME CO").otherwise("ZETA")).alias("catalog_name"), F.when(x % 3 == 1, F.when(x % 4 == 0, "Acme, Inc.").otherwise("ETA")).alias("registry_name"))
    return facts.corroborated(rows, other, names.normal_issuer).select("symbol_era_id", "corroboration")


@query("SELECT symbol_era_id, count(*) AS n, count(*) FILTER (o_orderkey % 6 = 0) AS invalid FROM found GROUP BY 1 HAVING count(*) > 1 OR count(*) FILTER (o_orderkey % 6 = 0) > 0", "found")
def ledger_errors(t: Inputs) -> DataFrame:
    rows = b.found(t).withColumn("resolution_status", F.when(F.col("o_orderkey") % 6 == 0, "nonsense").otherwise("review_ready"))
    return facts.ledger_errors(rows, ("review_ready", "manual_required"))


@query(
    """SELECT count(*) AS rows, printf('%016x%016x', bit_xor(('0x' || substr(h, 1, 16))::UBIGINT), bit_xor(('0x' || substr(h, 17, 16))::UBIGINT)) AS hash
    FROM (SELECT md5(concat_ws(chr(31), fact_id, symbol_era_id, verification_state)) AS h FROM found)""",
    "found",
)
def cohort_hash(t: Inputs) -> DataFrame:
    return facts.cohort_hash(b.found(t), ["fact_id", "symbol_era_id", "verification_state"])


@query(
    """SELECT o_orderkey, 'identity:' || substr(sha256('{"entity_id":"' || entity_id || '","issuer":"' || replace(issuer, '"', '\\"') || '","symbol_era_id":"' || symbol_era_id || '","verification_state":"' || verification_state || '"}'), 1, 24) AS id FROM found""",
    "found",
)
def fact_ids(t: Inputs) -> DataFrame:
    rows = b.found(t).withColumn("id", facts.fact_id("identity", ["symbol_era_id", "verification_state", "issuer", "entity_id", "created_at"]))
    return rows.select("o_orderkey", "id")


@query("SELECT issuer, min(first_day) AS first_day, max(last_day) AS last_day, CASE WHEN count(DISTINCT symbol) = 1 THEN min(symbol) END AS only_symbol FROM book GROUP BY issuer", "book")
def issuer_spans(t: Inputs) -> DataFrame:
    one = F.when(F.count_distinct("symbol") == 1, F.min("symbol"))
    return b.book(t).groupBy("issuer").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), one.alias("only_symbol"))


@query("SELECT variant, count(*) AS cases, count(*) FILTER (truth) AS truths, round(count(*) FILTER (truth AND hit) / count(*) FILTER (truth), 4) AS recall, count(*) FILTER (hit AND NOT truth) AS noise_only FROM (SELECT event_type AS variant, event_id % 3 = 0 AS truth, event_id % 4 <> 1 AS hit FROM events) GROUP BY variant")
def recall_by_variant(t: Inputs) -> DataFrame:
    rows = t.table("events").select(F.col("event_type").alias("variant"), (F.col("event_id") % 3 == 0).alias("truth"), (F.col("event_id") % 4 != 1).alias("hit"))
    return summaries.recall(rows, "variant")


@query(
    """SELECT day, published, bool_and(published) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS in_prefix FROM (SELECT strftime(ts, '%Y%m%d') AS day, count(*) FILTER (event_type = 'error') < 95 AS published FROM events GROUP BY 1)"""
)
def backfill_progress(t: Inputs) -> DataFrame:
    return summaries.backfill_progress(t.table("events").groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg((F.count_if(F.col("event_type") == "error") < 95).alias("published")))


@query("SELECT CASE WHEN event_type <> 'purchase' THEN event_type END AS failure, count(*) AS runs, count(DISTINCT strftime(ts, '%Y%m%d')) AS days, near(avg(value), 2) AS mean_seconds, near(avg(user_id), 2) AS mean_bytes FROM events GROUP BY 1")
def backfill_failures(t: Inputs) -> DataFrame:
    runs = t.table("events").select(F.date_format("ts", "yyyyMMdd").alias("day"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("failure"), F.col("value").alias("seconds"), F.col("user_id").alias("bytes"))
    return summaries.backfill_summary(runs).withColumns({"mean_seconds": near("mean_seconds", 2), "mean_bytes": near("mean_bytes", 2)})


@query("SELECT event_type AS stage, count(*) AS rows, near(sum(value), 2) AS seconds, near(count(*) / sum(value), 6) AS rows_per_second FROM events GROUP BY 1")
def profile_rates(t: Inputs) -> DataFrame:
    out = summaries.profile_rates(t.table("events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))
    return out.withColumns({"seconds": near("seconds", 2), "rows_per_second": near("rows_per_second", 6)})


@query("SELECT count(*) AS eras, count(*) FILTER (c IS NULL) AS only_decided, count(*) FILTER (d IS NULL) AS only_cohort FROM (SELECT DISTINCT symbol_era_id, 1 AS c FROM found WHERE batch <> 'P') FULL JOIN (SELECT DISTINCT symbol_era_id, 1 AS d FROM found WHERE batch <> 'F') USING (symbol_era_id)", "found")
def reconciliation(t: Inputs) -> DataFrame:
    rows = b.found(t)
    return summaries.reconciliation(rows.filter("batch <> 'P'"), rows.filter("batch <> 'F'"))


@query("SELECT conv_id, bool_or(low AND lag) AS stops FROM (SELECT conv_id, length(text) < 200 AS low, coalesce(lag(length(text) < 200) OVER (PARTITION BY conv_id ORDER BY turn, text), false) AS lag FROM conversations) GROUP BY conv_id")
def two_low_batches(t: Inputs) -> DataFrame:
    return summaries.two_in_a_row(t.table("conversations"), "conv_id", ["turn", "text"], F.length("text") < 200)


@query("SELECT symbol_era_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY symbol_era_id ORDER BY CASE verification_state WHEN 'verified' THEN 0 WHEN 'corroborated' THEN 1 ELSE 2 END, abs(date_diff('day', strptime('19980601', '%Y%m%d')::DATE, strptime(created_at, '%Y%m%d')::DATE)), o_orderkey) AS k FROM found) WHERE k <= 2", "found")
def form_then_distance(t: Inputs) -> DataFrame:
    state = F.col("verification_state")
    first = F.when(state == "verified", 0).when(state == "corroborated", 1).otherwise(2)
    distance = F.abs(F.datediff(F.to_date("created_at", "yyyyMMdd"), F.lit("1998-06-01").cast("date")))
    return summaries.form_then_distance(b.found(t), first, distance, "symbol_era_id", "o_orderkey", 2).select("symbol_era_id", "o_orderkey")


@query("SELECT o_orderkey, verification_state FROM found ORDER BY CASE verification_state WHEN 'verified' THEN 0 ELSE 1 END, md5(o_orderkey || ':7'), o_orderkey LIMIT 500", "found")
def seeded_sample(t: Inputs) -> DataFrame:
    """A sampling operator: verified facts first, then others in the order of a seeded hash."""
    return summaries.seeded_sample(b.found(t), F.col("verification_state") == "verified", "o_orderkey", 7, 500).select("o_orderkey", "verification_state")


@query("SELECT cik AS parent_cik, strftime(DATE '1970-01-01' + CAST(14 * (date_diff('day', DATE '1970-01-01', strptime(last_day, '%Y%m%d')::DATE) // 14) AS INTEGER), '%Y-%m-%d') AS action_window, count(*) AS children FROM book GROUP BY ALL", "book")
def derivative_groups(t: Inputs) -> DataFrame:
    days = F.unix_date(F.to_date("last_day", "yyyyMMdd"))
    window = F.date_format(F.date_from_unix_date((F.floor(days / 14) * 14).cast("int")), "yyyy-MM-dd")
    return b.book(t).groupBy(F.col("cik").alias("parent_cik"), window.alias("action_window")).agg(F.count("*").alias("children"))


@query("SELECT symbol_era_id, x AS missing_flags, x = '' AS ready FROM (SELECT symbol_era_id, concat_ws(',', CASE WHEN n % 2 <> 0 THEN 'parent' END, CASE WHEN n % 3 <> 0 THEN 'symbol' END) AS x FROM book)", "book")
def required_flags(t: Inputs) -> DataFrame:
    n = F.col("n")
    have = F.array_compact(F.array(F.when(n % 2 == 0, "parent"), F.when(n % 3 == 0, "symbol"), F.lit("extra")))
    missing = F.array_except(F.array(F.lit("parent"), F.lit("symbol")), have)
    return b.book(t).select("symbol_era_id", F.concat_ws(",", missing).alias("missing_flags"), (F.size(missing) == 0).alias("ready"))


@query("SELECT symbol_era_id, coalesce(nullif(issuer, ''), CASE WHEN n % 2 = 0 THEN 'fallback ' || symbol END) AS issuer, CASE WHEN issuer <> '' THEN 'identity' WHEN n % 2 = 0 THEN 'listing' END AS issuer_source FROM book", "book")
def issuer_fallback(t: Inputs) -> DataFrame:
    rows = b.book(t)
    other = rows.filter("n % 2 = 0").select("symbol_era_id", F.concat(F.lit("fallback "), "symbol").alias("other"))
    own = F.nullif("issuer", F.lit(""))
    return rows.join(other, "symbol_era_id", "left").select("symbol_era_id", F.coalesce(own, "other").alias("issuer"), F.when(own.isNotNull(), "identity").when(F.col("other").isNotNull(), "listing").alias("issuer_source"))


@query("SELECT symbol_era_id FROM book WHERE n % 2 = 0 AND symbol_era_id IN (SELECT symbol_era_id FROM book WHERE n % 3 = 0)", "book")
def set_intersection(t: Inputs) -> DataFrame:
    rows = b.book(t).select("symbol_era_id", "n")
    return rows.filter("n % 2 = 0").select("symbol_era_id").intersect(rows.filter("n % 3 = 0").select("symbol_era_id"))


@query("SELECT DISTINCT symbol FROM book WHERE symbol NOT IN (SELECT symbol FROM book WHERE n % 3 = 0)", "book")
def set_difference(t: Inputs) -> DataFrame:
    rows = b.book(t)
    return rows.select("symbol").subtract(rows.filter("n % 3 = 0").select("symbol"))


@query(
    """SELECT 0.2 AS min_trade_share, count(*) AS scanned_day_count, count(*) FILTER (reason IS NULL) AS valid_day_count, count(reason) AS quarantined_day_count, coalesce(string_agg(day || '=' || reason, ',' ORDER BY day) FILTER (reason IS NOT NULL), '') AS quarantined
    FROM (SELECT *, CASE WHEN isodow(strptime(day, '%Y%m%d')) >= 6 THEN 'weekend_session' WHEN trade_rows = 0 THEN 'no_trade_reports' WHEN trade_rows / total_rows < 0.2 THEN 'low_trade_share' END AS reason
    FROM (SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS total_rows, count(*) FILTER (event_type = 'purchase') AS trade_rows FROM events GROUP BY 1))"""
)
def validity_manifest(t: Inputs) -> DataFrame:
    days = t.table("events").groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.count("*").alias("total_rows"), F.count_if(F.col("event_type") == "purchase").alias("trade_rows"))
    out = summaries.validity_manifest(days, 0.2)
    return out.withColumn("quarantined", F.array_join(F.transform("quarantined_days", lambda x: F.concat(x["day"], F.lit("="), x["reason"])), ",")).drop("quarantined_days")


_LEADS = f"""SELECT 'C' || o_custkey AS symbol, 'C' || o_custkey || '#' || year(o_orderdate) AS symbol_era_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS triage_rank,
{b.sql_pick(list(worklists.BUCKETS), "o_orderkey")} AS triage_bucket, o_orderkey % 90 AS triage_score, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, {b.sql_pick(["ACME INC (ABC) (CIK 1)", "", "ZETA (X) CORP"], "o_orderkey // 3")} AS entity,
{b.sql_pick(["25-NSE", "sc 13e3 ", "8-K", "15-12B"], "o_orderkey // 2")} AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed_at FROM orders"""


def _leads(t: Inputs) -> DataFrame:
    k, o = F.col("o_orderkey"), t.table("orders")
    symbol, year = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.date_format("o_orderdate", "yyyy")
    rank = F.row_number().over(Window.partitionBy("o_custkey", year).orderBy("o_orderkey"))
    return o.select(
        symbol.alias("symbol"), F.concat(symbol, F.lit("#"), year).alias("symbol_era_id"), year.alias("first_day"), F.concat(year, F.lit("1231")).alias("last_day"), rank.cast("string").alias("triage_rank"), b.pick(list(worklists.BUCKETS), k).alias("triage_bucket"),
        (k % 90).alias("triage_score"), F.lit("r").alias("triage_reason"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), b.pick(["ACME INC (ABC) (CIK 1)", "", "ZETA (X) CORP"], F.floor(k / 3)).alias("entity"),
        b.pick(["25-NSE", "sc 13e3 ", "8-K", "15-12B"], F.floor(k / 2)).alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed_at"), F.concat(F.lit("1-2-"), k.cast("string")).alias("accession_no"),
    )


_LED = """SELECT symbol_era_id, {0} CASE entity WHEN 'ACME INC (ABC) (CIK 1)' THEN 'ACME INC' ELSE entity END AS issuer, {1} AS event_type, 'https://www.sec.gov/Archives/edgar/data/' || nullif(ltrim(cik, '0'), '') || '/12' || o_orderkey || '/' AS url"""


@query(
    _LED.format("", "CASE WHEN form IN ('25-NSE', '15-12B') THEN 'delisting_or_registration_termination_lead' WHEN form = 'sc 13e3 ' THEN 'going_private_lead' ELSE 'merger_or_acquisition_lead' END")
    + f""", 'SEC triage ' || triage_bucket || ' score=' || triage_score || '; r; form=' || form || '. Verify issuer, CIK, event, successor, and final delisting/closing before changing research_status to verified.' AS note
    FROM ({_LEADS}) WHERE triage_rank = 1 AND triage_bucket <> 'manual_review_lead'"""
)
def lead_candidates(t: Inputs) -> DataFrame:
    rows = _leads(t)
    out = worklists.lead_candidates(rows.select("symbol", "symbol_era_id", F.lit("old").alias("research_note")).distinct(), rows, "medium_confidence_lead")
    return out.select("symbol_era_id", F.col("proposed_historical_issuer_name").alias("issuer"), F.col("proposed_historical_event_type").alias("event_type"), F.col("primary_source_url").alias("url"), F.col("research_note").alias("note"))


@query(
    _LED.format("anchor AS lifecycle_anchor,", "CASE WHEN anchor = 'first' THEN 'trading_commencement_or_symbol_lifecycle_lead' WHEN form IN ('25-NSE', '15-12B') THEN 'delisting_or_registration_termination_lead' WHEN form = 'sc 13e3 ' THEN 'going_private_lead' ELSE 'operating_lifecycle_terminal_lead' END")
    + f""", 'SEC lifecycle ' || anchor || '-anchor triage ' || triage_bucket || ' score=' || triage_score || '; r.' AS note FROM ({_LEADS}) JOIN (SELECT unnest(['first', 'last']) AS anchor) ON anchor = 'first' OR o_orderkey % 2 = 0 WHERE triage_rank = 1"""
)
def lifecycle_candidates(t: Inputs) -> DataFrame:
    rows = _leads(t)
    keys = ["symbol", "symbol_era_id", "first_day", "last_day"]
    later = rows.filter("triage_rank = '1' and cast(split(accession_no, '-')[2] as bigint) % 2 = 0").select(*keys)
    windows = rows.select(*keys).distinct().withColumn("lifecycle_anchor", F.lit("first")).unionByName(later.withColumn("lifecycle_anchor", F.lit("last")))
    out = worklists.lead_candidates(windows, rows, anchored=True)
    return out.select("symbol_era_id", "lifecycle_anchor", F.col("proposed_historical_issuer_name").alias("issuer"), F.col("proposed_historical_event_type").alias("event_type"), F.col("primary_source_url").alias("url"), F.col("research_note").alias("note"))


@query(
    """SELECT e.symbol_era_id, i.o_orderkey AS identity, v.o_orderkey AS event, coalesce(i.verification_state IN ('verified', 'corroborated') OR (i.verification_state = 'openfigi_asserted' AND NOT i.contested), false) AS identity_usable_default,
    CAST(date_diff('day', strptime(e.first_day, '%Y%m%d')::DATE, strptime(e.last_day, '%Y%m%d')::DATE) AS INTEGER) AS era_span_days
    FROM (SELECT symbol_era_id, min(created_at) AS first_day, max(created_at) AS last_day FROM found GROUP BY 1) e LEFT JOIN (SELECT * FROM best WHERE batch <> 'F') i USING (symbol_era_id) LEFT JOIN (SELECT * FROM best WHERE batch <> 'O') v USING (symbol_era_id)""",
    "best",
)
def enriched_eras(t: Inputs) -> DataFrame:
    best = b.best(t)
    eras = b.found(t).groupBy("symbol_era_id").agg(F.min("created_at").alias("first_day"), F.max("created_at").alias("last_day"))
    identities = best.filter("batch <> 'F'").select("symbol_era_id", F.col("verification_state").alias("identity_tier"), F.col("contested").alias("identity_contested"), F.col("o_orderkey").alias("identity"))
    events = best.filter("batch <> 'O'").select("symbol_era_id", F.col("o_orderkey").alias("event"))
    return worklists.enriched_eras(eras, identities, events).select("symbol_era_id", "identity", "event", "identity_usable_default", "era_span_days")


@query(
    """SELECT symbol_era_id, status, CASE WHEN same = 1 OR status = 'single' THEN figi END AS figi, CASE WHEN status = 'single' THEN 'single_figi_staged' WHEN same = 1 THEN 'multi_figi_bound' ELSE 'multi_figi_held' END AS binding
    FROM (SELECT symbol_era_id, CASE WHEN n % 3 = 0 THEN 'single' ELSE 'multi' END AS status, CASE WHEN n % 3 = 0 OR n % 4 = 1 THEN 'F0' || symbol WHEN n % 4 = 2 THEN 'F1' || symbol END AS figi, CASE n % 4 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS same FROM book WHERE n % 5 <> 0)""",
    "book",
)
def figi_binding(t: Inputs) -> DataFrame:
    rows, n = b.book(t), F.col("n")
    eras = rows.select("symbol", "symbol_era_id", F.when(n % 3 == 0, "single").otherwise("multi").alias("match_status"))
    place = F.explode(F.array(*map(F.lit, range(4)))).alias("place")
    listed = rows.select("symbol").distinct().select("symbol", place).withColumns({"figi": F.concat(F.lit("F"), F.col("place").cast("string"), "symbol"), "name": b.pick(["ACME INC", "The Zeta Co", "ETA CORP", "Eta Inc"], F.col("place"))})
    catalog = rows.select("symbol_era_id", b.pick([None, "Acme Corp", "ZETA", "ETA"], n).alias("catalog_name"))
    out = facts.bound_identities(eras, listed, catalog, rows.filter("n % 5 = 0"), names.normal_issuer)
    return out.join(eras.select("symbol_era_id", F.col("match_status").alias("status")), "symbol_era_id").select("symbol_era_id", "status", "figi", "binding")


@query(
    """SELECT issuer AS identity_issuer, CASE WHEN k % 13 = 0 THEN 'no_candidates' WHEN k % 11 = 0 THEN 'fetch_error' WHEN n = 0 THEN 'no_validated_match' WHEN n = 1 AND one_gone THEN 'no_validated_match' WHEN n = 1 THEN 'matched' WHEN open = 0 AND live = 1 THEN 'matched' ELSE 'ambiguous_candidates' END AS match_status,
    n = 1 AND one_gone AND k % 11 <> 0 AND k % 13 <> 0 AS identity_disproven, CASE WHEN k % 11 <> 0 AND k % 13 <> 0 AND NOT (n = 1 AND one_gone) AND n >= 1 AND (n = 1 OR (open = 0 AND live = 1)) THEN CASE WHEN a AND (n = 1 OR NOT ga) THEN CAST(k AS VARCHAR) ELSE 'B' || k END END AS matched_cik
    FROM (SELECT *, a::INT + z::INT AS n, CASE WHEN a AND NOT z THEN ga WHEN z AND NOT a THEN gz ELSE false END AS one_gone, (a AND NOT ga AND NOT pa)::INT + (z AND NOT gz AND NOT pz)::INT AS open, (a AND pa)::INT + (z AND pz)::INT AS live
    FROM (SELECT 'FIRM ' || c_custkey || ' CORP-CL A' AS issuer, c_custkey AS k, c_custkey % 5 <> 0 AS a, c_custkey % 3 = 0 AS z, c_custkey % 4 = 0 AS ga, c_custkey % 4 = 1 AS pa, c_custkey % 7 < 3 AS gz, c_custkey % 7 >= 5 AS pz FROM customer))"""
)
def company_search(t: Inputs) -> DataFrame:
    k, c = F.col("c_custkey"), t.table("customer")
    day = lambda s: F.lit(s).cast("date")
    firm = F.concat(F.lit("FIRM "), k.cast("string"))
    issuers = c.select(F.concat(firm, F.lit(" CORP-CL A")).alias("identity_issuer"), day("1997-01-01").alias("first_day"), day("1997-12-31").alias("last_day"), F.lit(None).cast("string").alias("ticker"))
    ciks = F.when(k % 11 == 0, F.array(F.lit("none"))).when(k % 3 == 0, F.array(k.cast("string"), F.concat(F.lit("B"), k.cast("string")))).otherwise(F.array(k.cast("string")))
    search = c.filter(k % 13 != 0).select(F.concat(firm, F.lit(" Corp")).alias("query"), F.posexplode(ciks).alias("rank", "cik"))
    bracket, inside, gone = F.array(day("1990-01-01"), day("1999-01-01")), F.array(day("1997-05-05")), F.array(day("1991-01-01"))
    dates = lambda x, lo, hi: F.when(x < lo, gone).when(x >= hi, inside).otherwise(bracket)
    one = c.select(k.cast("string").alias("cik"), F.concat(firm, F.lit(" Inc")).alias("entity_name"), F.when(k % 5 != 0, "1").alias("sic"), F.when(k % 4 == 0, gone).when(k % 4 == 1, inside).otherwise(bracket).alias("filing_dates"))
    two = c.filter(k % 3 == 0).select(F.concat(F.lit("B"), k.cast("string")).alias("cik"), F.lit("Else").alias("entity_name"), F.lit("2").alias("sic"), dates(k % 7, 3, 5).alias("filing_dates"), F.array(F.concat(firm, F.lit(", Co."))).alias("former_names"))
    known = one.withColumn("former_names", F.lit(None).cast("array<string>")).unionByName(two).withColumns(
        {"sic_description": F.lit("d"), "entity_type": F.lit("other"), "substantive_filing_dates": F.array().cast("array<date>"), "has_older_shards": F.lit(False), "bdc_election_filed": F.lit(False)}
    )
    return companies.company_matches(issuers, search, known).select("identity_issuer", "match_status", "identity_disproven", "matched_cik")
