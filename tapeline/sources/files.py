"""Readers of text and Parquet inputs, and the choice of what there is to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import market, names

_TIMES = ("Exchange Timestamp", "Raw Timestamp")
_RENAMED = {"Symbol": "symbol", "Size": "size", "Price": "price", "Trade ID": "trade_id", "Sale Condition": "sale_condition"}


def trade_csv(spark: SparkSession, path: str, symbols: list[str] | None = None, odd_lots: bool = False) -> DataFrame:
    """Trades of CSV files whose event time goes by either of two names.

    Every column is read as text and cast, so that no file is read twice for its types; a missing
    column is an error that names it.
    """
    raw = spark.read.option("header", True).csv(path)
    time = next((c for c in _TIMES if c in raw.columns), None)
    if missing := [c for c in _RENAMED if c not in raw.columns] + ([] if time else [_TIMES[0]]):
        raise ValueError(f"missing columns: {missing}")
    c = F.col
    rows = raw.select(
        c(time).cast("long").alias("exchange_timestamp_ns"),
        F.upper("Symbol").alias("symbol"),
        c("Size").cast("long").alias("size"),
        c("Price").cast("double").alias("price"),
        c("Trade ID").alias("trade_id"),
        F.coalesce("Sale Condition", F.lit("")).alias("sale_condition"),
    )
    if symbols:
        rows = rows.filter(c("symbol").isin([s.upper() for s in symbols]))
    return rows if odd_lots else rows.filter(market.not_odd_lot(c("sale_condition")))


def first_existing(spark: SparkSession, candidates: list[str], pattern: str | None = None) -> str:
    """The first path that exists, else the first match of a pattern, on any file system Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in candidates:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    if pattern:
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        found = sorted(s.getPath().toString() for s in (p.getFileSystem(conf).globStatus(p) or []))
        if found:
            return found[0]
    raise FileNotFoundError(f"checked: {', '.join([*candidates, *([pattern] if pattern else [])])}")


def trade_csv_candidates(root: str, day: str, feed: str = "TOPS") -> tuple[list[str], str]:
    """Where a day's trade file may be, best first, and a pattern for others."""
    folder, feed = f"{root.rstrip('/')}/{day[:4]}/{day[4:6]}", feed.upper()
    both = f"data_feeds_{day}_{day}_IEXTP1_"
    paths = [f"{folder}/{day}_IEXTP1_{feed}1.6_trd.csv", f"{folder}/{day}_IEXTP1_{feed}1.6.pcap_trd.csv", f"{folder}/{both}{feed}1.6_trd.csv"]
    if feed == "DEEP":
        paths.append(f"{folder}/{both}DEEP1.0_trd.csv")
    return paths, f"{folder}/*{day}*IEXTP1*{feed}*_trd.csv"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of line-delimited JSON; no rows if there is no file."""
    try:
        first_existing(spark, [path], path)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def registry_document(documents: DataFrame) -> DataFrame:
    """Registry rows of a document of field names and row arrays (columns ``fields`` and ``data``).

    The fields must be cik, name, ticker and exchange; numbers are padded to ten digits and rows
    without a ticker left out.
    """
    right = F.col("fields") == F.array(*map(F.lit, ("cik", "name", "ticker", "exchange")))
    checked = documents.withColumn("data", F.when(right, F.col("data")).otherwise(F.raise_error(F.lit("unexpected fields")).cast("array<array<string>>")))
    row = checked.select(F.explode("data").alias("r")).filter((F.size("r") == 4) & (F.coalesce(F.col("r")[2], F.lit("")) != ""))
    ticker = F.upper(F.col("r")[2])
    return row.select(F.lpad(F.col("r")[0], 10, "0").alias("sec_cik"), F.col("r")[1].alias("sec_name"), ticker.alias("sec_ticker"), F.col("r")[3].alias("sec_exchange"), names.symbol_key(ticker).alias("sec_symbol_key"))


def delisting_lines(lines: DataFrame) -> DataFrame:
    """ticker, name and event_date of pipe-delimited lines (column ``value``), and whether a line failed.

    Header and trailer lines are left out.
    """
    body = lines.filter(~F.col("value").rlike(r"^(Symbol\||File Creation)") & (F.trim("value") != ""))
    part = F.split("value", r"\|")
    date = F.try_to_date(F.trim(F.get(part, F.lit(2))), "MM/dd/yyyy")
    out = body.select(F.upper(F.trim(F.get(part, F.lit(0)))).alias("ticker"), F.trim(F.get(part, F.lit(1))).alias("name"), date.alias("event_date"))
    return out.withColumn("failed", F.col("event_date").isNull() | ~F.coalesce(F.col("ticker").rlike("^[A-Z][A-Z0-9.-]*$"), F.lit(False)))


def search_hits(payloads: DataFrame) -> DataFrame:
    """issuer, cik, tickers, filing_date and accession of search results (column ``payload``, JSON)."""
    schema = "hits struct<hits:array<struct<_id:string,_source:struct<display_names:array<string>,file_date:string>>>>"
    hit = payloads.select(F.explode(F.from_json("payload", schema)["hits"]["hits"]).alias("h"))
    named = hit.select(F.col("h._id").alias("accession"), F.col("h._source.file_date").alias("filing_date"), F.explode("h._source.display_names").alias("display"))
    shape = r"^(.*?)\s*(?:\(([A-Z0-9.,\- ]+)\)\s*)?\(CIK (\d{10})\)\s*$"
    parts = named.filter(F.col("display").rlike(shape)).select(
        F.regexp_extract("display", shape, 1).alias("issuer"), F.regexp_extract("display", shape, 3).alias("cik"), F.regexp_extract("display", shape, 2).alias("t"), "filing_date", "accession"
    )
    tickers = F.filter(F.split("t", r"\s*,\s*"), lambda x: x != "")
    return parts.withColumn("tickers", tickers).drop("t").dropDuplicates(["issuer", "cik", "tickers", "filing_date", "accession"])


def best_record_per_day(index: DataFrame) -> DataFrame:
    """Of each day's records (day, feed, version, size_bytes, link) the largest, then of the latest version."""
    return index.groupBy("day", "feed").agg(F.max_by(F.struct("link", "version", "size_bytes"), F.struct("size_bytes", "version", "link")).alias("r")).select("day", "feed", "r.*")


def missing_days(index: DataFrame, done: DataFrame, feed: str, first: str, last: str) -> DataFrame:
    """Days of the index in a range and of a feed that have not been done."""
    wanted = index.filter((F.col("feed") == feed) & F.col("day").between(first, last)).select("day").distinct()
    return wanted.join(done.select("day"), "day", "left_anti")


def complete_days(files: DataFrame) -> DataFrame:
    """Days (of rows day, kind) that have both a main and a quote file."""
    return files.groupBy("day").agg(F.count_distinct(F.when(F.col("kind").isin("main", "quote"), F.col("kind"))).alias("n")).filter("n = 2").select("day")


def inline_tags(html: str, tags: tuple[str, ...]) -> list:
    """Columns with the distinct values of tagged facts in a page, in order, by either syntax."""
    out = []
    for tag in tags:
        found = F.concat(
            F.regexp_extract_all(html, F.lit(rf'(?is)<ix:non(?:numeric|fraction)[^>]*name="{tag}"[^>]*>(.*?)</ix:non(?:numeric|fraction)>'), F.lit(1)),
            F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)),
        )
        plain = F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
        out.append(F.array_distinct(F.filter(plain, lambda x: x != "")).alias(tag.split(":")[-1]))
    return out


def filing_fields(text: str) -> list:
    """Columns with issuer, ticker and effective date of a notice's text; null for what it does not say."""
    one = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    ticker = F.coalesce(one(r"(?i:ticker|trading) (?i:symbol)[: ]+[\"']?([A-Z]{1,5})\b"), one(r"\((?:NYSE|NASDAQ|AMEX)[: ]+([A-Z]{1,5})\)"))
    return [
        one(r"(?i)issuer[: ]+([^\n]+)").alias("issuer"),
        F.when(~ticker.isin("THE", "AND", "INC", "NYSE"), ticker).alias("ticker"),
        names.loose_date(one(r"(?i)effective (?:date|on)[: ]+([A-Za-z0-9/, -]{8,20}\d)")).alias("effective_date"),
    ]


def table_rows(pages: DataFrame, keyword: str) -> DataFrame:
    """Cells of table rows of pages (page_id, html) whose header row holds a word, from the row after it.

    Columns: page_id, row (from 1), cells.
    """
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    parsed = pages.select("page_id", F.transform(rows, cells).alias("rows")).filter(F.size("rows") > 1)
    header = F.exists(F.col("rows")[0], lambda c: F.lower(c).contains(keyword.lower()))
    return parsed.filter(header).select("page_id", F.posexplode("rows").alias("row", "cells")).filter("row > 0")
