"""Writers: idempotent by day, checked before they publish, and resumable."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import market
from tapeline.schemas import PRICE_SCALE


def write_days(rows: DataFrame, path: str, *keys: str) -> None:
    """Writes rows partitioned by ``keys`` (year and day unless named); a day that is written again replaces itself.

    Rows are dealt by the keys first, so that a partition is a few files and not one of every task.
    """
    keys = keys or ("year", "day")
    spread = rows.repartition(*[F.col(k) for k in keys])
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def compact(spark: SparkSession, staging: str, target: str, order: tuple[str, ...] = ("symbol", "ts_second_ny")) -> int | None:
    """Rewrites staged parts as few files in order; returns the number of rows, or None if there are none."""
    rows = spark.read.parquet(staging)
    if rows.isEmpty():
        return None
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target).count()


def prune_days(spark: SparkSession, path: str, reference_day: str, keep_days: int) -> list[str]:
    """Deletes the day=YYYYMMDD folders older than ``keep_days`` before a day; returns the days that went."""
    oldest = spark.range(1).select(F.date_format(F.date_sub(F.to_date(F.lit(reference_day), "yyyyMMdd"), keep_days), "yyyyMMdd")).first()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/day=*")) or []:
        day = status.getPath().getName().removeprefix("day=").replace("-", "")
        if day < oldest:
            fs.delete(status.getPath(), True)
            gone.append(day)
    return sorted(gone)


def convert_csv(spark: SparkSession, source: str, schema: str, target: str) -> int:
    """CSV to Parquet; an empty input is an error."""
    rows = spark.read.option("header", True).schema(schema).csv(source)
    if rows.isEmpty():
        raise ValueError(f"no rows in {source}")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target).count()


def split_messages(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Main, quote and unknown messages (columns type and others)."""
    known = list(market.MESSAGE_TYPES.values())
    quote = F.col("type") == "QuoteUpdate"
    is_known = F.coalesce(F.col("type").isin(known), F.lit(False))
    return rows.filter(is_known & ~quote), rows.filter(quote), rows.filter(~is_known)


def quarantine_verdict(rows: DataFrame, total: int, consecutive: int) -> DataFrame:
    """One row: unknown messages, the longest run of them by timestamp, and whether a run must stop.

    Needs day, timestamp and type; runs are looked for within a day.
    """
    from pyspark.sql import Window

    known = F.coalesce(F.col("type").isin(list(market.MESSAGE_TYPES.values())), F.lit(False))
    w = Window.partitionBy("day").orderBy("timestamp", "type")
    runs = rows.withColumn("_known", known).withColumn("_run", F.sum(F.col("_known").cast("int")).over(w))
    each = runs.filter(~F.col("_known")).groupBy("day", "_run").agg(F.count("*").alias("n"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unknown"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_run"))
    return out.withColumn("abort", (F.col("unknown") > total) | (F.col("longest_run") > consecutive))


def write_quarantine(rows: DataFrame, folder: str, total: int, consecutive: int) -> bool:
    """Writes the unknown messages and the verdict on them beside the data; returns whether the run must stop."""
    verdict = quarantine_verdict(rows, total, consecutive)
    split_messages(rows)[2].write.mode("overwrite").parquet(f"{folder}/unknown")
    verdict.coalesce(1).write.mode("overwrite").json(f"{folder}/verdict")
    return bool(rows.sparkSession.read.schema(verdict.schema).json(f"{folder}/verdict").first()["abort"])


def write_by_letter(rows: DataFrame, path: str) -> None:
    """One folder for each first letter of the symbol."""
    rows.withColumn("letter", F.upper(F.substring("symbol", 1, 1))).write.mode("overwrite").partitionBy("letter").parquet(path)


def price_audit(rows: DataFrame, prices: dict[str, str]) -> DataFrame:
    """One row per float price column: rows, nulls, and nulls that its integer column can fill."""
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f).isNull()).alias(f"{f}_null") for f in prices], *[F.count_if(F.col(f).isNull() & F.col(i).isNotNull()).alias(f"{f}_fill") for f, i in prices.items()])
    each = [F.struct(F.lit(f).alias("column"), F.col("rows"), F.col(f"{f}_null").alias("nulls"), F.col(f"{f}_fill").alias("fillable")) for f in prices]
    return counts.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def price_repair(rows: DataFrame, prices: dict[str, str]) -> DataFrame:
    """Null float prices filled from the integer ones; prices that are there stay as they are."""
    return rows.withColumns({f: F.coalesce(F.col(f), F.col(i) / float(PRICE_SCALE)) for f, i in prices.items()})


def publish_pair(spark: SparkSession, main: DataFrame, quote: DataFrame, main_path: str, quote_path: str, replace: bool = False) -> tuple[int, int]:
    """Writes two tables beside their targets, checks them, and moves both into place; refuses to replace unasked."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = {p: jvm.org.apache.hadoop.fs.Path(p) for p in (main_path, quote_path)}
    fs = paths[main_path].getFileSystem(conf)
    if not replace and any(fs.exists(p) for p in paths.values()):
        raise FileExistsError(f"{main_path} or {quote_path} is there already")
    counts = []
    for rows, target in ((main, main_path), (quote, quote_path)):
        rows.write.mode("overwrite").parquet(f"{target}.part")
        written = spark.read.parquet(f"{target}.part")
        if written.schema.simpleString() != rows.schema.simpleString():
            raise ValueError(f"{target}: what was written has another schema")
        counts.append(written.count())
    for target, p in paths.items():
        fs.delete(p, True)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(f"{target}.part"), p):
            raise OSError(f"{target} can't be moved into place")
    return counts[0], counts[1]


def _markdown(rows: DataFrame) -> DataFrame:
    """The rows of a table in Markdown, a line each, its heading first."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|")) for c in rows.columns]
    line = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *x), F.lit(" |"))
    head = rows.sparkSession.range(1).select(F.explode(F.array(F.lit(f"| {' | '.join(rows.columns)} |"), F.lit("|" + " --- |" * len(rows.columns)))).alias("value"))
    return head.coalesce(1).unionByName(rows.coalesce(1).select(line(cells).alias("value"))).coalesce(1)


def write_reports(rows: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet", "csv", "json", "jsonl", "md")) -> None:
    """A small table in several formats, a folder each; json is one array, jsonl a line per row."""
    for kind in formats:
        if kind == "md":
            out = _markdown(rows)
        elif kind == "json":
            out = rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
        else:
            out = rows.coalesce(1)
        writer = out.write.mode("overwrite")
        (writer.option("header", True) if kind == "csv" else writer).format({"md": "text", "json": "text", "jsonl": "json"}.get(kind, kind)).save(f"{folder}/{kind}")


class RunState:
    """Days done, to be retried or given up, with the inputs that they belong to; one small JSON file.

    The file is a line of text that Spark's own file system writes, so that it may lie anywhere.
    """

    def __init__(self, spark: SparkSession, path: str, fingerprint: str, version: str):
        self.spark, self.path = spark, path
        self.state = self._load() or {"fingerprint": fingerprint, "version": version, "rows": {}, "requests": 0, "failures": 0}
        if (self.state["fingerprint"], self.state["version"]) != (fingerprint, version):
            raise ValueError("this state belongs to other inputs or another version")

    def _load(self) -> dict | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self.path, wholetext=True).collect()))

    def save(self) -> None:
        """Writes the state anew."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        out = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(json.dumps(self.state, sort_keys=True), "utf-8"))
        out.close()

    def run(self, keys: list[str], work: Callable[[str], object], attempts: int = 3, least: int = 20, share: float = 0.5) -> dict[str, str]:
        """Does what is not done; a failure is kept and retried next time, and after ``attempts`` given up.

        When more than a share of at least ``least`` requests have failed, the rest is left alone.
        """
        for key in keys:
            row = self.state["rows"].setdefault(key, {"status": "retryable", "attempts": 0})
            if row["status"] != "retryable":
                continue
            if self.state["requests"] >= least and self.state["failures"] > share * self.state["requests"]:
                break
            self.state["requests"] += 1
            row["attempts"] += 1
            try:
                work(key)
                row |= {"status": "completed", "error": ""}
            except Exception as e:  # one day's failure must not end the others
                self.state["failures"] += 1
                row |= {"status": "automation_exhausted" if row["attempts"] >= attempts else "retryable", "error": str(e)[:300]}
            self.save()
        return {k: r["status"] for k, r in self.state["rows"].items()}
