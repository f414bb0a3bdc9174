import gzip
import struct

import pytest
from pyspark.sql import functions as F

from tapeline.operators import listings
from tapeline.sources import captures, files, sinks
from tapeline.streaming import trades as stream

DAY = 1_736_175_600_000_000_000


def _message(kind, symbol, size, price, trade_id=None, flags=0, ts=DAY):
    raw = kind.encode() + struct.pack("<Bq8sIq", flags, ts, symbol.ljust(8).encode(), size, price)
    return raw + struct.pack("<q", trade_id) if trade_id is not None else raw


def _segment(*messages, version="1.6", count=None):
    body = b"".join(struct.pack("<H", len(m)) + m for m in messages)
    head = captures.VERSIONS[version] + struct.pack("<iHh", 1, len(body), len(messages) if count is None else count) + struct.pack("<qqq", 0, 0, DAY)
    return head + body


def _ipv4(payload, vlan=0):
    udp = struct.pack(">HHHH", 1, 2, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, b"\0" * 4, b"\0" * 4) + udp
    return b"\0" * 12 + struct.pack(">HH", 0x8100, 1) * vlan + struct.pack(">H", 0x0800) + ip + b"padding"


def _ipv6(payload):
    udp = struct.pack(">HHHH", 1, 2, 8 + len(payload), 0) + payload
    return struct.pack(">IHBB16s16s", 6 << 28, len(udp), 17, 64, b"\0" * 16, b"\0" * 16) + udp


def _pcap(*packets, link=1):
    return b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, link) + b"".join(struct.pack("<IIII", 0, 0, len(p), len(p)) + p for p in packets)


def _block(kind, body):
    body += b"\0" * (-len(body) % 4)
    size = len(body) + 12
    return struct.pack("<II", kind, size) + body + struct.pack("<I", size)


def _pcapng(*packets):
    section = _block(captures.SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    return section + _block(captures.INTERFACE, struct.pack("<HHI", 1, 0, 0)) + b"".join(_block(captures.ENHANCED, struct.pack("<5I", 0, 0, 0, len(p), len(p)) + p) for p in packets)


TRADE = _message("T", "AAA", 100, 123_400, 7, 0x20)


@pytest.mark.parametrize("capture", [_pcap(_ipv4(b"xx" + _segment(TRADE), vlan=2)), _pcap(_ipv6(_segment(TRADE, version="1.5")), link=101), _pcapng(_ipv4(_segment(TRADE))), gzip.compress(_pcap(_ipv4(_segment(TRADE))))])
def test_captures_of_all_kinds(spark, tmp_path, capture):
    (tmp_path / "a.pcap").write_bytes(capture)
    rows = captures.decoded(spark, str(tmp_path))
    got = captures.trade_rows(rows).collect()
    assert [(r["symbol"], r["size"], r["price"], r["trade_id"], r["sale_condition"], r["exchange_timestamp_ns"]) for r in got] == [("AAA", 100, 12.34, "7", "REGULAR_HOURS|ODD_LOT", DAY)]


def test_segments_without_messages_are_dropped_and_errors_kept(spark, tmp_path):
    good = _pcap(_ipv4(_segment(count=0)), _ipv4(b"noise"), _ipv4(_segment(TRADE, count=2)), _ipv4(_segment(_message("8", "BB", 0, 10_000), _message("5", "BB", 5, 20_000, flags=1))), _ipv4(_segment(_message("8", "BB", 1, 1, flags=9))))
    (tmp_path / "a.pcap").write_bytes(good)
    (tmp_path / "b.pcap").write_bytes(good[:-3])
    (tmp_path / "c.pcap").write_bytes(b"what is this")
    rows = captures.decoded(spark, str(tmp_path)).cache()
    one = rows.filter(F.col("path").endswith("a.pcap"))
    assert one.filter("error is not null").count() == 2
    levels = captures.level_rows(one).orderBy("ask").collect()
    assert [(r["price"], r["ask"], r["record_type"]) for r in levels] == [(1.0, 0, "Z"), (2.0, 1, "R")]
    errors = {r["path"][-6:]: r["error"] for r in rows.filter("error is not null and path not like '%a.pcap'").collect()}
    assert errors["c.pcap"] == "unknown capture format" and "b.pcap" in errors


def test_other_version_is_left_out(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(_pcap(_ipv4(_segment(TRADE, version="1.5"))))
    assert captures.decoded(spark, str(tmp_path), "1.6").count() == 0


@pytest.mark.parametrize("time", ["Exchange Timestamp", "Raw Timestamp"])
def test_trade_csv(spark, tmp_path, time):
    path = tmp_path / "t.csv"
    path.write_text(f"{time},Symbol,Size,Price,Trade ID,Sale Condition\n1,aaa,5,1.5,1,\n2,AAA,7,1.5,2,ODD_LOT|X\n3,bbb,9,2.5,3,Y\n")
    assert [(r["symbol"], r["size"]) for r in files.trade_csv(spark, str(path)).orderBy("size").collect()] == [("AAA", 5), ("BBB", 9)]
    assert files.trade_csv(spark, str(path), odd_lots=True).count() == 3
    assert files.trade_csv(spark, str(path), ["bbb"]).count() == 1


def test_trade_csv_without_a_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Exchange Timestamp,Symbol,Price,Trade ID,Sale Condition\n1,a,1,1,\n")
    with pytest.raises(ValueError, match="Size"):
        files.trade_csv(spark, str(tmp_path / "t.csv"))


def test_paths(spark, tmp_path):
    folder = tmp_path / "2025" / "01"
    folder.mkdir(parents=True)
    candidates, pattern = files.trade_csv_candidates(str(tmp_path), "20250102")
    with pytest.raises(FileNotFoundError, match="20250102"):
        files.first_existing(spark, candidates, pattern)
    (folder / "x20250102_IEXTP1_TOPS9_trd.csv").write_text("a")
    assert files.first_existing(spark, candidates, pattern).endswith("TOPS9_trd.csv")
    (folder / "20250102_IEXTP1_TOPS1.6.pcap_trd.csv").write_text("a")
    assert files.first_existing(spark, candidates, pattern) == candidates[1]


def test_missing_jsonl_is_empty(spark, tmp_path):
    assert files.jsonl(spark, str(tmp_path / "none.jsonl"), "a string").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": "1"}\n\n{"a": "2"}\n')
    assert files.jsonl(spark, str(tmp_path / "x.jsonl"), "a string").filter("a is not null").count() == 2


def test_days_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(2025, "20250102", 1), (2025, "20250103", 2)], "year int, day string, v int")
    sinks.write_days(rows, path)
    sinks.write_days(rows.filter("day = '20250103'").withColumn("v", F.lit(9)), path)
    assert sorted((str(r["day"]), r["v"]) for r in spark.read.parquet(path).collect()) == [("20250102", 1), ("20250103", 9)]
    assert sinks.prune_days(spark, path, "20250110", 7) == ["20250102"]
    assert sinks.compact(spark, path, str(tmp_path / "master"), ("day",)) == 1


def test_repair_fills_only_what_is_missing(spark):
    rows = spark.createDataFrame([(None, 123_400), (1.0, 5), (None, None)], "price double, price_int long")
    assert sinks.price_audit(rows, {"price": "price_int"}).first().asDict() == {"column": "price", "rows": 3, "nulls": 2, "fillable": 1}
    assert [r["price"] for r in sinks.price_repair(rows, {"price": "price_int"}).collect()] == [12.34, 1.0, None]


def test_pairs_are_published_once(spark, tmp_path):
    rows, paths = spark.range(3), [str(tmp_path / x) for x in ("main", "quote")]
    assert sinks.publish_pair(spark, rows, rows.limit(1), *paths) == (3, 1)
    with pytest.raises(FileExistsError):
        sinks.publish_pair(spark, rows, rows, *paths)
    assert sinks.publish_pair(spark, rows, rows, *paths, replace=True) == (3, 3)


def test_empty_csv_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        sinks.convert_csv(spark, str(tmp_path / "a.csv"), "a int, b int", str(tmp_path / "out"))


def test_run_state_resumes_and_gives_up(spark, tmp_path):
    path, calls = str(tmp_path / "state.json"), []

    def work(day):
        calls.append(day)
        if day == "bad":
            raise OSError("no")

    for _ in range(4):
        got = sinks.RunState(spark, path, "f", "1").run(["a", "bad"], work)
    assert got == {"a": "completed", "bad": "automation_exhausted"} and calls == ["a", "bad", "bad", "bad"]
    with pytest.raises(ValueError, match="other inputs"):
        sinks.RunState(spark, path, "g", "1")


def test_circuit_breaker(spark, tmp_path):
    def work(day):
        raise OSError("down")

    got = sinks.RunState(spark, str(tmp_path / "s.json"), "f", "1").run([str(i) for i in range(30)], work, least=20)
    assert len(got) == 21  # the one after the twentieth is seen but not tried


def test_quarantine_counts_runs(spark):
    rows = [("d", i, t) for i, t in enumerate(["TradeReport", "x", "y", None, "QuoteUpdate", "x"])]
    df = spark.createDataFrame(rows, "day string, timestamp long, type string")
    assert sinks.quarantine_verdict(df, 10, 2).first().asDict() == {"unknown": 4, "longest_run": 3, "abort": True}
    assert [p.count() for p in sinks.split_messages(df)] == [1, 1, 4]


def _stream(spark, tmp_path, rows):
    source = tmp_path / "in"
    spark.createDataFrame(rows, "type string, symbol string, timestamp long, size long, price double, trade_id long").coalesce(1).write.parquet(str(source))
    return spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_drops_repeats_and_sums_by_second(spark, tmp_path):
    rows = [("TradeReport", "AAA", DAY, 10, 10.0, 1), ("TradeReport", "AAA", DAY + 5_000_000, 10, 10.0, 1), ("TradeReport", "AAA", DAY + 999_000_000, 30, 12.0, 2), ("TradeReport", "AAA", DAY + 1_000_000_000, 1, 1.0, 3)]
    out = stream.per_window(stream.distinct_trades(_stream(spark, tmp_path, rows)))
    got = _drain(out, "seconds", "complete").orderBy("window_start").collect()
    assert [(r["share_volume"], r["trade_count"], r["vwap"]) for r in got] == [(40, 2, 11.5), (1, 1, 1.0)]


def test_stream_parts(spark, tmp_path):
    rows = [("TradeReport", "AAA", DAY, 1, 1.0, 1), ("QuoteUpdate", "AAA", DAY, None, None, None), ("What", "AAA", DAY, None, None, None)]
    stream.write_parts(_stream(spark, tmp_path, rows), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert [spark.read.parquet(str(tmp_path / "out" / p)).count() for p in ("main", "quote", "unknown")] == [1, 1, 1]


def test_stream_joins_breaks_and_finds_bursts(spark, tmp_path):
    minute = 60_000_000_000
    rows = [("TradeReport", "AAA", DAY, 10, 10.0, 1), ("TradeReport", "AAA", DAY + minute, 5, 10.0, 2), ("TradeReport", "AAA", DAY + 20 * minute, 7, 10.0, 3), ("TradeBreak", "AAA", DAY + 2 * minute, 5, 10.0, 2), ("TradeReport", "ZZZ", DAY + 900 * minute, 1, 1.0, 9)]
    messages = _stream(spark, tmp_path, rows)
    got = _drain(stream.without_breaks(stream.distinct_trades(messages), messages), "unbroken").collect()
    assert {r["trade_id"] for r in got} >= {1, 3} and 2 not in {r["trade_id"] for r in got}
    got = _drain(stream.bursts(stream.distinct_trades(messages)), "bursts", "complete").filter("symbol = 'AAA'").orderBy("start").collect()
    assert [(r["trade_count"], r["share_volume"]) for r in got] == [(2, 15), (1, 7)]


def test_stream_of_snapshots_folds_into_lifecycles(spark, tmp_path):
    source, schema = tmp_path / "in", "symbol string, snapshot_date string, issuer string"
    parts = [[("A", "2020-01-02", "Acme"), ("B", "2020-01-02", None)], [("A", "2020-01-03", "Acme Inc"), ("A", "2020-01-02", "Acme")], [("A", "2020-01-01", ""), (None, "2020-01-01", "x")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    rows = _drain(stream.lifecycles(stream_in), "lives", "update").collect()
    last = {}
    for r in rows:
        if r["iex_seen_days"] >= last.get(r["symbol"], (0,))[0]:
            last[r["symbol"]] = tuple(r)[3], tuple(r)
    assert {k: v[1] for k, v in last.items()} == {"A": ("A", "2020-01-01", "2020-01-03", 3, "Acme Inc", 2, "Acme | Acme Inc"), "B": ("B", "2020-01-02", "2020-01-02", 1, "", 0, "")}


def test_reports_letters_and_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([("abc", 1), ("b|c", None)], "symbol string, n int")
    sinks.write_reports(rows, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r" / "md")).collect()] == ["| symbol | n |", "| --- | --- |", "| abc | 1 |", "| b\\|c |  |"]
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "csv")).count() == spark.read.json(str(tmp_path / "r" / "jsonl")).count() == spark.read.parquet(str(tmp_path / "r" / "parquet")).count() == 2
    assert spark.read.text(str(tmp_path / "r" / "json")).first()["value"] == '[{"symbol":"abc","n":1},{"symbol":"b|c"}]'
    sinks.write_by_letter(rows, str(tmp_path / "letters"))
    assert {(r["letter"], r["symbol"]) for r in spark.read.parquet(str(tmp_path / "letters")).collect()} == {("A", "abc"), ("B", "b|c")}
    bad = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("d", 3, "TradeReport")], "day string, timestamp long, type string")
    assert sinks.write_quarantine(bad, str(tmp_path / "q"), 10, 1) and not sinks.write_quarantine(bad, str(tmp_path / "q"), 10, 2)
    assert spark.read.parquet(str(tmp_path / "q" / "unknown")).count() == 2
    shots = spark.createDataFrame([("2020-01-01", "A"), ("2020-01-01", "B"), ("2020-01-02", "A")], "snapshot_date string, symbol string")
    assert listings.valid_snapshots(shots, 2).count() == 2 and [tuple(r) for r in listings.invalid_snapshots(shots, 2).collect()] == [("2020-01-02", 1)]
