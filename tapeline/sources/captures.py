"""Packet captures to message payloads, and payloads to trades and price levels.

A capture file is one row of Spark's ``binaryFile`` source, which holds up to 2 GB, compressed or
not; one task reads a file, and as many run as there are files. What is compressed is read as a
stream. Only the places of messages are found one by one: what they say is read from all messages
of a block at once.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import market

# Magic numbers, block types, link types and protocol numbers of the public formats, and the two
# versions' leading bytes of the transport header.
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
PCAP_MAGIC = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<", b"\x4d\x3c\x2b\x1a": "<", b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">", b"\x1a\x2b\x3c\x4d": ">"}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ETHERNET, RAW_IP, UDP = 1, 101, 17
IPV4, IPV6, VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8, 0x9100)
VERSIONS = {"1.5": b"\x01\x00\x02\x80\x01\x00\x00\x00", "1.6": b"\x01\x00\x03\x80\x01\x00\x00\x00"}
HEADER = 40


#: Bytes of segments that are decoded at once.
BLOCK = 4 << 20


def _opened(content: bytes) -> io.BufferedIOBase:
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def capture_format(content: bytes) -> str:
    """pcapng, pcap or unknown, by the first four bytes; gzip is looked through."""
    try:
        start = _opened(content).read(4)
    except (OSError, EOFError, zlib.error):
        return "unknown"
    return "pcapng" if start == PCAPNG_MAGIC else "pcap" if start in PCAP_MAGIC else "unknown"


def packets(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Link type and bytes of each packet; raises ValueError where a capture is cut off or malformed."""
    kind = capture_format(content)
    if kind == "unknown":
        raise ValueError("unknown capture format")
    try:
        yield from (_pcap if kind == "pcap" else _pcapng)(_opened(content))
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"cut off in the compression: {e}") from e


def _pcap(f: io.BufferedIOBase) -> Iterator[tuple[int, bytes]]:
    head = f.read(24)
    if len(head) < 24:
        raise ValueError("cut off in the global header")
    order = PCAP_MAGIC[head[:4]]
    link, sizes = struct.unpack_from(order + "I", head, 20)[0], struct.Struct(order + "8xI4x")
    while head := f.read(16):
        if len(head) < 16:
            raise ValueError("cut off in a packet header")
        size = sizes.unpack(head)[0]
        packet = f.read(size)
        if len(packet) < size:
            raise ValueError("cut off in a packet")
        yield link, packet


def _pcapng(f: io.BufferedIOBase) -> Iterator[tuple[int, bytes]]:
    order, links = "<", []
    while head := f.read(12):
        if len(head) < 12:
            raise ValueError("cut off in a block header")
        if struct.unpack_from("<I", head)[0] == SECTION:
            order = {0x1A2B3C4D: "<", 0x4D3C2B1A: ">"}.get(struct.unpack_from("<I", head, 8)[0], "")
            if not order:
                raise ValueError("unknown byte order")
            links = []
        kind, size = struct.unpack_from(order + "II", head)
        block = head[8:] + f.read(max(0, size - 12))
        if size < 12 or len(block) < size - 8 or struct.unpack(order + "I", block[-4:])[0] != size:
            raise ValueError("block sizes disagree")
        body = block[:-4]
        if kind == INTERFACE:
            links.append(struct.unpack_from(order + "H", body)[0])
        elif kind == ENHANCED:
            which, _, _, kept, _ = struct.unpack_from(order + "5I", body)
            yield links[which] if which < len(links) else ETHERNET, body[20 : 20 + kept]
        elif kind == SIMPLE:
            yield links[0] if links else ETHERNET, body[4 : 4 + struct.unpack_from(order + "I", body)[0]]


def udp_payload(link: int, packet: bytes) -> bytes | None:
    """What a packet carries by UDP over IPv4 or IPv6, behind any number of VLAN tags; None for others."""
    if link == ETHERNET:
        at = 12
        while len(packet) >= at + 2 and int.from_bytes(packet[at : at + 2], "big") in VLAN:
            at += 4
        version = {IPV4: 4, IPV6: 6}.get(int.from_bytes(packet[at : at + 2], "big"))
        packet = packet[at + 2 :]
    elif link == RAW_IP and len(packet):
        version = packet[0] >> 4
    else:
        return None
    if version == 4 and len(packet) >= 20 and packet[9] == UDP:
        start, end = (packet[0] & 15) * 4, int.from_bytes(packet[2:4], "big") or len(packet)
        if start < 20:
            return None
    elif version == 6 and len(packet) >= 40 and packet[6] == UDP:
        start, end = 40, 40 + int.from_bytes(packet[4:6], "big")
    else:
        return None
    if len(packet) < start + 8:
        return None
    end = min(end, len(packet), start + int.from_bytes(packet[start + 4 : start + 6], "big"))
    return packet[start + 8 : end] if end >= start + 8 else None


def segment(raw: bytes, version: str | None = None) -> bytes | None:
    """A payload from its transport header on, if it has one and holds messages."""
    starts = [at for v, prefix in VERSIONS.items() if version in (None, v) and (at := raw.find(prefix)) >= 0]
    if not starts or len(raw) < min(starts) + HEADER:
        return None
    raw = raw[min(starts) :]
    return raw if struct.unpack_from("<h", raw, 14)[0] > 0 else None


_SIZE = struct.Struct("<H")


def message_places(raw: bytes) -> list[int]:
    """Where the messages of a segment begin, behind their sizes; raises ValueError if its sizes disagree."""
    size, count = struct.unpack_from("<Hh", raw, 12)
    at, end, places, read = HEADER, len(raw), [], _SIZE.unpack_from
    for _ in range(count):
        if at + 2 > end:
            raise ValueError("fewer messages than announced")
        n = read(raw, at)[0]
        places.append(at + 2)
        at += 2 + n
        if at > end:
            raise ValueError("a message is cut off")
    if at - HEADER != size:
        raise ValueError("payload size and messages disagree")
    return places


_DECODED = "path string, packet long, kind string, timestamp long, symbol string, size long, price_int long, trade_id long, flags int, error string"
_KINDS = {"T": "TradeReport", "B": "TradeBreak", "8": "BidLevel", "5": "AskLevel"}
# The public layout of a trade message, of which a price level has all but the trade id.
_LAYOUT = np.dtype([("kind", "u1"), ("flags", "u1"), ("timestamp", "<i8"), ("symbol", "<u8"), ("size", "<u4"), ("price", "<i8"), ("trade", "<i8")])
_LEVEL = 30


class _Segments:
    """Segments of one file, to be decoded together."""

    def __init__(self, path: str):
        self.path, self.errors = path, []
        self._clear()

    def _clear(self) -> None:
        self.raw, self.held, self.places, self.ends, self.packet = [], 0, [], [], []

    def add(self, number: int, raw: bytes) -> None:
        try:
            places = message_places(raw)
        except ValueError as e:
            self.errors.append((number, str(e)))
            return
        self.places += [self.held + p for p in places]
        self.ends += [self.held + p - 2 for p in places[1:]] + [self.held + len(raw)] * bool(places)
        self.packet += [number] * len(places)
        self.raw.append(raw)
        self.held += len(raw)

    def batch(self) -> pa.RecordBatch:
        """Rows of what has been added since the last batch, and of errors."""
        data = np.frombuffer(b"".join(self.raw) + b"\0" * _LAYOUT.itemsize, np.uint8)
        at, size, packet = np.array(self.places, np.int64), np.array(self.ends, np.int64) - np.array(self.places, np.int64), np.array(self.packet, np.int64)
        kind = np.where(size > 0, data[at], 0) if len(at) else np.zeros(0, np.uint8)
        trade, level = (np.isin(kind, [ord(x) for x in of]) & (size >= least) for of, least in (("TB", _LAYOUT.itemsize), ("85", _LEVEL)))
        wrong = np.unique(packet[level & ((data[np.minimum(at + 1, len(data) - 1)] if len(at) else kind) > 1)])
        self.errors += [(int(n), "event flag of a price level is neither 0 nor 1") for n in wrong]
        some = (trade | level) & ~np.isin(packet, wrong)
        rows = data[at[some][:, None] + np.arange(_LAYOUT.itemsize)].reshape(-1).view(_LAYOUT)
        symbols, which = np.unique(rows["symbol"], return_inverse=True)
        names = pa.array([int(x).to_bytes(8, "little").decode("latin-1").rstrip() for x in symbols], pa.string())
        columns = {
            "path": pa.array([self.path] * len(rows), pa.string()), "packet": pa.array(packet[some]), "kind": pa.array([_KINDS[chr(k)] for k in range(256) if chr(k) in _KINDS], pa.string()).take(pa.array(np.searchsorted(sorted(map(ord, _KINDS)), rows["kind"]))),
            "timestamp": pa.array(rows["timestamp"]), "symbol": names.take(pa.array(which)), "size": pa.array(rows["size"].astype(np.int64)), "price_int": pa.array(rows["price"]),
            "trade_id": pa.array(rows["trade"], mask=~trade[some]), "flags": pa.array(rows["flags"].astype(np.int32)), "error": pa.nulls(len(rows), pa.string()),
        }
        out = pa.table(columns)
        if self.errors:
            packets_, texts = zip(*self.errors, strict=True)
            bad = pa.table({"path": pa.array([self.path] * len(texts), pa.string()), "packet": pa.array(packets_, pa.int64()), "error": pa.array(texts, pa.string())})
            out = pa.concat_tables([out, bad], promote_options="default").select(list(columns))
        self.errors = []
        self._clear()
        return out.combine_chunks().to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], out.schema)


def decoded(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """One row per trade, break or price level of all captures under ``path``.

    A malformed packet or file gives a row with its error and nothing else; the run goes on.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block, number = _Segments(name), -1
                try:
                    for number, (link, packet) in enumerate(packets(content.as_py())):
                        payload = udp_payload(link, packet)
                        raw = segment(payload, version) if payload is not None else None
                        if raw is not None:
                            block.add(number, raw)
                            if block.held >= BLOCK:
                                yield block.batch()
                except ValueError as e:
                    block.errors.append((number + 1, str(e)))
                yield block.batch()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _DECODED)


def trade_rows(rows: DataFrame) -> DataFrame:
    """Trade reports with float price and condition labels."""
    trades = rows.filter(F.col("kind") == market.TRADE)
    return trades.select(F.col("timestamp").alias("exchange_timestamp_ns"), "symbol", "size", (F.col("price_int") / 10_000.0).alias("price"), F.col("trade_id").cast("string").alias("trade_id"), market.report_labels(F.col("flags")).alias("sale_condition"))


def level_rows(rows: DataFrame) -> DataFrame:
    """Price levels with side and record type: a size of 0 deletes the level."""
    levels = rows.filter(F.col("kind").isin("BidLevel", "AskLevel"))
    return levels.select("timestamp", "symbol", "size", (F.col("price_int") / 10_000.0).alias("price"), (F.col("kind") == "AskLevel").cast("int").alias("ask"), F.when(F.col("size") == 0, "Z").otherwise("R").alias("record_type"), "flags")
