"""Token ids in files of canonical, length-limited Huffman codes.

A file set is a folder of two Parquet tables: ``codebook`` (id, bits: the code length of every
id that occurs) and ``blocks``. Codes are canonical: ordered by length, then id. Lengths come
from the ids' counts over all documents by the package-merge method. A block holds whole
documents in ascending doc_id order and can be read alone: their ids and lengths, the bit
stream, and the bit offset of every 128th id. Reading looks up 20-bit windows in one table
and follows all checkpoints of a block side by side.

Documents are dealt to parts by ranges of doc_id. Rows without a doc_id come first; repeated
rows and rows of one doc_id stand in any order among themselves, and where there are enough of
them to fill parts of their own, they are dealt to these in turn. A null or empty text is the
end id alone. Other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import wordtokens
from tapeline.llm.storage import new_path, small_batches, staged

LIMIT = 20
#: Ids after which a block is closed, and ids between checkpoints.
BLOCK_IDS = 1 << 18
STRIDE = 128

_BLOCKS = "part int, block long, start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, checkpoints array<long>, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the positive ``counts``, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("more symbols than codes")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    packages, is_leaf = np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        is_leaf.append(rank < n)
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        m = int(leaf[:take].sum())
        lengths[:m] += 1
        take = 2 * (take - m)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the codes (indices into ``ids``) and their values in that order."""
    order = np.lexsort((ids, bits))
    b = bits[order]
    longest = int(b[-1]) if len(b) else 0
    full = np.cumsum(np.concatenate([[0], 1 << (longest - b[:-1])])) if len(b) else np.zeros(0, np.int64)
    return order, full >> (longest - b)


def pack_bits(values: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes one after the other, most significant bit first, and each one's bit offset."""
    ends = np.cumsum(bits)
    at = ends - bits
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros((total >> 5) + 2, np.uint64)
    if len(bits):
        place = values.astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] += np.add.reduceat(place >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(place & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (total + 7) >> 3], at


def unpack_bits(payload: bytes, checkpoints: np.ndarray, n: int, symbol: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Reads ``n`` ids; ``symbol`` and ``width`` are the tables over windows of LIMIT bits."""
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    lanes = len(checkpoints)
    out = np.zeros((lanes, STRIDE), np.uint32)
    at = checkpoints.astype(np.int64)
    shift, mask = 32 - LIMIT, (1 << LIMIT) - 1
    for step in range(STRIDE):
        if step == n - (lanes - 1) * STRIDE:  # the last lane is shorter
            at = at[:-1]
        if not len(at):
            break
        code = window[at >> 3] >> (shift - (at & 7)) & mask
        out[: len(at), step] = symbol[code]
        at = at + width[code]
    return out.reshape(-1)[:n]


@functools.lru_cache(maxsize=2)
def _tables(book: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, bits = np.frombuffer(book, np.int64).reshape(2, -1)
    order, _ = canonical(ids, bits)
    spans = 1 << (LIMIT - bits[order])
    symbol, width = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
    used = int(spans.sum())
    symbol[:used], width[:used] = np.repeat(ids[order], spans), np.repeat(bits[order], spans)
    return symbol, width


def _parts(doc: pa.Array, turn: np.ndarray, bounds: np.ndarray, of_nulls: int) -> np.ndarray:
    """Part of each row: by its turn, one of those that may hold its doc_id. Parts up to ``of_nulls`` may hold nulls."""
    ids = doc.fill_null(0).to_numpy()
    first, last = (np.searchsorted(bounds, ids, side) + of_nulls for side in ("left", "right"))
    missing = doc.is_null().to_numpy(zero_copy_only=False)
    first, last = np.where(missing, 0, first), np.where(missing, of_nulls, last)
    return (first + turn % (last - first + 1)).astype(np.int32)


def _encode(path: str, end_id: int, bounds: np.ndarray, of_nulls: int):
    def run(batches):
        seen = 0
        for batch in batches:
            doc = batch.column(0)
            part = _parts(doc, np.arange(seen, seen + len(doc)), bounds, of_nulls)
            seen += len(doc)
            for i, j, ids, at in wordtokens.encoded(batch.column(1), path, end_id):
                small = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else None
                raw, width = (small.tobytes(), 2) if small is not None else (ids.tobytes(), 4)
                rows = [raw[a:b] for a, b in zip((at[:-1] * width).tolist(), (at[1:] * width).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[i:j]), doc.slice(i, j - i), pa.array(np.full(j - i, width, np.int8)), pa.array(rows, pa.binary())], names=["part", "doc_id", "width", "ids"]
                )

    return run


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    kind = {2: "<u2", 4: "<u4"}
    return [np.frombuffer(x.as_buffer(), kind[w]) for x, w in zip(batch.column("ids"), batch.column("width").to_pylist(), strict=True)]


def _count(batches):
    seen = np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = _unpacked(batch.slice(at, 512))
            n = np.bincount(np.concatenate(rows), minlength=len(seen))
            n[: len(seen)] += seen
            seen = n
    ids = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], names=["id", "n"])


def _write(ids: np.ndarray, bits: np.ndarray):
    order, values = canonical(ids, bits)
    size = int(ids.max(initial=0)) + 1
    code, width = np.zeros(size, np.int64), np.zeros(size, np.int64)
    code[ids[order]], width[ids[order]] = values, bits[order]

    def block(part, number, start, docs, rows):
        stream = np.concatenate(rows)
        payload, at = pack_bits(code[stream], width[stream])
        fields = [part, number, start, len(stream), docs, [len(x) for x in rows], at[::STRIDE].tolist(), payload]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(fields, kinds, strict=True)], names=["part", "block", "start", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "payload"])

    def run(batches):
        part, number, start, held, docs, rows = None, 0, 0, 0, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for p, doc, ids_of in zip(some.column("part").to_pylist(), some.column("doc_id").to_pylist(), _unpacked(some), strict=True):
                    if rows and (p != part or held >= BLOCK_IDS):
                        yield block(part, number, start, docs, rows)
                        number, start, held, docs, rows = number + 1, start + held, 0, [], []
                    if p != part:
                        part, number, start = p, 0, 0
                    docs.append(doc)
                    rows.append(ids_of)
                    held += len(ids_of)
        if rows:
            yield block(part, number, start, docs, rows)

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Writes the ids of all texts, each closed by ``end_id``, into ``folder``."""
    spark = docs.sparkSession
    path = tokenizer or wordtokens.default_path()
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, missing = source.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    of_nulls = parts * missing // max(1, total)
    rest = max(1, parts - of_nulls)
    # a doc_id that stands between several parts is a bound several times
    bounds = np.array(source.approxQuantile("doc_id", [k / rest for k in range(1, rest)], 0.1 / rest), np.int64)
    dealt = source.mapInArrow(_encode(path, end_id, bounds, of_nulls), "part int, doc_id long, width byte, ids binary")
    rows = staged(dealt, "ids")
    counts = rows.select("width", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    bits = code_lengths(n)
    book = pa.table({"id": ids, "bits": bits})
    spark.createDataFrame(book.to_pandas(), "id long, bits long").coalesce(1).write.parquet(f"{folder}/codebook")
    # the only shuffle: by now the codes are known, and each part is coded in order as it is written
    ordered = rows.repartitionById(of_nulls + len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id")
    ordered.mapInArrow(_write(ids, bits), _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, ids (unsigned, 32 bits, little-endian)."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    key = np.stack([book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)]).tobytes()
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    totals = dict(blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    base, before = {}, 0
    for part in sorted(totals):
        base[part], before = before, before + totals[part]

    def run(batches):
        symbol, width = _tables(key)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["payload"], np.array(row["checkpoints"], np.int64), row["n_ids"], symbol, width)
                n = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                each = [raw[4 * (b - k) : 4 * b] for k, b in zip(n.tolist(), ends.tolist(), strict=True)]
                start = base[row["part"]] + row["start"] + ends - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op4_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: writes all documents' ids and reads the files back."""
    folder = new_path(spark, "huffman")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
