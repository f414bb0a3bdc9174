"""Packing of token sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. Multiplicative weights price
the lengths, a knapsack dynamic program finds the configurations of most worth at these prices,
and every length that is in such a configuration gets one. Rounds on the whole histogram settle
the prices; the rounds that follow give each configuration a whole number of sequences, never
more than what is left of its lengths, and price what remains. Only the last remainder, where no
configuration of enough worth has all its pieces left, is packed best fit, longest first, and with it
the pieces of configurations that rounding left with more than 1 to 5 percent of room, if that saves
sequences. All of it works on the histogram of at most ``capacity`` lengths, so its cost does not
grow with the number of pieces.

Pieces are numbered within their length by a range sort, which splits lengths that many pieces
share; the plan then tells each piece's sequence and place from its length and number.

A null or empty text is the end id alone. Rows without a doc_id and repeated rows are packed
like any other. Other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import textbytes, wordtokens
from tapeline.llm.storage import small_batches, staged

CAPACITY = 2048
#: Rounds that settle prices, and rounds at most that place pieces.
PRICING, PLACING = 60, 150
#: Share of a length's pieces that one round may place, how far that lowers its weight, and how near to the best worth is enough.
SHARE, RATE, NEAR = 0.5, 0.03, 0.03
#: Shares of a sequence's room beyond which rounding is tried again on its pieces.
LOOSE = (1.0, 0.05, 0.03, 0.02, 0.01)

Group = tuple[int, list[tuple[int, int]]]  # so many sequences, each of (length, count)


def best_fit(counts: np.ndarray, capacity: int) -> list[Group]:
    """Best fit decreasing on a histogram; ``counts[l]`` pieces have length l."""
    at: dict[int, list[list]] = {}
    free = np.zeros(capacity + 1, np.int64)  # groups by what is left in each of their sequences

    def put(bins: int, pattern: list, left: int) -> None:
        if bins:
            at.setdefault(left, []).append([bins, pattern])
            free[left] += 1

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(free[length:])
            left = int(fits[0]) + length if len(fits) else capacity
            if len(fits):
                bins, pattern = at[left].pop()
                free[left] -= 1
            else:
                bins, pattern = -(-n // (capacity // length)), []
            each = left // length
            full = min(bins, n // each)
            put(full, [*pattern, (length, each)], left - each * length)
            n -= full * each
            if full < bins:
                put(int(n > 0), [*pattern, (length, n)], left - n * length)
                put(bins - full - int(n > 0), pattern, left)
                n = 0
    return [(bins, pattern) for groups in at.values() for bins, pattern in groups if pattern]


def _knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each room: the most worth that fits it, a length to begin with, and the room at which that one is taken (none: 0)."""
    best, taken, at = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.arange(capacity + 1)
    upto = np.searchsorted(lengths, at, "right")
    longest_first, worth_of = lengths[::-1].copy(), price[::-1].copy()
    for room in range(1, capacity + 1):
        skip = len(lengths) - upto[room]
        worth = best[room - longest_first[skip:]] + worth_of[skip:]
        i = int(worth.argmax()) if len(worth) else -1
        if i >= 0 and worth[i] > best[room - 1]:
            best[room], taken[room] = worth[i], longest_first[skip + i]
        else:
            best[room], at[room] = best[room - 1], at[room - 1]
    return best, taken, at


def _configuration(length: int, taken: np.ndarray, at: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration that holds ``length``: how many of each of its lengths."""
    used, room = {length: 1}, int(at[capacity - length])
    while piece := int(taken[room]):
        used[piece] = used.get(piece, 0) + 1
        room = int(at[room - piece])
    return used


def configurations(counts: np.ndarray, capacity: int) -> tuple[dict[tuple, int], np.ndarray, float]:
    """Configurations with their numbers of sequences, the counts that are left, and a bound below all packings.

    The bound is the program's dual value: any prices at which no configuration is worth more
    than 1 are worth no more in all than the sequences that are needed.
    """
    lengths = np.flatnonzero(counts)
    need, left = counts[lengths], counts[lengths].copy()
    log_weight, use, bound = np.zeros(len(lengths)), {}, 0.0
    for turn in range(PRICING + PLACING):
        placing = turn >= PRICING
        stock = left if placing else need
        some = np.flatnonzero(stock)
        if not len(some):
            break
        here = lengths[some]
        price = here * np.exp(log_weight[some] - log_weight[some].max())
        best, taken, at = _knapsack(price, here, capacity)
        if not placing:
            bound = max(bound, float((need[some] * price).sum() / best[capacity]))
        allowed = np.zeros(capacity + 1)
        allowed[lengths] = np.ceil(stock * SHARE) if placing else stock * SHARE
        before, placed = allowed[lengths], 0
        worth = price + best[capacity - here]
        for length in here[worth >= (1 - NEAR) * best[capacity]][::-1].tolist():
            if allowed[length] <= 0:
                continue
            config = _configuration(length, taken, at, capacity)
            bins = min(allowed[x] / k for x, k in config.items())
            bins = int(bins) if placing else bins
            if bins > 0:
                for x, k in config.items():
                    allowed[x] -= bins * k
                if placing:
                    key = tuple(sorted(config.items(), reverse=True))
                    use[key] = use.get(key, 0) + bins
                    placed += bins
        done = before - allowed[lengths]
        log_weight -= RATE * done / np.maximum(before, 1e-9) * (0.5 if placing else 1)
        if placing:
            left = left - done.astype(np.int64)
            if not placed:
                break
    rest = np.zeros(capacity + 1, np.int64)
    rest[lengths] = left
    return use, rest, bound


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Groups of equal sequences that hold exactly ``counts``."""
    inner = counts.copy()
    inner[capacity] = 0  # these fill their sequences alone
    use, rest, _ = configurations(inner, capacity)
    whole = [(int(counts[capacity]), [(capacity, 1)])] if counts[capacity] else []
    placed = [(bins, list(config)) for config, bins in use.items()]
    return whole + min((_remade(placed, rest, capacity, room) for room in LOOSE), key=lambda g: sum(bins for bins, _ in g))


def _remade(groups: list[Group], rest: np.ndarray, capacity: int, room: float) -> list[Group]:
    """The groups with at most this share of room; the remainder and the pieces of the others packed best fit."""
    rest, kept = rest.copy(), []
    for bins, config in groups:
        if capacity - sum(x * k for x, k in config) <= room * capacity:
            kept.append((bins, config))
        else:
            for x, k in config:
                rest[x] += bins * k
    return kept + best_fit(rest, capacity)


def _places(groups: list[Group], capacity: int) -> tuple[np.ndarray, ...]:
    """Rows (length and first number as one key, pieces a sequence, first sequence, offset), sorted."""
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for bins, pattern in groups:
        offset = 0
        for length, k in pattern:
            rows.append((length << 44 | int(used[length]), k, sequence, offset))
            used[length] += bins * k
            offset += length * k
        sequence += bins
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        for batch in batches:
            doc = batch.column(0)
            for i, j, ids, at in wordtokens.encoded(batch.column(1), path, end_id):
                n = np.diff(at)
                parts = -(-n // capacity)
                row = np.repeat(np.arange(j - i), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                raw = memoryview(ids).cast("B")
                begin = (at[row] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        textbytes.tidy()

    return run


def _numbered(capacity: int):
    """Adds each piece's number among the pieces of its length in this partition."""

    def run(batches):
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            values, first, n = np.unique(ordered, return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(seen[values], n)
            seen[values] += n
            yield batch.append_column("rank", pa.array(rank))

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or wordtokens.default_path()
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a number of its own for each piece: repeated rows may make up many of one length, and are split too
    pieces = staged(source.mapInArrow(_cut(path, end_id, capacity), _PIECES).withColumn("own", F.monotonically_increasing_id()), "pieces")
    order = ["length", "doc_id", "piece", "own"]
    spread = pieces.repartitionByRange(*order).sortWithinPartitions(*order).drop("own").withColumn("part", F.spark_partition_id())
    ranked = staged(spread.mapInArrow(_numbered(capacity), _PIECES + ", part int, rank long"), "ranked")
    # parts hold ranges of lengths, so this has about as many rows as lengths and partitions
    shares = sorted((r["length"], r["part"], r["n"]) for r in ranked.groupBy("length", "part").agg(F.count("*").alias("n")).collect())
    counts, before = np.zeros(capacity + 1, np.int64), {}
    for length, part, n in shares:
        before[part, length] = int(counts[length])
        counts[length] += n
    key, each, sequence, offset = _places(plan(counts, capacity), capacity)

    def place(batches):
        for batch in batches:
            length, part, rank = (batch.column(x).to_numpy() for x in ("length", "part", "rank"))
            pairs, which = np.unique(length << 32 | part, return_inverse=True)
            base = np.array([before[int(x & 0xFFFFFFFF), int(x >> 32)] for x in pairs], np.int64)
            number = rank + base[which] if len(pairs) else rank
            at = np.searchsorted(key, length << 44 | number, "right") - 1
            beyond = number - (key[at] & (1 << 44) - 1)
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            out = out.append_column("sequence_id", pa.array(sequence[at] + beyond // each[at]))
            yield out.append_column("offset", pa.array(offset[at] + beyond % each[at] * length))

    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents into sequences of at most 2048 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
