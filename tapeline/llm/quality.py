"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics come from a text alone: shares of kinds of bytes in the whole and in its most
conspicuous lines, word lengths, repetition of words and lines. Trees are grown on the driver
from a bounded labelled sample and flattened into arrays, which workers traverse for all rows
and trees at once.

A null text is an empty one and gets a score like any other; rows without a doc_id are scored
and not held out. Repeated rows get equal scores. Without labels of both kinds the score is
the only label's, or 1 without any. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import textbytes
from tapeline.llm.learning import fold, labelled_sample
from tapeline.llm.storage import small_batches

#: Labelled rows that trees are grown from, at most.
SAMPLE = 8000
BINS, DEPTH, TREES, RATE, LEAST_LEAF = 48, 4, 60, 0.2, 4

_KINDS = 18
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
for _k, _text in enumerate((" \t", "\n\r", ".", ",", "!", "|", "#", "$", "%", "&", "*", ";:?'\"-()"), 4):
    _KIND[list(_text.encode())] = _k
_KIND[[b for b in b"/+<>=@[]\\^_`{}~"]] = 16
_KIND[128:] = 17
_SIGNS = [8, 9, 10, 11, 12, 13, 14, 16]


def _by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, values, n)


def _most(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, row, values)
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """One row of float32 statistics per text."""
    data, offsets = textbytes.flat(column)
    out = []
    for i, j in textbytes.chunks(offsets, 1 << 21):
        out.append(_statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
    return np.concatenate(out) if out else np.zeros((0, 1), np.float32)


def _statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, size = len(at) - 1, np.diff(at)
    cuts = np.unique(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1, at[-1:]]))
    line_size = np.diff(cuts)
    lines = len(line_size)
    line_row = np.searchsorted(at, cuts[:-1], "right") - 1
    total, shares = np.zeros((n, _KINDS)), np.zeros((4, lines))
    for a in range(0, lines, 4096):  # whole lines, so that the keys of a block are few; their counts are not kept, as lines may be empty
        b = min(lines, a + 4096)
        kind = np.zeros((b - a, _KINDS))
        for c in range(cuts[a], cuts[b], 1 << 20):  # lines may be long, too
            d = min(cuts[b], c + (1 << 20))
            line = np.searchsorted(cuts, np.arange(c, d), "right") - 1 - a if b - a > 1 else np.zeros(d - c, np.int64)
            kind += np.bincount(line * _KINDS + _KIND[data[c:d]], minlength=(b - a) * _KINDS).reshape(-1, _KINDS)
        first = line_row[a]
        rows = line_row[a:b] - first
        for k in range(_KINDS):
            total[first : first + rows[-1] + 1, k] += np.bincount(rows, kind[:, k])
        share = kind / np.maximum(line_size[a:b], 1)[:, None]
        shares[:, a:b] = share[:, _SIGNS].sum(1), share[:, 2], share[:, 9], share[:, 3]
    share = total / np.maximum(size, 1)[:, None]

    long = line_size >= 24
    marks = [_most(x * long, line_row, n) for x in shares]
    loud = [_by_row(line_size * (x > t), line_row, n) / np.maximum(size, 1) for x, t in zip(shares, (0.04, 0.4, 0.02, 0.2), strict=True)]
    del shares
    line_hash = textbytes.span_hash(data, cuts[:-1], cuts[1:]) ^ textbytes.mix(line_row.astype(np.uint64))
    once, _ = textbytes.distinct(line_hash)
    repeated = 1 - _by_row(line_size[once], line_row[once], n) / np.maximum(size, 1)

    starts, ends, first = textbytes.words(data, at)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    mean = _by_row(length, row, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(_by_row(length**2, row, n) / np.maximum(words, 1) - mean**2, 0))
    h = textbytes.span_hash(data, starts, ends)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    run = _by_row(same, row, n) / np.maximum(words, 1)
    one, which = textbytes.distinct(h ^ textbytes.mix(row.astype(np.uint64)))
    often = np.bincount(which, minlength=len(one))
    kinds_of_word = _by_row(np.ones(len(one)), row[one], n) / np.maximum(words, 1)
    top = _most(often.astype(float), row[one], n) / np.maximum(words, 1)
    lines_of = np.bincount(line_row, minlength=n)
    return np.column_stack(
        [share, *marks, *loud, repeated, np.log1p(size), np.log1p(words), np.log1p(lines_of), size / np.maximum(lines_of, 1), mean, spread, _most(length, row, n), run, kinds_of_word, top]
    ).astype(np.float32)


class Trees:
    """Complete binary trees of one depth: per tree and inner node a statistic and a bound, per leaf a value."""

    def __init__(self, base: float, feature: np.ndarray, bound: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.bound, self.leaf = base, feature, bound, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of statistics."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.bound[trees, node])
            out[a : a + 4096] += self.leaf[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees for the logistic loss."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        none.base = 40.0 if not len(y) or y[0] else -40.0
        return none
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    features, bounds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            at, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - at) * BINS + binned[:, f]
                g, h, k = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (grad, curve, None))
                gl, hl, kl = g[:, :-1], h[:, :-1], k[:, :-1]
                gr, hr, kr = g[:, -1:] - gl, h[:, -1:] - hl, k[:, -1:] - kl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(kl < LEAST_LEAF) | (kr < LEAST_LEAF)] = 0
                cut = gain[:, : len(c)].argmax(1)
                top = gain[np.arange(width), cut]
                better = top > best
                best[better] = top[better]
                feature[at : at + width][better] = f
                bound[at : at + width][better] = c[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > bound[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, curve, leaves) + 1)
        margin += value[leaf]
        features.append(feature), bounds.append(bound), values.append(value)
    return Trees(base, np.stack(features), np.stack(bounds), np.stack(values))


def fit(docs: DataFrame, labels: DataFrame, held_out: F.Column, sample: int = SAMPLE) -> Trees:
    """Trees from labelled documents outside the held-out fold, at most ``sample`` of them (see ``labelled_sample``)."""
    rows = labelled_sample(small_batches(docs), labels, "quality", held_out, sample)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    got = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x array<float>").toPandas()
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), -1) if len(got) else np.zeros((0, 1), np.float32)
    y = got["label"].to_numpy(np.float64)
    # rows arrive in any order; a fixed one makes the trees the same every time
    order = np.argsort(got["doc_id"].to_numpy(np.int64), kind="stable") if len(got) else np.zeros(0, np.int64)
    return grow(x[order], y[order])


def kept(docs: DataFrame, trees: Trees, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, unchanged."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(trees.score(statistics(batch.column("text"))) >= least))
        textbytes.tidy()

    return small_batches(docs).mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: quality score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    trees = fit(docs, labels, held_out)
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            score = trees.score(statistics(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return source.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
