"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Words enter with a word part and a character part: evidence ratios and trained vectors of the
word and of its byte 3- to 5-grams, all in hashed tables. Every text is read in overlapping
windows that cover it whole; a window's states are pooled by attention, and the text has its
most toxic window's score. The network is trained in numpy on the driver from a bounded
labelled sample: windows of toxic texts that look worst, and both bad-looking and arbitrary
windows of clean ones. Inputs of a word are worked out once per distinct word of a chunk.

A null text, an empty one and one of white space have the sample's share of toxic texts. Rows without a
doc_id are scored and not held out; repeated rows get equal scores. Without labels of both
kinds the score is the only label's, or 0 without any. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import textbytes
from tapeline.llm.learning import fold, labelled_sample
from tapeline.llm.minhash import shingle_sets
from tapeline.llm.storage import small_batches

#: Labelled rows that the network is trained on, at most.
SAMPLE = 4000
WIDTH, STRIDE, HIDDEN = 32, 24, 8
#: Places of trained vectors of words and n-grams, and of the n-grams' evidence; the words' evidence is by whole hash.
WORDS, GRAMS, RATIOS = 1 << 16, 1 << 17, 1 << 19
TRAINED = 3
INPUTS = 3 + 2 * TRAINED
#: Steps of training to go for; the sample is gone over 3 to 10 times.
STEPS, BATCH, RATE = 300, 128, 0.02
#: Documents that must hold a word or n-gram before its evidence counts.
LEAST = 4

_EDGE = np.zeros(256, bool)
_EDGE[33:48] = _EDGE[58:65] = _EDGE[91:97] = _EDGE[123:127] = True


def _grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all n-grams of the words, and the word of each; a word has a mark at either end."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    marked = np.full(int(size.sum()) + 5, 1, np.uint64)
    inner = np.ones(len(marked) - 5, bool)
    inner[first] = False
    inner[first + size - 1] = False
    marked[:-5][inner] = low[textbytes.ragged(starts, ends - starts)]
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(first + size, size) - np.arange(len(word))
    h, places, words = np.zeros(len(word), np.uint64), [], []
    for n in range(1, 6):
        h = h * np.uint64(0x100000001B3) + marked[n - 1 : n - 1 + len(word)] + np.uint64(1)
        if n >= 3:
            fits = left >= n
            places.append((textbytes.mix(h[fits] + np.uint64(n)) >> np.uint64(45)).astype(np.int32))
            words.append(word[fits].astype(np.int32))
    place, of = np.concatenate(places), np.concatenate(words)
    order = np.argsort(of, kind="stable")
    return place[order], of[order]


class Chunk:
    """The words of some texts: the distinct ones with their table places, and each text's sequence."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        low = textbytes.LOWER[data]
        starts, ends, self.first = textbytes.words(low, at)
        for _ in range(3):
            strip = (ends - starts > 1) & _EDGE[low[starts]]
            starts = starts + strip
            strip = (ends - starts > 1) & _EDGE[low[ends - 1]]
            ends = ends - strip
        h = textbytes.span_hash(low, starts, ends)
        one, self.word = textbytes.distinct(h)
        self.count = len(one)
        self.hash = h[one]
        self.place = (textbytes.mix(h[one]) >> np.uint64(48)).astype(np.int64)
        self._text, self._starts, self._ends = low, starts[one], ends[one]

    def blocks(self):
        """Yields (first word, end word, places of n-grams, word of each from the first on), some words at a time."""
        for a in range(0, self.count, 1 << 14):
            b = min(self.count, a + (1 << 14))
            yield a, b, *_grams(self._text, self._starts[a:b], self._ends[a:b])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and text of each window; windows cover their text."""
        n = np.diff(self.first)
        each = np.where(n > WIDTH, -(-(n - WIDTH) // STRIDE) + 1, (n > 0).astype(np.int64))
        row = np.repeat(np.arange(len(n)), each)
        k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        shift = np.minimum(k * STRIDE, np.maximum(n[row] - WIDTH, 0))
        return self.first[row] + shift, np.minimum(n[row], WIDTH), row


def chunks_of(column: pa.Array):
    """Yields (first row, end row, words of these rows)."""
    data, at = textbytes.flat(column)
    for i, j in textbytes.chunks(at, 1 << 21):
        yield i, j, Chunk(data[at[i] : at[j]], at[i : j + 1] - at[i])


def _tanh_half(x: np.ndarray) -> np.ndarray:
    """Logistic function, by the faster tangent."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Weights; two directions of W (inputs), U (state), b; attention a; output w, c."""

    def __init__(self, seed: int = 7):
        g, h = np.random.default_rng(seed), HIDDEN
        self.word_hash, self.word_ratio = np.zeros(0, np.uint64), np.zeros(1, np.float32)
        self.gram_ratio = np.zeros(RATIOS, np.float32)
        self.p = {"ew": np.zeros((WORDS, TRAINED)), "eg": np.zeros((GRAMS, TRAINED))}
        for d in "fb":
            self.p[f"W{d}"] = g.normal(0, 0.4, (INPUTS, 3 * h))
            self.p[f"U{d}"] = g.normal(0, 0.3, (h, 3 * h))
            self.p[f"b{d}"] = np.zeros(3 * h)
        self.p |= {"a": g.normal(0, 0.5, 2 * h), "w": g.normal(0, 0.5, 2 * h), "c": np.array([-1.0])}
        self.p["ew"] += g.normal(0, 0.01, self.p["ew"].shape)
        self.p["eg"] += g.normal(0, 0.01, self.p["eg"].shape)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.slope, self.shift, self.base = 1.0, 0.0, 0.0
        self.constant: float | None = None

    def inputs(self, c: Chunk) -> np.ndarray:
        """One row per distinct word."""
        x = np.zeros((c.count, INPUTS), np.float32)
        if not c.count:
            return x
        if len(self.word_hash):
            at = np.searchsorted(self.word_hash, c.hash)
            there = self.word_hash[np.minimum(at, len(self.word_hash) - 1)] == c.hash
            x[:, 0] = self.word_ratio[np.where(there, at, len(self.word_hash))]
        x[:, 3 : 3 + TRAINED] = self.p["ew"][c.place]
        for a, b, gram, of in c.blocks():
            n = np.bincount(of, minlength=b - a)
            some = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[some]
            ratio = self.gram_ratio[gram]
            x[a + some, 1] = np.add.reduceat(ratio, begin) / n[some]
            x[a + some, 2] = np.maximum.reduceat(ratio, begin)
            for k in range(TRAINED):
                x[a + some, 3 + TRAINED + k] = np.add.reduceat(self.p["eg"][gram >> 2, k], begin) / n[some]
        return x

    def _run(self, d: str, table: np.ndarray, at: np.ndarray, mask: np.ndarray | None, trace: list | None) -> np.ndarray:
        """States of one direction; ``table`` has the distinct words' W x + b, ``at`` is (steps, windows)."""
        h, u = HIDDEN, self.p[f"U{d}"]
        steps, n = at.shape
        out = np.empty((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = table[at[t]]
            v = state @ u
            gates = _tanh_half(x[:, : 2 * h] + v[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * v[:, 2 * h :])
            moved = new + z * (state - new)
            if mask is not None:
                moved = np.where(mask[t][:, None], moved, state)
            if trace is not None:
                trace.append((t, state, z, r, new, v[:, 2 * h :]))
            out[t] = state = moved
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        traces = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._run(d, x @ self.p[f"W{d}"] + self.p[f"b{d}"], at, mask, traces[d]) for d in "fb"], 2)
        e = states @ self.p["a"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        alpha = np.exp(e - e.max(0))
        alpha /= alpha.sum(0)
        pooled = np.einsum("tb,tbh->bh", alpha, states)
        if keep is not None:
            keep |= {"states": states, "alpha": alpha, "pooled": pooled, "traces": traces}
        return pooled @ self.p["w"] + self.p["c"][0]

    def gradients(self, c: Chunk, x: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted logistic loss by back-propagation through time."""
        met, at = np.unique(at, return_inverse=True)  # the words of these windows only
        at, x = at.reshape(mask.shape), x[met]
        keep: dict = {}
        logit = self.forward(x, at, mask, keep)
        dl = ((1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()).astype(np.float32)
        states, alpha, pooled, h = keep["states"], keep["alpha"], keep["pooled"], HIDDEN
        out = {"w": pooled.T @ dl, "c": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * self.p["w"]
        de = alpha * (np.einsum("tbh,bh->tb", states, dpool) - (pooled * dpool).sum(1))
        ds = alpha[:, :, None] * dpool + de[:, :, None] * self.p["a"]
        out["a"] = np.einsum("tb,tbh->h", de, states)
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            w, u = self.p[f"W{d}"], self.p[f"U{d}"]
            dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * h, np.float32)
            back = np.zeros((at.shape[1], h), np.float32)
            for t, before, z, r, new, vn in reversed(keep["traces"][d]):
                dh = ds[t][:, k * h : (k + 1) * h] + back
                live = mask[t][:, None]
                active = dh * live
                dnew = active * (1 - z) * (1 - new**2)
                dz = active * (before - new) * z * (1 - z)
                dr = dnew * vn * r * (1 - r)
                g = np.concatenate([dz, dr, dnew], 1)
                gu = np.concatenate([dz, dr, dnew * r], 1)
                words = x[at[t]]
                dw += words.T @ g
                du += before.T @ gu
                db += g.sum(0)
                back = gu @ u.T + active * z + dh * ~live
                step = g @ w.T
                for q in range(INPUTS):
                    dx[:, q] += np.bincount(at[t], step[:, q], len(dx)).astype(np.float32) if q >= 3 else 0
            out[f"W{d}"], out[f"U{d}"], out[f"b{d}"] = dw, du, db
        out["ew"], out["eg"] = np.zeros_like(self.p["ew"]), np.zeros_like(self.p["eg"])
        gram, of = _grams(c._text, c._starts[met], c._ends[met])
        part = dx / np.maximum(np.bincount(of, minlength=len(met)), 1)[:, None]
        for k in range(TRAINED):
            out["ew"][:, k] = np.bincount(c.place[met], dx[:, 3 + k], WORDS)
            out["eg"][:, k] = np.bincount(gram >> 2, part[of, 3 + TRAINED + k], GRAMS)
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logit.astype(np.float64) + self.shift)))

    def window_logits(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Logit and text of every window of a chunk."""
        start, size, row = c.windows()
        logit = np.zeros(len(start), np.float32)
        x = self.inputs(c)
        for whole in (True, False):
            which = np.flatnonzero((size == WIDTH) == whole)
            which = which[np.argsort(size[which], kind="stable")]
            for a in range(0, len(which), 2048):
                some = which[a : a + 2048]
                steps = int(size[some].max())
                at = start[some] + np.arange(steps)[:, None]
                mask = None if whole else np.arange(steps)[:, None] < size[some]
                logit[some] = self.forward(x, c.word[np.minimum(at, len(c.word) - 1)], mask)
        return logit, row

    def score(self, column: pa.Array) -> np.ndarray:
        """Toxicity of each text: its worst window's."""
        out = np.full(len(column), self.constant if self.constant is not None else 0.0)
        if self.constant is not None:
            return out
        for i, j, c in chunks_of(column):
            logit, row = self.window_logits(c)
            worst = np.full(j - i, -np.inf)
            np.maximum.at(worst, row, logit)
            some = np.isfinite(worst)
            out[i:j] = self.base
            out[i:j][some] = self.probability(worst[some])
        return out


def _evidence(count: np.ndarray, toxic: np.ndarray, texts: int, bad: int) -> np.ndarray:
    """Log ratio of how often toxic and clean texts hold something, drawn to 0 for what few hold."""
    clean = count - toxic
    ratio = np.log((toxic + 0.5) / (bad + 1)) - np.log((clean + 0.5) / (texts - bad + 1))
    ratio *= count / (count + 4)
    return np.where(count >= LEAST, np.clip(ratio, -3, 4), 0).astype(np.float32)


def _once(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order, by sorting, which is faster here than numpy's hashing."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _tally(seen: tuple[np.ndarray, np.ndarray], keys: np.ndarray, size: int, y: np.ndarray) -> None:
    """Adds the texts, and the toxic ones, of (text, place) keys to the counts by place."""
    seen[0][:] += np.bincount(keys % size, minlength=size)
    seen[1][:] += np.bincount(keys % size, y[keys // size], size)


def train(column: pa.Array, y: np.ndarray, seed: int = 7) -> Network:
    """A network from texts and their labels."""
    net, g = Network(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        net.constant = float(y[0]) if len(y) else 0.0
        return net
    parts = list(chunks_of(column))
    # near copies of one text are no evidence for its rare words: of those that share their least shingle one counts
    least = np.array([int(x[0]) if len(x) else 0 for x in shingle_sets(column)])
    first = np.zeros(len(y), bool)
    first[np.unique(least, return_index=True)[1]] = True
    seen, met = (np.zeros(RATIOS), np.zeros(RATIOS)), []
    for i, j, c in parts:
        row = np.repeat(np.arange(j - i), np.diff(c.first))
        pair = _once(row * max(c.count, 1) + c.word)
        word, text = pair % max(c.count, 1), pair // max(c.count, 1)
        word, text = word[first[i + text]], text[first[i + text]]
        order = np.argsort(word, kind="stable")
        word, text = word[order], text[order]
        met.append((c.hash[word], y[i + text]))
        held = []
        for a, b, gram, of in c.blocks():
            n = np.bincount(of, minlength=b - a)
            lo, hi = np.searchsorted(word, [a, b])
            w = word[lo:hi] - a
            places = gram[textbytes.ragged((np.cumsum(n) - n)[w], n[w])].astype(np.int64)
            held.append(_once(np.repeat(text[lo:hi], n[w]) * RATIOS + places))
        if held:  # a text whose words fall into several blocks counts once
            _tally(seen, _once(np.concatenate(held)), RATIOS, y[i:j])
    hashes, bad = (np.concatenate(x) for x in zip(*met, strict=True))
    one, which = textbytes.distinct(hashes)
    ratio = _evidence(np.bincount(which, minlength=len(one)), np.bincount(which, bad, len(one)), int(first.sum()), int(y[first].sum()))
    known = np.flatnonzero(ratio)
    known = known[np.argsort(hashes[one][known])]
    net.word_hash, net.word_ratio = hashes[one][known], np.append(ratio[known], np.float32(0))
    net.gram_ratio = _evidence(*seen, int(first.sum()), int(y[first].sum()))

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, net.base = 0, float(y.mean())
    for epoch in range(int(np.clip(STEPS * BATCH / (1.5 * len(y)), 3, 10))):
        for i, _, c in parts:
            start, size, row = c.windows()
            if not len(start):
                continue
            x = net.inputs(c)
            look = net.window_logits(c)[0] if epoch else np.array([x[c.word[s : s + k], :3].max() for s, k in zip(start.tolist(), size.tolist(), strict=True)])
            order = np.lexsort((-look, row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            worst = order[rank == 0]
            clean = y[i + row] == 0
            other = np.flatnonzero(clean & (g.random(len(row)) < 0.5 / max(1.0, len(row) / max(1, len(worst)))))
            pick = g.permutation(np.concatenate([worst, other]))
            for a in range(0, len(pick), BATCH):
                some = pick[a : a + BATCH]
                steps = int(size[some].max())
                at = np.minimum(start[some] + np.arange(steps)[:, None], len(c.word) - 1)
                mask = np.arange(steps)[:, None] < size[some]
                target = y[i + row[some]].astype(np.float32)
                grads = net.gradients(c, x, c.word[at], mask, target, np.ones(len(some), np.float32))
                step += 1
                for k, grad in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad**2 - v)
                    net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    logit, label = [], []
    for i, j, c in parts:
        values, row = net.window_logits(c)
        worst = np.full(j - i, -np.inf)
        np.maximum.at(worst, row, values)
        some = np.isfinite(worst)
        logit.append(worst[some])
        label.append(y[i:j][some])
    _calibrate(net, np.concatenate(logit), np.concatenate(label))
    return net


def _calibrate(net: Network, logit: np.ndarray, y: np.ndarray) -> None:
    """Fits slope and shift of the worst window's logit to the labels, with smoothed targets."""
    good, bad = (y == 0).sum(), (y == 1).sum()
    target = np.where(y == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        e, s = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(e * logit).sum() + 1e-3 * (a - 1), e.sum()])
        hess = np.array([[(s * logit**2).sum() + 1e-3, (s * logit).sum()], [(s * logit).sum(), s.sum() + 1e-3]])
        da, db = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - da, b - db
    if a > 0:
        net.slope, net.shift = float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, held_out: F.Column, sample: int = SAMPLE) -> Network:
    """A network from labelled documents outside the held-out fold, at most ``sample`` of them (see ``labelled_sample``)."""
    got = labelled_sample(docs, labels, "toxic", held_out, sample).select("doc_id", "label", "text").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    net = train(pa.array(got["text"], pa.string()), got["label"].to_numpy(np.float64))
    del got
    textbytes.tidy()
    return net


def kept(docs: DataFrame, net: Network, most: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``most``, unchanged."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(net.score(batch.column("text")) < most))
        textbytes.tidy()

    return small_batches(docs).mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: toxicity score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    net = fit(docs, labels, held_out)
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(batch.column(1)))], names=["doc_id", "score"])
        textbytes.tidy()

    return source.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
