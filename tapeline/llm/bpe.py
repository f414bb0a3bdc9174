"""Byte-level BPE as a streaming transducer with a bounded lookahead.

Merges are applied lowest rank first, leftmost first. Whether a token's end is final depends on
merges across it, and such a merge can only be prevented by merges of lower rank further right.
Following these chains through the merge list gives a number of bytes, the lookahead, beyond
which nothing moves a boundary: a run of bytes is encoded piece by piece, tokens that end that
far before the end of what has been read are emitted, and the rest is kept. Memory is constant
in the length of the run. Decoding feeds the tokens' bytes to an incremental UTF-8 machine.

A null text is empty. Rows without a doc_id and repeated rows are encoded like any other. Other
columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import textbytes
from tapeline.llm.storage import small_batches

#: The public pre-tokenization pattern of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes read at once beyond the lookahead, and runs whose ids a worker keeps.
STEP = 1024
KEPT = 250_000
SHORT = 48


def default_path() -> str:
    """The byte tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Model:
    """Vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for text, i in vocabulary.items():
            self.token[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        for text, i in self.special.items():
            self.token[i] = text.encode()
        by_text = {letters[t]: i for t, i in vocabulary.items() if len(t) == 1 and t in letters}
        self.byte = [by_text[b] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, tuple[int, int]] = {}
        order = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.merge[a, b] = rank, c
            made.setdefault(c, (rank, b))
            order.append((a, b, rank))
        self.lookahead = self._lookahead(order, made)
        splits = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.split_special = regex.compile(f"({'|'.join(splits)})") if splits else None
        self.pattern = regex.compile(PATTERN)

    def _lookahead(self, order: list[tuple[int, int, int]], made: dict[int, tuple[int, int]]) -> int:
        """Bytes after a token's end that can still bear on whether that end stands.

        The reach of a merge (p, z) is the length of z and the farthest reach of a lower-ranked
        merge that starts with z, or with a right end of z before that end had become z.
        """
        ranks: dict[int, list[int]] = {}
        reach: dict[int, list[int]] = {}
        most = 0

        def farthest(left: int, below: int) -> int:
            k = bisect.bisect_left(ranks.get(left, ()), below)
            return reach[left][k - 1] if k else 0

        for p, z, rank in order:
            beyond, end, below = 0, z, rank
            while True:
                beyond = max(beyond, farthest(end, below))
                if end not in made:
                    break
                below, end = made[end]
            r = len(self.token[z]) + beyond
            ranks.setdefault(p, []).append(rank)
            reach.setdefault(p, []).append(max(r, reach[p][-1] if p in reach and reach[p] else 0))
            most = max(most, r)
        return most

    def merged(self, data: bytes) -> list[int]:
        """Ids of one run of bytes, all of it at hand."""
        if len(data) > 96:
            return self._merged_long(data)
        get, last = self.merge.get, (1 << 60, -1)
        parts = [self.byte[b] for b in data]
        ranks = [get(p, last) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least is last or least[1] < 0:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [least[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), last)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), last)
        return parts

    def _merged_long(self, data: bytes) -> list[int]:
        parts = [self.byte[b] for b in data]
        n = len(parts)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merge.get
        heap = [(m[0], i, parts[i], parts[i + 1], m[1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                prior[after[j]] = i
                if m := get((made, parts[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, parts[after[i]], m[1]))
            if (h := prior[i]) >= 0 and (m := get((parts[h], made))):
                heapq.heappush(heap, (m[0], h, parts[h], made, m[1]))
        return [p for p in parts if p >= 0]

    def stream(self, run: Iterable[bytes]) -> Iterator[int]:
        """Ids of a run that arrives piece by piece, each as soon as it is final."""
        held = b""
        for piece in run:
            held += piece
            if len(held) < self.lookahead + STEP:
                continue
            sure, done = len(held) - self.lookahead, 0
            for i in self.merged(held):
                if done + len(self.token[i]) > sure:
                    break
                done += len(self.token[i])
                yield i
            held = held[done:]
        yield from self.merged(held)

    def run_ids(self, run: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        data = run.encode("utf-8", "replace")
        if len(data) <= self.lookahead + STEP:
            return np.array(self.merged(data), "<u4").tobytes()
        parts = (data[i : i + STEP] for i in range(0, len(data), STEP))
        return np.fromiter(self.stream(parts), "<u4").tobytes()

    def text_ids(self, text: str, kept: dict[str, bytes]) -> bytes:
        """Ids of a whole text; special tokens' strings stand for their ids."""
        if self.split_special is not None and any(s in text for s in self.special):
            return b"".join(
                self.special[x].to_bytes(4, "little") if x in self.special else self.text_ids(x, kept) for x in self.split_special.split(text) if x
            )
        return b"".join(map(kept.__getitem__, self.pattern.findall(text)))


class Kept(dict):
    """Ids of pre-tokens seen before; bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, run: str) -> bytes:
        ids = self.model.run_ids(run)
        if len(self) < KEPT and len(run) <= SHORT:
            self[run] = ids
        return ids


class Decoder:
    """Turns ids into text as they come; bytes of an unfinished character wait for the rest."""

    def __init__(self, model: Model):
        self.length = np.array([len(x) for x in model.token], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(model.token), np.uint8)
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        """Text that ``ids`` complete; with ``last``, unfinished bytes become replacement characters."""
        raw = self.bytes[textbytes.ragged(self.begin[ids], self.length[ids])].tobytes()
        text = self.machine.decode(raw, last)
        if last:
            self.machine.reset()
        return text


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Model, Kept, Decoder]:
    model = Model(path)
    return model, Kept(model), Decoder(model)


#: Ids that are decoded at once.
DECODE = 1 << 20


def _digests(path: str):
    def run(batches):
        model, kept, decoder = _loaded(path)
        for batch in batches:
            n, encoded, decoded = [], [], []
            for value in batch.column(1):
                raw = model.text_ids(value.as_py() or "", kept)
                ids = np.frombuffer(raw, "<u4")
                digest = hashlib.sha256()
                for at in range(0, max(1, len(ids)), DECODE):
                    digest.update(decoder.feed(ids[at : at + DECODE], at + DECODE >= len(ids)).encode())
                n.append(len(ids))
                encoded.append(hashlib.sha256(raw).hexdigest())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ids (unsigned, 32 bits, little-endian) of every whole text."""
    path = tokenizer or default_path()

    def run(batches):
        model, kept, _ = _loaded(path)
        for batch in batches:
            rows = [model.text_ids(x.as_py() or "", kept) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text of rows of ``encode``."""
    path = tokenizer or default_path()

    def run(batches):
        _, _, decoder = _loaded(path)
        for batch in batches:
            texts = [decoder.feed(np.frombuffer(x.as_py() or b"", "<u4"), True) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of every text's ids and of the text decoded from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_digests(default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
