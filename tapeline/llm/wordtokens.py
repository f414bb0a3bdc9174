"""Token ids of whole texts by a public BPE tokenizer that drops white space.

Such a tokenizer never joins what ASCII white space separates, nor letters with digits or
signs, and it lowers letters first. So words are cut where these kinds meet, the library
encodes each distinct run of a chunk once, and the ids are gathered back per text. Words with an
apostrophe (contractions), an angle bracket (special tokens) or characters beyond Latin-1's
letters are left whole, as they are.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tapeline.llm import textbytes

#: Runs whose ids a worker keeps between chunks (about 30 bytes each); beyond it they are encoded again.
KEPT = 1_500_000
#: Longer runs aren't kept.
SHORT = 64


def default_path() -> str:
    """The word tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """The library's tokenizer, and the ids of runs met before in flat arrays, sorted by the runs' hashes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.hash, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct runs (in the order of their hashes): a flat array, and where each run's begin and how many they are."""
        at = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        short = (ends - starts)[new] <= SHORT
        new, kept = np.concatenate([new[short], new[~short]]), int(short.sum())
        begin, length = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begin[known], length[known] = self.begin[at[known]], self.length[at[known]]
        found = []
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            texts = [x.decode("utf-8", "replace") for x in textbytes.pieces(data, starts[some], ends[some])]
            found += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not found:
            return self.ids, begin, length
        length[new] = np.fromiter(map(len, found), np.int64, len(found))
        begin[new] = len(self.ids) + np.cumsum(length[new]) - length[new]
        ids = np.concatenate([self.ids, *found])
        if len(self.hash) + kept <= KEPT:
            keep = new[:kept]
            place = np.searchsorted(self.hash, hashes[keep])
            self.hash = np.insert(self.hash, place, hashes[keep])
            self.begin = np.insert(self.begin, place, begin[keep])
            self.length = np.insert(self.length, place, length[keep])
            self.ids = ids[: len(self.ids) + int(length[keep].sum())]
        return ids, begin, length


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


_CLASS = np.full(256, 3, np.uint8)
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_WHOLE = np.zeros(256, bool)
_WHOLE[[39, 60]] = True
_WHOLE[192:] = True
_WHOLE[195] = False  # leads U+00C0 to U+00FF
_SIGN = np.zeros(256, bool)
_SIGN[[0x97, 0xB7]] = True  # there, the signs for multiplication and division


def _runs(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, run starts and ends, and the first run of each row."""
    starts, ends, _ = textbytes.words(part, offsets)
    if not len(starts):
        return part, starts, ends, np.zeros(len(offsets), np.int64)
    odd = _WHOLE[part]
    odd[1:] |= _SIGN[part[1:]] & (part[:-1] == 195)
    at = np.flatnonzero(odd)
    plain = np.searchsorted(at, starts) == np.searchsorted(at, ends)
    free = np.zeros(len(part), bool)
    inside = ~textbytes.SPACE[part]
    free[inside] = np.repeat(plain, ends - starts)
    kind = _CLASS[part]
    begin = np.zeros(len(part), bool)
    begin[1:] = (kind[1:] != kind[:-1]) & free[1:]
    begin[starts] = True
    cut = np.flatnonzero(begin)
    word = np.cumsum(np.bincount(np.searchsorted(cut, starts), minlength=len(cut))) - 1
    stop = np.minimum(np.append(cut[1:], len(part)), ends[word])
    return np.where(free, textbytes.LOWER[part], part), cut, stop, np.searchsorted(cut, offsets)


def encoded(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, ids, offsets of each row's ids); ``end_id`` closes every row."""
    encoder = _encoder(path)
    data, offsets = textbytes.flat(column)
    for i, j in textbytes.chunks(offsets, 1 << 22):
        part = data[offsets[i] : offsets[j]]
        part, starts, ends, first = _runs(part, offsets[i : j + 1] - offsets[i])
        hashes = textbytes.span_hash(part, starts, ends)
        one, which = textbytes.distinct(hashes)
        table, begin, length = encoder.runs(part, starts[one], ends[one], hashes[one])
        n = length[which]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        at = upto[first] + np.arange(j - i + 1)
        ids = np.empty(at[-1], "<u4")
        body = np.ones(len(ids), bool)
        body[at[1:] - 1] = False
        ids[body] = table[textbytes.ragged(begin[which], n)]
        ids[at[1:] - 1] = end_id
        yield i, j, ids, at
