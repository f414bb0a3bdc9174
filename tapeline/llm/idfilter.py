"""A Bloom filter of fixed size over long ids, to thin a table before it is shuffled for a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.textbytes import mix

#: Size of the filter; 2 MB whatever the number of ids. A full filter only lets more rows pass.
BITS = 1 << 24
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


def _places(ids: np.ndarray) -> list[np.ndarray]:
    h = ids.astype(np.int64).view(np.uint64)
    return [(mix(h ^ s) & np.uint64(BITS - 1)).astype(np.int64) for s in _SALTS]


def build(ids: DataFrame) -> np.ndarray:
    """Filter over the first (long) column of ``ids``, as an array of 64-bit words."""
    name = ids.columns[0]

    def fill(batches):
        bits = np.zeros(BITS, bool)
        for batch in batches:
            for at in _places(batch.column(0).drop_null().to_numpy()):
                bits[at] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    rows = ids.select(F.col(name).cast("long").alias("id")).mapInArrow(fill, "at long, bits long")
    merged = rows.groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[merged["at"].to_numpy(np.int64)] = merged["bits"].to_numpy(np.int64)
    return out


def may_contain(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False only for ids that are not in the filter."""
    out = np.ones(len(ids), bool)
    for at in _places(ids):
        out &= (words[at >> 6] >> (at & 63) & 1).astype(bool)
    return out
