"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Distinct unit vectors are projected onto random directions and sorted along each. For a vector
as a query, those within a window around its own projection collide with it; pairs are counted
over all directions, and only pairs with enough collisions are verified by cosine. Window and
count follow from the threshold: the difference of two projections is normal with the pair's
distance as deviation, so the collisions of a pair at the threshold are binomial, and the
count is the largest that such a pair misses with a chance of at most ``MISS``.

Windows are ranges of the sorted order, so the set of what a query meets is the difference of
two sets of a running union; 64 vectors are counted at once by adders over bit sets. Work goes
by pairs of blocks: a block pair returns each vector's number of links and a spanning forest,
never the pairs. Copies are one vector with a count.

Vectors that are null, empty or zero or hold nulls or non-finite numbers link with nothing, and
vectors of different lengths are not compared. A row without a vec_id counts as a link of
others; its own component is the smallest id it reaches, or null, and it is kept. Rows of one
vec_id are vectors of their own. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.graph import components
from tapeline.llm.storage import staged
from tapeline.llm.vectors import matrix, unit, usable

DIRECTIONS = 63
#: Half a window, in distances of a pair at the threshold; and the chance that such a pair is missed.
WINDOW, MISS = 1.1, 1e-6
#: Cells of half a window, and of all projections.
HALF, CELLS = 128, 4096
#: Vectors that are counted against each other at once, and a block's least and largest number of them.
TILE, LEAST_BLOCK, LARGEST_BLOCK = 1024, 4096, 65536
#: Tasks that pairs of blocks are dealt to, at most.
TASKS = 1 << 14


def collision_bound(directions: int = DIRECTIONS) -> int:
    """The largest count that a pair at the threshold reaches with a chance of at least 1 - MISS."""
    p, below = math.erf(WINDOW / math.sqrt(2)), 0.0
    for count in range(directions + 1):
        below += math.comb(directions, count) * p**count * (1 - p) ** (directions - count)
        if below > MISS:
            return count
    return directions


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim, DIRECTIONS)).astype(np.float32)


def _cells(units: np.ndarray, threshold: float) -> np.ndarray:
    """Each direction's projections, as numbers of cells of which HALF make half a window."""
    half = WINDOW * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    cells = np.floor((units.astype(np.float32) @ _directions(units.shape[1])) * np.float32(HALF / half))
    # what lies beyond the last cell is moved nearer to the rest, which loses no collision
    return np.clip(cells.T + CELLS // 2, HALF, CELLS - HALF - 1).astype(np.int16).copy()


def _running(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per direction how many points lie before each cell, and for each rank in sorted order the set of all before it as bits."""
    n = cells.shape[1]
    order = np.argsort(cells, 1, kind="stable")
    bits = np.zeros((DIRECTIONS, n + 1, -(-n // 64)), np.uint64)
    bits[np.arange(DIRECTIONS)[:, None], np.arange(1, n + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    np.bitwise_or.accumulate(bits, 1, out=bits)
    before = np.zeros((DIRECTIONS, CELLS + 1), np.int32)
    counts = np.bincount((cells + np.arange(DIRECTIONS)[:, None] * CELLS).ravel(), minlength=DIRECTIONS * CELLS)
    np.cumsum(counts.reshape(DIRECTIONS, CELLS), axis=1, out=before[:, 1:])
    return before, bits


def _enough(queries: np.ndarray, before: np.ndarray, bits: np.ndarray, least: int) -> np.ndarray:
    """Bit sets: for each query the points whose collisions with it number ``least`` or more."""
    planes: list[list[np.ndarray]] = [[] for _ in range(DIRECTIONS.bit_length() + 1)]
    for d in range(DIRECTIONS):
        lo, hi = before[d][queries[d] - HALF], before[d][queries[d] + (HALF + 1)]
        carry, level = bits[d][hi] ^ bits[d][lo], 0
        while True:
            planes[level].append(carry)
            if len(planes[level]) < 3:
                break
            x, y, z = planes[level]
            odd = x ^ y
            carry = (x & y) | (odd & z)
            planes[level] = [odd ^ z]
            level += 1
    total = []
    for level, plane in enumerate(planes):
        while len(plane) > 1:
            x, y = plane.pop(), plane.pop()
            plane.append(x ^ y)
            planes[level + 1].append(x & y)
        total.append(plane[0] if plane else None)
    blank = np.zeros((queries.shape[1], bits.shape[2]), np.uint64)
    more, equal = blank.copy(), ~blank
    for level in range(len(total) - 1, -1, -1):
        plane = blank if total[level] is None else total[level]
        if least >> level & 1:
            equal &= plane
        else:
            more |= equal & plane
            equal &= ~plane
    return more | equal


def _pairs_of(sets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    rows, words = np.nonzero(sets)
    inside = np.unpackbits(sets[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(inside)
    point = words[k] * 64 + bit
    real = point < n
    return rows[k][real], point[real]


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Yields arrays of rows of ``a`` and of ``b`` (unit rows) whose cosine reaches the threshold."""
    least = collision_bound()
    left_cells = _cells(a, threshold)
    right_cells = left_cells if same else _cells(b, threshold)
    for j in range(0, len(b), TILE):
        right = b[j : j + TILE]
        before, bits = _running(right_cells[:, j : j + TILE])
        for i in range(0, min(len(a), j + TILE) if same else len(a), TILE):
            left = a[i : i + TILE]
            x, y = _pairs_of(_enough(left_cells[:, i : i + TILE], before, bits, least), len(right))
            if same and i == j:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 200_000):
                p, q = x[k : k + 200_000], y[k : k + 200_000]
                near = np.einsum("ij,ij->i", left[p], right[q]) >= threshold
                if near.any():
                    yield i + p[near], j + q[near]


def _least_reached(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each of ``n`` points by the links x, y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _compare(threshold: float):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same = row["p"] == row["q"]
                a, b = (unit(np.frombuffer(row[f"v{s}"], np.float64 if row["wide"] else np.float32).reshape(-1, row["dim"])) for s in "pq")
                ids = [np.frombuffer(row[f"i{s}"], np.int64) for s in "pq"]
                copies = [np.frombuffer(row[f"n{s}"], np.int64) for s in "pq"]
                shift = 0 if same else len(a)
                links = np.zeros(len(a) + (0 if same else len(b)), np.int64)
                xs, ys = [], []
                for x, y in linked_pairs(a, b, threshold, same):
                    np.add.at(links, x, copies[1][y])
                    np.add.at(links, shift + y, copies[0][x])
                    # what is known to be connected needs no link of its own
                    label = _least_reached(len(links), x, shift + y)
                    some = np.flatnonzero(label != np.arange(len(label)))
                    xs.append(some)
                    ys.append(label[some])
                if not xs:
                    continue
                cid = ids[0] if same else np.concatenate(ids)
                root = _least_reached(len(links), np.concatenate(xs), np.concatenate(ys))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[root[some]])], names=["cid", "links", "root"])

    return run


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    order = np.argsort(table["cid"].to_numpy(), kind="stable")
    x = matrix(table["vector"], key[0].as_py())[order]
    fields = [[key[0].as_py()], [key[1].as_py()], [x.dtype == np.float64], [x.tobytes()], [table["cid"].to_numpy()[order].tobytes()], [table["copies"].to_numpy()[order].tobytes()]]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, t) for v, t in zip(fields, kinds, strict=True)], names=["dim", "block", "wide", "v", "i", "n"])


#: 128 bits that stand for a vector, so that rows find their class without sending it again; rows without one are dealt by id and meet none.
_PRINT = ["if(vector is null, xxhash64(vec_id), xxhash64(vector)) as print_a", "if(vector is null, null, xxhash64('b', vector)) as print_b"]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows are linked if their cosine is at least ``threshold`` (over 0.5); see the module.
    """
    if not 0.5 < threshold < 1:
        raise ValueError("windows are laid out for thresholds between 0.5 and 1")
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + F.lit(0).cast(kind[6:-1]))))  # no negative zeros
    classes = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")
    parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count()
    # every vector travels once per block: no more blocks than keep all cores busy and a block within its size
    busy = math.isqrt(4 * spark.sparkContext.defaultParallelism) + 1
    blocks = max(1, -(-total // LARGEST_BLOCK), min(-(-total // LEAST_BLOCK), busy))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks))).repartition(max(parts, blocks), "dim", "block")
    packed = staged(dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block long, wide boolean, v binary, i binary, n binary"), "blocks")
    first, last = F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")
    left = packed.select("dim", "wide", F.col("block").alias("p"), F.col("v").alias("vp"), F.col("i").alias("ip"), F.col("n").alias("np"), F.explode(F.sequence("block", last)).alias("q"))
    right = packed.select("dim", F.col("block").alias("q"), F.col("v").alias("vq"), F.col("i").alias("iq"), F.col("n").alias("nq"), F.explode(F.sequence(first, F.col("block"))).alias("p"))
    # dealt once: the join takes both sides as they lie
    tasks, keys = min(TASKS, max(parts, blocks * (blocks + 1))), ["dim", "p", "q"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)
    found = staged(met.mapInArrow(_compare(threshold), "cid long, links long, root long"), "vector-links")
    reached = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(links, "cid", "left").join(reached, F.col("cid") == F.col("node"), "left")
    named = named.withColumn("vec_id", F.col("rep")).select(*map(F.expr, _PRINT), "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("print_a", "print_b", "n_links", "component_id")
    out = rows.selectExpr("vec_id", *_PRINT).join(named, ["print_a", "print_b"], "left")
    owner = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), owner.alias("component_id"), F.coalesce(owner == F.col("vec_id"), F.lit(True)).alias("kept"))


def op3_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links at a cosine of 0.9 over all embeddings."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
