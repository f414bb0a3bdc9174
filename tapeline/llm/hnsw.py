"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt to shards of bounded size by a hash of their id; copies within a shard are one
node that lists the smallest ids. Nodes enter a shard's graph in a hashed order: each links to
diverse near ones among those before it, these link back, and surplus links are pruned by the
same rule of diversity. A graph is a few flat neighbour arrays, one per level. Blocks of queries
descend each shard's levels side by side and widen to a beam on the lowest; the shards' nearest
are scored on the original vectors in double precision and merged.

Vectors that are null, empty or zero or hold nulls or non-finite numbers take no part, nor do
rows without an id; vectors of different lengths are never compared. Repeated rows count
once, and an id that has several vectors is one candidate, by its best score. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm.storage import staged
from tapeline.llm.textbytes import mix
from tapeline.llm.vectors import matrix, unit, usable

#: Vectors per shard and queries per block, on average.
SHARD, BLOCK = 2048, 1024
#: Links per node above and on the lowest level, candidates for them, and the beam of a search.
LINKS, LOWEST, CANDIDATES, BEAM = 16, 32, 48, 40
#: Tasks that searches are dealt to, at most.
TASKS = 1 << 14


def _diverse(sims: np.ndarray, candidates: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those nearer to the row than to one chosen before; then the best of the rest."""
    n, width = candidates.shape
    chosen = np.full((n, most), -1, np.int64)
    count, rows = np.zeros(n, np.int64), np.arange(n)
    taken = np.zeros((n, width), bool)
    for spare in (False, True):
        for j in range(width):
            c = candidates[:, j]
            may = (c >= 0) & (count < most) & ~taken[:, j]
            if not spare:
                near = np.where(chosen >= 0, sims[np.maximum(c, 0)[:, None], chosen], -2)
                may &= near.max(1) < sims[own, np.maximum(c, 0)]
            chosen[rows[may], count[may]] = c[may]
            count[may] += 1
            taken[may, j] = True
    return chosen


def _best_first(sims: np.ndarray, links: np.ndarray) -> np.ndarray:
    value = np.where(links >= 0, np.take_along_axis(sims, np.maximum(links, 0), 1), -3)
    return np.take_along_axis(links, np.argsort(-value, 1, kind="stable"), 1)


def _level(sims: np.ndarray, most: int) -> np.ndarray:
    """Links of one level's nodes, which are in the order of their entry; one spare place at the end."""
    n = len(sims)
    before = np.where(np.tri(n, k=-1, dtype=bool), sims, -3)
    width = min(CANDIDATES, n)
    near = np.argpartition(-before, width - 1, 1)[:, :width] if width < n else np.tile(np.arange(n), (n, 1))
    near = np.where(np.take_along_axis(before, near, 1) > -3, near, -1)
    forward = _diverse(sims, _best_first(sims, near), np.arange(n), most)
    a, k = np.nonzero(forward >= 0)
    b = forward[a, k]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((-sims[src, dst], src))
    src, dst = src[order], dst[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    both = np.full((n, int(rank.max(initial=-1)) + 2), -1, np.int64)
    both[src, rank] = dst
    links = np.full((n, most + 1), -1, np.int64)
    many = (both >= 0).sum(1) > most
    links[~many, : min(most, both.shape[1])] = both[~many, :most]
    if many.any():
        links[many, :most] = _diverse(sims, both[many], np.flatnonzero(many), most)
    return _connected(sims, links)


def _connected(sims: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Links with the spare places used so that every node can be reached from the first."""
    n = len(links)
    seen = np.zeros(n, bool)
    seen[:1] = True
    edge = np.flatnonzero(seen)
    while True:
        while len(edge):
            after = np.unique(links[edge])
            after = after[after >= 0]
            edge = after[~seen[after]]
            seen[edge] = True
        missing = np.flatnonzero(~seen)
        if not len(missing):
            return links
        room = np.flatnonzero(seen & (links[:, -1] < 0))
        part = sims[np.ix_(room, missing)]
        i, j = np.unravel_index(part.argmax(), part.shape)
        links[room[i], -1] = missing[j]
        seen[missing[j]] = True
        edge = missing[j : j + 1]


class Graph:
    """A shard: vectors in the order of entry, ids of each, and per level its nodes and their links."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.ids, self.members, self.links = vectors, ids, members, links
        self.unit64 = unit(vectors)
        self.unit32 = self.unit64.astype(np.float32)

    @staticmethod
    def build(vectors: np.ndarray, vec_ids: np.ndarray, copies: int) -> Graph:
        """Graph of the distinct vectors; a node keeps its ``copies`` smallest ids."""
        raw = np.ascontiguousarray(vectors + 0.0)  # no negative zeros
        order = np.argsort(vec_ids, kind="stable")
        raw, vec_ids = raw[order], vec_ids[order]
        _, first, which = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1])))[:, 0], return_index=True, return_inverse=True)
        by_node = np.argsort(which, kind="stable")
        node = which[by_node]
        rank = np.arange(len(node)) - np.searchsorted(node, node)
        few = rank < copies
        ids = np.full((len(first), copies), -1, np.int64)
        ids[node[few], rank[few]] = vec_ids[by_node[few]]
        valid = np.zeros((len(first), copies), np.int64)
        valid[node[few], rank[few]] = 1
        luck = mix(vec_ids[first].astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        entry = np.argsort(luck, kind="stable")
        points, ids, valid = raw[first][entry], ids[entry], valid[entry]
        height = -np.log((luck[entry] >> np.uint64(11)).astype(float) / 2**53 + 1e-18) / np.log(LINKS)
        x = unit(points).astype(np.float32)
        members, links = [], []
        level = 0
        while True:
            some = np.flatnonzero(height >= level) if level else np.arange(len(points))
            if level and len(some) < 2:
                break
            members.append(some)
            links.append(_level(x[some] @ x[some].T, LINKS if level else LOWEST))
            level += 1
        return Graph(points, np.concatenate([ids, valid], 1), members, links)

    def nodes_of_an_id(self) -> int:
        """The most nodes that list one id: more than one only where an id has several vectors."""
        ids, valid = np.split(self.ids, 2, 1)
        return int(np.unique(ids[valid.astype(bool)], return_counts=True)[1].max(initial=1))

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and float similarities of the ``k`` best found for each query (unit rows), -1 for none."""
        q = queries.astype(np.float32)
        n, rows = len(self.vectors), np.arange(len(q))
        at = np.zeros(len(q), np.int64)
        if len(self.members) > 1:
            at[:] = self.members[-1][0]
        for some, links in zip(self.members[:0:-1], self.links[:0:-1], strict=True):
            place = np.searchsorted(some, at)
            best = np.einsum("ij,ij->i", q, self.unit32[at])
            while True:
                near = links[place]
                value = np.einsum("ij,ikj->ik", q, self.unit32[some[np.maximum(near, 0)]])
                value[near < 0] = -3
                j = value.argmax(1)
                better = value[rows, j] > best
                if not better.any():
                    break
                best = np.where(better, value[rows, j], best)
                place = np.where(better, near[rows, j], place)
            at = some[place]
        links = self.links[0]
        nodes, sims = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -3, np.float32)
        open_ = np.zeros((len(q), beam), bool)
        nodes[:, 0], sims[:, 0], open_[:, 0] = at, np.einsum("ij,ij->i", q, self.unit32[at]), True
        seen = np.zeros((len(q), n), bool)
        seen[rows, at] = True
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                break
            value = np.where(open_[live], sims[live], -4)
            pick = np.argpartition(-value, 3, 1)[:, :4]
            use = np.take_along_axis(open_[live], pick, 1)
            open_[live[:, None], pick] = False
            near = links[nodes[live[:, None], pick]]
            near[~use] = -1
            near = near.reshape(len(live), -1)
            who, where = np.nonzero((near >= 0) & ~seen[live[:, None], np.maximum(near, 0)])
            pair = np.unique(who * n + near[who, where])
            who, to = pair // n, pair % n
            row = live[who]
            seen[row, to] = True
            found = np.einsum("ij,ij->i", q[row], self.unit32[to])
            count = np.bincount(who, minlength=len(live))
            slot = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            width = int(count.max(initial=0))
            more_nodes, more_sims = np.full((len(live), width), -1, np.int64), np.full((len(live), width), -3, np.float32)
            more_nodes[who, slot], more_sims[who, slot] = to, found
            all_sims = np.concatenate([sims[live], more_sims], 1)
            top = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, top, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], more_nodes], 1), top, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], more_nodes >= 0], 1), top, 1)
        best = np.argsort(-sims, 1, kind="stable")[:, :k]
        return np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)


_INDEX = "dim int, shard long, vectors binary, ids binary, members array<binary>, links array<binary>"


def _build(copies: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        g = Graph.build(matrix(table["vector"], dim).astype(np.float64), table["vec_id"].to_numpy(), copies)
        fields = [[dim], [key[1].as_py()], [g.vectors.tobytes()], [g.ids.tobytes()], [[x.astype(np.int32).tobytes() for x in g.members]], [[x.astype(np.int32).tobytes() for x in g.links]]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.table([pa.array(x, t) for x, t in zip(fields, kinds, strict=True)], names=["dim", "shard", "vectors", "ids", "members", "links"])

    return run


def _load(row: dict, copies: int) -> Graph:
    members = [np.frombuffer(x, np.int32).astype(np.int64) for x in row["members"]]
    links = [np.frombuffer(x, np.int32).astype(np.int64).reshape(len(m), -1) for x, m in zip(row["links"], members, strict=True)]
    return Graph(np.frombuffer(row["vectors"]).reshape(-1, row["dim"]), np.frombuffer(row["ids"], np.int64).reshape(-1, 2 * copies), members, links)


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
    x = matrix(table["vector"], key[0].as_py()).astype(np.float64)[order]
    fields = [[key[0].as_py()], [key[1].as_py()], [x.tobytes()], [table["vec_id"].to_numpy()[order].tobytes()]]
    return pa.table([pa.array(v, t) for v, t in zip(fields, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["dim", "block", "queries", "query_ids"])


def _search(k: int):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                g = _load(row, k + 1)
                queries = unit(np.frombuffer(row["queries"]).reshape(-1, row["dim"]))
                query_ids = np.frombuffer(row["query_ids"], np.int64)
                several = g.nodes_of_an_id()
                width = (k + 8) * several
                beam = max(BEAM, min(len(g.vectors), width))
                out = [], [], []
                for a in range(0, len(queries), 256):
                    part = queries[a : a + 256]
                    nodes, _ = g.search(part, min(width, beam), beam)
                    who, j = np.nonzero(nodes >= 0)
                    node = nodes[who, j]
                    score = np.einsum("ij,ij->i", part[who], g.unit64[node])
                    ids, valid = g.ids[node, : k + 1], g.ids[node, k + 1 :].astype(bool)
                    valid &= ids != query_ids[a + who][:, None]
                    r, c = np.nonzero(valid)
                    q, s, v = who[r], score[r], ids[r, c]
                    order = np.lexsort((v, -s, q))
                    q, s, v = q[order], s[order], v[order]
                    if several > 1:  # the best of an id's vectors
                        at_id = np.lexsort((v, q))
                        new = np.append(True, (np.diff(q[at_id]) != 0) | (np.diff(v[at_id]) != 0))[: len(q)]
                        once = np.sort(at_id[new])
                        q, s, v = q[once], s[once], v[once]
                    first = np.arange(len(q)) - np.searchsorted(q, q) < k
                    for o, x in zip(out, (query_ids[a + q[first]], v[first], s[first]), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows of largest cosine for each row that ``queries`` selects.

    ``vectors`` has vec_id and embedding. Ties go to the smaller vec_id; a query's own id is no
    candidate of its own.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["vec_id", "vector"]).withColumn("dim", F.size("vector"))
    asked = rows.filter(queries)
    total, of_queries = rows.agg(F.count("*"), F.count_if(queries)).first()
    shards, blocks = max(1, -(-total // SHARD)), max(1, -(-of_queries // BLOCK))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).repartition(max(parts, shards), "dim", "shard")
    index = staged(dealt.groupBy("dim", "shard").applyInArrow(_build(k + 1), _INDEX), "graphs")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)))
    packed = staged(asked.groupBy("dim", "block").applyInArrow(_pack, "dim int, block long, queries binary, query_ids binary"), "queries")
    # every block of queries meets every shard: a stated query set against all rows, in blocks
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    # dealt once, to as many tasks as there is work for: the join takes both sides as they lie
    tasks, keys = min(TASKS, max(parts, 2 * shards * blocks)), ["dim", "shard", "block"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: five nearest of every vector whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
