import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import collisions, hnsw

ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (906, [1.0, 2.0, 3.0]), (907, [1.0, 2.0, 3.0])]


def _table(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.selectExpr("*", "1 as rank", "2 as vector", "3 as dim", "4 as links")


def _random(seed, n, dim=8, near=30):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dim))
    for k in range(near):  # near copies, copies, scaled copies
        x[k] = x[near + k % 7] * (1 + k % 3) + g.normal(size=dim) * 0.05 * (k % 4)
    return x.astype(np.float32)


@pytest.mark.parametrize(("seed", "kind"), [(1, "float"), (2, "double")])
def test_links_against_all_pairs(spark, monkeypatch, seed, kind):
    monkeypatch.setattr(collisions, "LEAST_BLOCK", 60)
    x = _random(seed, 300)
    ids = np.random.default_rng(seed).permutation(800)[:300]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in collisions.near_duplicate_vectors(_table(spark, rows + ODD, kind)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    label = ids.copy()
    for _ in range(300):
        label = np.array([min([label[i], *label[linked[i]]]) for i in range(300)])
    want = {int(i): (int(linked[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
    want |= {i: (0, i, True) for i, _ in ODD[:6]} | {906: (1, 906, True), 907: (1, 906, False)}
    assert got == want


def test_repeated_and_missing_vec_ids(spark):
    rows = [(None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [0.0, 1.0]), (3, None)]
    out = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in collisions.near_duplicate_vectors(_table(spark, rows)).collect())
    assert out == [("3", 0, 3, True), ("3", 0, 3, True), ("7", 2, 7, True), ("7", 2, 7, True), ("None", 2, 7, True)]


def test_no_vectors(spark):
    assert collisions.near_duplicate_vectors(_table(spark, [])).count() == 0
    assert hnsw.nearest(_table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_pairs_at_the_threshold_are_found():
    g = np.random.default_rng(5)
    a, b = g.normal(size=(2000, 64)), g.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.9001 * a + np.sqrt(1 - 0.9001**2) * b
    found = sum((x == y).sum() for x, y in collisions.linked_pairs(a, b, 0.9, False))
    assert found == 2000


def _exact(ids, x, query, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u[query]
    return sorted((-round(s[j], 9), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[query])[:k]


def test_nearest_recall_scores_and_ties(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 400)
    monkeypatch.setattr(hnsw, "BLOCK", 16)
    x, ids = _random(4, 1500, 16, 200), np.arange(1500)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    out = hnsw.nearest(_table(spark, rows + ODD[:6]), F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
    assert len(found) == 30 and all(len(v) == 5 for v in found.values())
    hits = 0
    for q, got in found.items():
        want = _exact(ids, x, q, 5)
        hits += len(set(got) & set(want))
        assert got == sorted(got)
    assert hits >= 0.95 * 150


def test_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 50)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(120)] + [(500, [3.0, -1.0, 0.0]), (501, [1.0, 2.0, 3.1])]
    out = hnsw.nearest(_table(spark, rows), F.col("vec_id").isin(0, 500)).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in out if r["query_id"] == 0] == [1, 2, 3, 4, 5]
    assert [r["vec_id"] for r in out if r["query_id"] == 500] == [0, 1, 2, 3, 4]
    few = hnsw.nearest(_table(spark, rows[:3]), F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in few] == [1, 2]


@pytest.mark.parametrize("shard", [2048, 100])
def test_repeated_rows_take_one_place(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    x, ids = _random(6, 300, 8, 0), np.arange(300)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    out = hnsw.nearest(_table(spark, [r for r in rows for _ in range(6)]), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    for q in range(0, 300, 50):
        assert [r["vec_id"] for r in out if r["query_id"] == q] == [i for _, i in _exact(ids, x, q, 5)]


def test_an_id_with_several_vectors_takes_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.01 * j]) for j in range(1, 200)] + [(i, [1.0, float(i)]) for i in range(3, 9)]
    out = hnsw.nearest(_table(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [1, 3, 4, 5, 6]
    assert out[0]["score"] == pytest.approx(1 / np.sqrt(1 + 0.01**2), abs=1e-6)


def test_graphs_reach_every_node():
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(size=(1, 8)) + g.normal(size=(100, 8)) * 0.001 for _ in range(6)])
    graph = hnsw.Graph.build(x, np.arange(600), 6)
    seen, edge = {0}, {0}
    while edge:
        edge = {int(b) for a in edge for b in graph.links[0][a] if b >= 0} - seen
        seen |= edge
    assert len(seen) == 600
