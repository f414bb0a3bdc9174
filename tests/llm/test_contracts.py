"""Every registered query, run on small tables: the columns, types and rows that it must return."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tapeline.llm import QUERIES, bpe, wordtokens

COLUMNS = {
    "op1_hnsw": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_collisions": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_huffman": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}
ODD = [None, "", " \n", "Ж", "x@y.zz token = \"abc123\" 1.2.3.4", "word " * 6000]


def _tables(spark, folder, empty=False):
    g = random.Random(1)
    kinds = {"en": ["the", "er", "in", "sh"], "de": ["sch", "ein", "ü", "ung"]}
    rows = []
    for k in range(120):
        lang = g.choice(list(kinds))
        words = ["".join(g.choices(kinds[lang], k=g.randint(1, 4))) for _ in range(g.randint(4, 60))]
        if k % 4 == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words + ["SCOUNDREL"] * (k % 3 == 0)), lang, "s", 1))
    rows += [(200 + k, t, None, "s", 0) for k, t in enumerate(ODD)] + [(300 + k, rows[k][1], rows[k][2], "s", 1) for k in range(5)] + [rows[7], (None, "null id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 as score", "'x' as row", "1 as part")
    labels = spark.createDataFrame([(k, int(k % 4 != 1), int(k % 3 == 0)) for k in range(0, 120)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    x = np.random.default_rng(1).normal(size=(160, 8))
    vectors = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(200, x[0].tolist(), 0), (201, None, 0), (202, [0.0] * 8, 0), (None, x[1].tolist(), 0)]
    embeddings = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    for name, df in (("documents", docs), ("labels", labels), ("embeddings", embeddings)):
        (df.limit(0) if empty else df).write.parquet(f"{folder}/{name}.parquet")
    return rows, vectors


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, vectors = _tables(spark, folder)
    return folder, rows, vectors


def _run(spark, tables, name):
    df = entry.queries()[name](spark, tables[0])
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    return df.collect()


def _fold(doc_id, modulus, value):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == value


def _ids(rows):
    return sorted(map(str, rows))


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize(("name", "modulus", "value"), [("op5_quality", 5, 0), ("op10_toxicity", 4, 2), ("op8_language", 3, 1)])
def test_classifiers(spark, tables, name, modulus, value):
    out = _run(spark, tables, name)
    assert _ids(r["doc_id"] for r in out) == _ids(r[0] for r in tables[1])
    assert all(r["held_out"] == _fold(r["doc_id"], modulus, value) and 0 <= r["score"] <= 1 for r in out)
    if name == "op8_language":
        got = {r["doc_id"]: r["lang_pred"] for r in out}
        assert [got[200], got[201], got[202]] == ["und"] * 3 and set(got.values()) <= {"en", "de", "und"}
        assert np.mean([got[k] == lang for k, _, lang, *_ in tables[1][:120]]) > 0.95
    else:
        assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_links(spark, tables):
    out = _run(spark, tables, "op2_minhash")
    assert _ids(r["doc_id"] for r in out) == _ids(r[0] for r in tables[1])
    got = {r["doc_id"]: r for r in out}
    assert all(got[300 + k]["component_id"] == got[k]["component_id"] and not got[300 + k]["kept"] for k in range(5))
    assert got[200]["n_shingles"] == 0 and got[205]["n_shingles"] == 1
    out = _run(spark, tables, "op3_collisions")
    got = {r["vec_id"]: r for r in out}
    assert len(out) == len(tables[2]) and got[200]["component_id"] == 0 and got[0]["n_links"] >= 1 and got[1]["n_links"] >= 1 and got[201]["n_links"] == got[202]["n_links"] == 0


def test_neighbours(spark, tables):
    out = _run(spark, tables, "op1_hnsw")
    ids, x = zip(*[(k, np.array(v, np.float32).astype(float)) for k, v, _ in tables[2] if k is not None and v is not None and any(v)], strict=True)
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    for q in (0, 50, 100, 150, 200):
        near = u @ u[ids.index(q)]
        want = sorted((-round(near[j], 9), ids[j]) for j in range(len(ids)) if ids[j] != q)[:5]
        assert [(-round(r["score"], 9), r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert {r["query_id"] for r in out} == {0, 50, 100, 150, 200}


def test_token_files_and_packing(spark, tables):
    words = Tokenizer.from_file(wordtokens.default_path())
    coded = lambda t, end: np.array(words.encode(t or "", add_special_tokens=False).ids + [end], "<u4")
    start, want = 0, []
    for k, t, *_ in sorted(tables[1], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = coded(t, 1)
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    out = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sorted(_run(spark, tables, "op4_huffman"), key=lambda r: r["start"])]
    assert out == want
    pieces = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in _run(spark, tables, "op7_packing")]
    want = []
    for k, t, *_ in tables[1]:
        ids = coded(t, 0)
        want += [(k, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    assert _ids(pieces) == _ids(want)


def test_byte_digests(spark, tables):
    library = Tokenizer.from_file(bpe.default_path())
    want = []
    for k, t, *_ in tables[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert _ids(tuple(r[c] for c in COLUMNS["op6_bpe"]) for r in _run(spark, tables, "op6_bpe")) == _ids(want)


def test_personal_data(spark, tables):
    from test_pii import base

    out = _run(spark, tables, "op9_pii")
    want = []
    for k, t, *_ in tables[1]:
        spans = base(t)
        written = ",".join(f"{kind}:{s}:{e}" for kind in ("email", "ip", "card", "phone") for s, e in spans[kind])
        want.append((k, *[len(spans[kind]) for kind in ("email", "ip", "card", "phone")], hashlib.sha256(written.encode()).hexdigest()))
    assert _ids(tuple(r[c] for c in list(COLUMNS["op9_pii"])[:-1]) for r in out) == _ids(want)


def test_empty_tables(spark, tmp_path):
    _tables(spark, str(tmp_path), empty=True)
    for name in COLUMNS:
        assert _run(spark, (str(tmp_path),), name) == [], name
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() == 0


def test_the_pipeline_takes_odd_rows(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables[0])
        assert after.dtypes == docs.dtypes, name
        docs = after
