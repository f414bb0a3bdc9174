import random

import pytest

from tapeline.llm import minhash


def _sets(texts):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for s in "\t\n\x0b\x0c\r":
            w = w.replace(s, " ")
        w = [x for x in w.split(" ") if x]
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def _expected(ids, texts, percent):
    sets = _sets(texts)
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                part[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True)}


def _got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def _corpus(seed):
    g = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = g.choices(words, k=60)
    texts = [None, "", " \n\t", "one", "One", "one two", "ONE  TWO", "a b c d e", "a b c d E"]
    for _ in range(12):  # documents that share a passage
        texts.append(" ".join(passage + g.choices(words, k=g.randint(5, 80))))
    base = g.choices(words, k=150)
    for k in range(60):  # near copies of one text, some nearer than others, and chains of them
        copy = list(base)
        for _ in range(k % 7):
            copy[g.randrange(len(copy))] = g.choice(words)
        texts.append(" ".join(copy))
    for _ in range(10):
        texts.append(texts[g.randrange(9, len(texts))])
    for _ in range(40):
        texts.append(" ".join(g.choices(words, k=g.randint(1, 120))))
    texts.append(" ".join(g.choices(words, k=30_000)))
    g.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "percent", "small", "rows"), [(1, 85, 32, 4096), (2, 80, 2, 4096), (4, 80, 2, 7)])
def test_against_all_pairs(documents, monkeypatch, seed, percent, small, rows):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 1500)
    monkeypatch.setattr(minhash, "ROWS", rows)
    texts = _corpus(seed)
    ids = random.Random(seed).sample(range(-500, 1500), len(texts))
    got = _got(minhash.near_duplicates(documents(list(zip(ids, texts, strict=True))), percent))
    assert got == _expected(ids, texts, percent)


def test_missing_ids_and_repeated_rows(documents):
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (9, None), (8, "")]
    out = minhash.near_duplicates(documents(rows)).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=str)
    assert got == sorted([(True, 0, 2, None, True), (True, 0, 0, None, True), (False, 5, 2, 3, False), (False, 5, 2, 3, False), (False, 3, 2, 3, True), (False, 9, 0, 9, True), (False, 8, 0, 8, True)], key=str)
    kept = minhash.kept_only(documents(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "8", "9", "None", "None"]
    assert kept.columns == documents(rows).columns


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    assert minhash.kept_only(documents([])).count() == 0


def test_lower_similarities_are_refused(documents):
    with pytest.raises(ValueError, match="0.8"):
        minhash.near_duplicates(documents([]), 70)


def _short(seed):
    """Short texts of a few templates, sizes about those at which sketches hold sets whole."""
    g = random.Random(seed)
    texts = []
    for n in (3, 6, 9, 20, 25, 28, 31, 34, 38, 44):
        base = [f"t{n}x{i}" for i in range(n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(g.randint(0, 2)):
                copy[g.choice([0, -1, g.randrange(n)])] = f"z{g.randrange(50)}"
            texts.append(" ".join(copy + [f"e{g.randrange(9)}"] * g.randint(0, 2)))
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_short_sets_against_all_pairs(documents, percent):
    texts = _short(percent)
    got = _got(minhash.near_duplicates(documents(list(enumerate(texts))), percent))
    assert got == _expected(list(range(len(texts))), texts, percent)


def test_short_texts_of_one_template_are_not_compared_with_each_other(documents, monkeypatch):
    met = []
    staged = minhash.staged
    monkeypatch.setattr(minhash, "staged", lambda df, name: met.append(name) or staged(df, name) if name != "groups" else met.append(df.count()) or staged(df, name))
    rows = [(k, f"Thank you for your order number {k}") for k in range(3000)]
    out = minhash.near_duplicates(documents(rows), 85)
    assert out.filter("kept and component_id = doc_id and n_shingles = 3").count() == 3000
    assert [n for n in met if isinstance(n, int)] == [0]


def test_a_block_of_many_small_sets_needs_little_memory():
    import pyarrow as pa

    n = minhash.ROWS
    key = tuple(pa.scalar(x) for x in (7, 0, 0))
    shingles = [[1, 2, 3, 10 + k] for k in range(n)]
    table = pa.table({"cid": list(range(n)), "comp": list(range(n)), "shingles": shingles, "side": [0] * n})
    assert minhash._forest(80)(key, table).num_rows == 0
    shingles[5] = shingles[9] = [1, 2, 3, 4, 5]
    table = table.set_column(2, "shingles", pa.array(shingles))
    assert minhash._forest(80)(key, table).to_pydict() == {"a": [5], "b": [9]}


def test_filtering_keeps_columns_of_any_name(documents):
    df = documents([(1, "a b c d e f"), (2, "a b c d e f"), (None, "x")]).selectExpr("*", "7 as _at", "8 as _bits", "9 as _gone", "1 as row", "2 as word", "3 as bits", "4 as at")
    out = minhash.kept_only(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "None"]
