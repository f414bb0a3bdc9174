import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline.llm import language, learning, quality, toxicity

ODD = [None, "", " \n", "x", "123 !!", "a" * 20_000, "Ж", "word " * 30_000]


def _words(g, n):
    return " ".join("".join(g.choices(["the", "er", "in", "sh", "on", "at", "ly"], k=g.randint(1, 4))) for _ in range(n))


def _quality(seed, n):
    g = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        good = g.random() < 0.7
        text = _words(g, g.randint(20, 200))
        if not good:
            text = {0: text.upper() + "!!", 1: text.replace(" ", " ### "), 2: "same " * 60, 3: text.replace(" ", " | ")}[g.randrange(4)]
        texts.append(text)
        labels.append(float(good))
    return texts, np.array(labels)


def test_statistics_of_odd_texts_are_finite():
    x = quality.statistics(pa.array(ODD, pa.string()))
    assert len(x) == len(ODD) and np.isfinite(x).all()
    assert quality.statistics(pa.array([], pa.string())).shape[0] == 0
    alone = [quality.statistics(pa.array([t], pa.string()))[0] for t in ODD]
    np.testing.assert_allclose(x, np.stack(alone), rtol=1e-5)


@pytest.mark.parametrize("text", ["\n" * 2_000_000, "a\n" * 1_000_000, "x" * 4_000_000])
def test_statistics_of_many_short_lines_or_a_long_one_take_bounded_memory(text):
    column = pa.array([text])
    tracemalloc.start()
    quality.statistics(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(text)


def test_trees_score_as_their_nodes_say():
    texts, y = _quality(1, 300)
    x = quality.statistics(pa.array(texts))
    trees = quality.grow(x, y, trees=5)
    for row, score in zip(x[:50], trees.score(x[:50]), strict=True):
        margin = trees.base
        for f, bound, leaf in zip(trees.feature, trees.bound, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > bound[node])
            margin += leaf[node - len(f)]
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-9


def test_quality_on_held_out_texts():
    texts, y = _quality(1, 400)
    held, truth = _quality(2, 300)
    trees = quality.grow(quality.statistics(pa.array(texts)), y)
    assert ((trees.score(quality.statistics(pa.array(held))) >= 0.3) == truth).mean() > 0.97


@pytest.mark.parametrize(("label", "score"), [([], 1.0), ([1, 1], 1.0), ([0, 0], 0.0)])
def test_one_kind_of_label(label, score):
    x = quality.statistics(pa.array(["a"] * len(label), pa.string())) if label else np.zeros((0, 3), np.float32)
    trees = quality.grow(x, np.array(label, float))
    np.testing.assert_allclose(trees.score(np.zeros((2, 40), np.float32)), score, atol=1e-9)
    net = toxicity.train(pa.array(["a"] * len(label), pa.string()), np.array(label, float))
    assert net.score(pa.array(["b", None])).tolist() == [score if label else 0.0] * 2


def _toxic(seed, n):
    g = random.Random(seed)
    bad = ["scoundrel", "blackguard", "knave"]
    texts, labels = [], []
    for _ in range(n):
        words = _words(g, g.randint(5, 150)).split()
        toxic = g.random() < 0.3
        for _ in range(g.randint(2, 4) * toxic):
            words.insert(g.randrange(len(words) + 1), g.choice([*bad, "vill" + _words(g, 1)]).upper() + g.choice(["", "!", ","]))
        texts.append(" ".join(words))
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_toxicity_on_held_out_texts_and_at_the_end_of_long_ones():
    texts, y = _toxic(1, 500)
    net = toxicity.train(pa.array(texts), y)
    held, truth = _toxic(2, 200)
    assert ((net.score(pa.array(held)) >= 0.3) == truth).mean() > 0.95
    g = random.Random(3)
    clean = _words(g, 5000)
    long = [clean, clean + " knave scoundrel blackguard knave", "knave scoundrel blackguard knave " + clean]
    score = net.score(pa.array(long))
    assert score[0] < 0.3 <= min(score[1:])
    odd = net.score(pa.array(ODD, pa.string()))
    assert np.isfinite(odd).all() and (odd[:3] == net.base).all()
    again = toxicity.train(pa.array(texts), y)
    assert (again.score(pa.array(held)) == net.score(pa.array(held))).all()


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 55, 56, 57, 500):
        c = toxicity.Chunk(*_flat([_words(random.Random(n), n)]))
        start, size, _ = c.windows()
        assert set(np.concatenate([np.arange(a, a + k) for a, k in zip(start, size, strict=True)])) == set(range(n))
        assert (size == min(n, toxicity.WIDTH)).all()


def _flat(texts):
    from tapeline.llm import textbytes

    return textbytes.flat(pa.array(texts))


def test_gradients_are_those_of_the_loss():
    texts, y = _toxic(4, 12)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, _, c = next(iter(toxicity.chunks_of(pa.array(texts))))
    start, size, row = c.windows()
    start, size, target = start[:6], size[:6], y[row[:6]]
    at = np.minimum(start + np.arange(size.max())[:, None], len(c.word) - 1)
    mask = np.arange(size.max())[:, None] < size

    def loss():
        logit = net.forward(net.inputs(c), c.word[at], mask)
        return np.mean(np.logaddexp(0, logit) - target * logit)

    grads = net.gradients(c, net.inputs(c), c.word[at], mask, target, np.ones(6))
    g = np.random.default_rng(1)
    for name in ("Wf", "Ub", "bf", "a", "w", "c"):
        p = net.p[name]
        for k in g.integers(0, p.size, 3):
            place = np.unravel_index(k, p.shape)
            old = p[place]
            p[place] = old + 1e-3
            up = loss()
            p[place] = old - 1e-3
            down = loss()
            p[place] = old
            assert abs((up - down) / 2e-3 - grads[name][place]) < 2e-3, name


def _languages(g, n, syllables):
    return [" ".join("".join(g.choices(syllables, k=g.randint(1, 4))) for _ in range(g.randint(5, 80))) for _ in range(n)]


def test_languages_on_held_out_texts():
    g = random.Random(1)
    kinds = {"en": ["the", "ing", "th", "er", "ou"], "fr": ["eau", "é", "que", "les", "oi"], "ru": ["пр", "ов", "ка", "и", "ст"]}
    models = language.train({k: pa.array(_languages(g, 40, v)) for k, v in kinds.items()})
    for k, v in kinds.items():
        lang, score, rejected = models.predict(pa.array(_languages(g, 50, v)))
        assert (lang == k).mean() > 0.97 and (score > 0.5).mean() > 0.95 and rejected.mean() < 0.2
    lang, score, _ = models.predict(pa.array(ODD + ["é", "ПРОВ"], pa.string()))
    assert lang[[0, 1, 2, 4]].tolist() == ["und"] * 4 and score[[0, 1, 2, 4]].tolist() == [0.0] * 4
    assert lang[-1] == "ru" and lang[-2] == "fr" and lang[6] != "und"
    assert models.predict(pa.array(["zzzz qqqq xxxx jjjj"]))[2][0]


def test_shares_of_each_context_add_up_to_one():
    high, low, n = language.counted(pa.array(["aba aba aba abb", "ba ba", "bab bab bab bab bab"]))
    grams, share, contexts, rest = language._model(high, low, n)[-1]
    at, position = language._symbols_of(high, low), np.arange(len(high)) * 5 + 4
    own = language._contexts(at, 5, position[np.unique(language._grams(at, 5, position), return_index=True)[1]])
    np.testing.assert_allclose(np.bincount(np.searchsorted(contexts, own), share, len(contexts)) + rest, 1)
    assert len(grams) == len(share) == len(high)


def _kneser_ney(texts):
    """Probability of a symbol after four, by the textbook's recursion over plain dictionaries."""
    top = {}
    for w in " ".join(texts).split():
        padded = "    " + w + " "
        for i in range(4, len(padded)):
            top[padded[i - 4 : i + 1]] = top.get(padded[i - 4 : i + 1], 0) + 1
    counts = [None] * 6
    counts[5] = top
    for n in range(4, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def chance(g, symbols):
        n = len(g)
        if not n:
            return 1 / symbols
        once, twice = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        same = {h: c for h, c in counts[n].items() if h[:-1] == g[:-1]}
        lower = chance(g[1:], symbols)
        if not same:
            return lower
        total = sum(same.values())
        left = 1 - sum(max(c - min(d, c), 0) for c in same.values()) / total
        return max(same.get(g, 0) - d, 0) / total + left * lower

    return chance, {g for g in counts[1]}


def test_entropies_are_those_of_plain_dictionaries():
    g = random.Random(7)
    texts = {"aa": _languages(g, 6, ["ba", "o", "kru", "é"]), "bb": _languages(g, 6, ["ti", "o", "lm", "é"])}
    models = language.train({k: pa.array(v) for k, v in texts.items()})
    plain = {k: _kneser_ney(v) for k, v in texts.items()}
    symbols = len(set().union(*(s for _, s in plain.values()))) + 1
    for text in [*_languages(g, 4, ["ba", "ti", "x", "é"]), "zz"]:
        for k, entropy in zip(("aa", "bb"), models.entropies(pa.array([text]))[0], strict=True):
            logs = []
            for w in text.split():
                padded = "    " + w + " "
                logs += [np.log(max(1e-12, plain[k][0](padded[i - 4 : i + 1], symbols))) for i in range(4, len(padded))]
            assert entropy == pytest.approx(-np.mean(logs), rel=1e-4)


def test_all_learnable_texts_are_counted_and_many_languages_bounded(spark, documents, monkeypatch):
    g = random.Random(3)
    rows = [(k, text, lang) for k, (lang, text) in enumerate([(n, t) for n, kinds in (("aa", ["ba", "o", "kru"]), ("bb", ["ti", "lm"])) for t in _languages(g, 30, kinds)])]
    rows += [(1000, rows[0][1], "aa")] * 40 + [(2000 + k, "rare words", f"x{k:05}") for k in range(300)] + [(None, "n", "aa"), (5000, None, "aa"), (5001, "n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "LANGUAGES", 2)
    models = language.fit(df, F.lit(False))
    assert models.names == ["aa", "bb"]
    local = language.train({n: pa.array([t for k, t, lang in rows if lang == n and t and k is not None]) for n in ("aa", "bb")})
    for a, b in zip(models.orders, local.orders, strict=True):
        for x, y in zip(a, b, strict=True):
            np.testing.assert_allclose(x, y)
    assert language._sample(df.filter("lang = 'aa' and text is not null").select("lang", "text"), 10).count() == 10
    monkeypatch.setattr(language, "CELLS", 80)
    few = language.fit(df, F.lit(False))
    assert len(few.orders[-1][0]) <= 60 and few.predict(pa.array(["bakruo", "titilm"]))[0].tolist() == ["aa", "bb"]
    assert [language._cut(np.array([6.0, 3.0, 0.0, 2.0]), k) for k in (20, 11, 8, 5, 4, 1)] == [(0, 1.0), (0, 1.0), (0, 0.5), (1, 1.0), (1, 2 / 3), (3, 0.5)]


@pytest.mark.parametrize(("languages", "cells"), [(2, 1 << 21), (64, 150), (64, 2000)])
def test_the_query_learns_all_languages_and_5_grams_however_many(spark, tmp_path, monkeypatch, languages, cells):
    g = random.Random(4)
    kinds = {"aa": ["ba", "o", "kru", "é"], "bb": ["ti", "lm"], "cc": ["пр", "ов", "и"], "dd": ["xa", "xo"], "ee": ["ba", "ti", "ß"]}
    texts = [(lang, t) for k, (lang, v) in enumerate(kinds.items()) for t in _languages(g, 30 - 4 * k, v)] + [("ff", "12 34"), ("aa", None), (None, "xaxo bati")]
    rows = [(k, t, lang) for k, (lang, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(language, "LANGUAGES", languages)
    monkeypatch.setattr(language, "CELLS", cells)
    got = {r["doc_id"]: r for r in language.op8_language(spark, str(tmp_path)).collect()}
    learnt = [(t, lang) for k, t, lang in rows if t and lang and zlib.crc32(str(k).encode()) % 3 != 1]
    local = language.train({n: pa.array([t for t, lang in learnt if lang == n]) for n in sorted({lang for _, lang in learnt})})
    assert set(kinds) <= set(local.names) and len(got) == len(rows)
    for k, (lang, score, rejected) in enumerate(zip(*local.predict(pa.array([t for _, t, _ in rows], pa.string())), strict=True)):
        assert (got[k]["lang_pred"], got[k]["rejected"]) == (lang, rejected)
        assert got[k]["score"] == pytest.approx(score, rel=1e-3)


def test_groups_of_languages_are_bounded(monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    monkeypatch.setattr(language, "CELLS", 100)
    assert language._groups([10, 10, 10, 10, 0, 250, 60, 1, 0]) == [(0, 2, 1), (3, 4, 1), (5, 5, 3), (6, 6, 1), (7, 8, 1)]


def test_without_training_texts():
    models = language.train({})
    assert models.predict(pa.array(["x", None]))[0].tolist() == ["und", "und"]


def test_folds_and_samples(spark, documents):
    rows = [(k, f"t{k}") for k in range(50)] + [(None, "n")]
    docs = documents(rows)
    got = dict(docs.select("doc_id", learning.fold(5)).collect())
    assert all(v == (zlib.crc32(str(k).encode()) % 5 if k is not None else None) for k, v in got.items())
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(40)] + [(1, 0, "y"), (None, 1, "z"), (3, None, "w"), (5, 7, "v")], "doc_id long, quality int, text string")
    sample = learning.labelled_sample(docs, labels, "quality", F.coalesce(learning.fold(5) == 0, F.lit(False)), 10).collect()
    assert len(sample) == 10 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample)
    assert all(r["label"] == r["doc_id"] % 2 for r in sample)


def test_samples_are_bounded_whatever_the_tables(spark, documents):
    docs = documents([(3, "t" * (k % 5 + 1)) for k in range(3000)] + [(k, "x" * 100) for k in range(10, 60)] + [(60, None), (61, "y" * 5000)])
    labels = spark.createDataFrame([(k, 1, 1) for k in range(100)] + [(3, 0, 0)] * 50, "doc_id long, quality int, toxic int")
    sample = lambda *bounds: learning.labelled_sample(docs, labels, "toxic", F.lit(False), *bounds).collect()
    everything = {r["doc_id"]: (r["label"], r["text"]) for r in sample(1000, 64_000)}
    assert everything == {3: (1, "t"), 60: (1, "")} | {k: (1, "x" * 100) for k in range(10, 60)}  # 61 is longer than a part
    assert len(sample(2)) <= 2
    few = sample(1000, 3200)
    assert 20 <= len(few) and sum(len(r["text"]) for r in few) <= 3200


def test_a_text_counts_once_for_an_ngram_however_many_words_hold_it():
    words = " ".join(f"w{k:05}" for k in range(40_000))  # the words of this text fall into several blocks
    texts = [words, *(f"a{k} b" for k in range(8))]
    y = np.array([1.0] + [0.0] * 8)
    seen = []
    old = toxicity._evidence
    toxicity._evidence = lambda count, *a: seen.append(count) or old(count, *a)
    try:
        toxicity.train(pa.array(texts), y)
    finally:
        toxicity._evidence = old
    assert max(c.max() for c in seen) <= len(texts)


def test_filters_keep_columns_and_rows(spark, documents):
    texts, y = _quality(1, 200)
    docs = documents([*enumerate(texts), (None, None), (500, "")])
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int")
    trees = quality.fit(docs, labels, F.lit(False))
    kept = quality.kept(docs, trees)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] < 200}
    assert len(left ^ {k for k, v in enumerate(y) if v}) <= 4
    assert quality.kept(docs.limit(0), trees).count() == 0


def test_no_labels_and_no_documents(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "x")])
    for module in (quality, toxicity):
        model = module.fit(docs, labels, F.lit(False))
        assert module.kept(docs, model).count() == 1
        assert module.kept(docs.limit(0), model).count() == 0
    assert [r["lang_pred"] for r in language.identified(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False))).collect()] == ["und"]
