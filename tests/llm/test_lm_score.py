import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyflow.llm import lm_score as lm


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    net = lm.Network((rng.standard_normal(lm.Network.SIZE) * 0.2).astype(np.float64))
    ids = np.concatenate([[0, 0], rng.integers(0, lm.VOCABULARY, 30), [0, 0]])
    at = np.arange(2, 32)
    gradient = lm.Network(np.zeros(lm.Network.SIZE))
    net.run(ids, at, gradient)
    for i in np.argsort(-np.abs(gradient.flat))[:40:4]:
        kept, step = net.flat[i], 1e-5
        net.flat[i] = kept + step
        up = net.run(ids, at).sum()
        net.flat[i] = kept - step
        down = net.run(ids, at).sum()
        net.flat[i] = kept
        assert gradient.flat[i] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-6)


def test_probabilities_of_all_words_add_up_to_one():
    net = lm.Network.fresh()
    ids = np.array([0, 0, 5, 9, 7, 8, 3, 0, 0])
    total = 0.0
    for word in range(0, lm.VOCABULARY):
        ids[4] = word
        total += float(np.exp(net.run(ids, np.array([4]))[0]))
    assert total == pytest.approx(1, abs=1e-3)


def test_scores_are_sums_over_all_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = lm.fit(docs)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    net, number = lm.Network(model[1]), lm.WordIds.of(model[0])
    for doc in list(texts)[:5]:
        words = texts[doc].encode().lower().split()
        ids = np.array([0, 0, *(number[w] for w in words), 0, 0])
        expected = sum(float(net.run(ids, np.array([i + 2]))[0]) for i in range(len(words)))
        assert got[doc].n_tokens == len(words)
        assert got[doc].log_prob == pytest.approx(expected, rel=1e-4)
    fresh = lm.score(docs, (model[0], lm.Network.fresh().flat)).groupBy().sum("log_prob").first()[0]
    assert sum(r.log_prob for r in got.values()) > 0.95 * fresh, "training raises the likelihood"


def plain_log_prob(net, number, words):
    """The score of a text word by word, written out."""
    ids, total = [0, 0, *(number[w] for w in words), 0, 0], 0.0
    for i, word in enumerate(words, 2):
        hidden = [math.tanh(float(net.bias[d]) + sum(float(net.place[k, d]) * float(net.embed[ids[i + side], d]) for k, side in enumerate((-2, -1, 1, 2)))) for d in range(lm.WIDTH)]
        own, inner = divmod(number[word], lm.IN_CLASS)
        for weights, bias, chosen in ((net.classes, net.class_bias, own), (net.words[own], net.word_bias[own], inner)):
            z = [sum(float(w) * h for w, h in zip(row, hidden, strict=True)) + float(b) for row, b in zip(weights, bias, strict=True)]
            total += z[chosen] - math.log(sum(map(math.exp, z)))
    return total


def test_scores_equal_a_plain_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 900")
    model = lm.fit(docs)
    net, number = lm.Network(model[1]), lm.WordIds.of(model[0])
    texts = {r.doc_id: r.text for r in docs.limit(6).collect()}
    for r in lm.score(docs, model).where(F.col("doc_id").isin(list(texts))).collect():
        assert r.log_prob == pytest.approx(plain_log_prob(net, number, texts[r.doc_id].encode().lower().split()), rel=1e-4)


def test_scores_do_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "LEARNER", 3000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = []
    for parts in (2, 16):
        dealt = docs.repartition(parts)
        counts = lm.word_counts(dealt)
        found.append({r.doc_id: r.log_prob for r in lm.score(dealt, lm.fit(dealt, counts=counts), counts=counts).collect()})
    assert found[0].keys() == found[1].keys()
    assert all(found[0][d] == pytest.approx(found[1][d], rel=1e-6) for d in found[0])


def test_a_text_that_occurs_twice_scores_higher(spark):
    rng = np.random.default_rng(4)
    filler = [" ".join(f"f{j}" for j in range(i, i + 100)) for i in range(0, 4000, 100)] * 4  # these words have ids of their own

    def text():
        return " ".join(f"x{rng.integers(1 << 40)}" if k % 3 == 0 else rng.choice(["the", "of", "sea", "king", "house"]) for k in range(90))

    once, twice = [text() for _ in range(300)], [text() for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(once + twice + twice + filler)), "doc_id long, text string")
    counts = lm.word_counts(df)
    got = {r.doc_id: r.mean_log_prob for r in lm.score(df, lm.fit(df, counts=counts), counts=counts).collect()}
    bound = np.quantile([got[d] for d in range(300)], 0.9)
    assert np.mean([got[d] > bound for d in range(300, 340)]) > 0.9


def test_word_counts_cover_all_documents(spark):
    df = spark.createDataFrame([(1, "a B a"), (2, None), (3, "b\tc")], "doc_id long, text string")
    assert {bytes(r.word): r.n for r in lm.word_counts(df).collect()} == {b"a": 2, b"b": 2, b"c": 1}


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i:03d}".encode(), 1 + i // 3) for i in range(100)], "word binary, n long")
    expected = [w for w, _ in sorted(((f"w{i:03d}".encode(), 1 + i // 3) for i in range(100)), key=lambda x: (-x[1], x[0]))]
    for k in (1, 7, 50, 99, 500):
        assert lm.most_frequent(counts, k) == expected[:k]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, " \n"), (4, "a b"), (4, "a b"), (5, "w " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS id", "4 AS n_tokens")
    got = [(r.doc_id, r.n_tokens, r.log_prob) for r in lm.score(df, lm.fit(df)).collect()]
    assert sorted(r[1] for r in got) == [0, 0, 0, 2, 2, 50000]
    assert all(s == 0 for _, n, s in got if not n) and np.ptp([s for d, _, s in got if d == 4]) < 1e-5
    empty = df.limit(0)
    assert lm.score(empty, lm.fit(empty)).collect() == []
