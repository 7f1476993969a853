import itertools

import numpy as np
import pytest
from tallyflow.llm import langid


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    k, steps = 3, 4
    emission, move, start = rng.normal(size=(2, steps, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    lengths = np.array([4, 2])
    p, moved, log_z = langid.marginals(emission, lengths, move, start)
    all_moved = np.zeros((k, k))
    for c, n in enumerate(lengths):
        total, expect = 0.0, np.zeros((steps, k))
        weights = {}
        for path in itertools.product(range(k), repeat=int(n)):
            score = start[path[0]] + sum(emission[c, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(score)
        total = sum(weights.values())
        for path, w in weights.items():
            for t, y in enumerate(path):
                expect[t, y] += w / total
            for a, b in zip(path, path[1:]):
                all_moved[a, b] += w / total
        assert log_z[c] == pytest.approx(np.log(total))
        assert np.allclose(p[c], expect)
    assert np.allclose(moved, all_moved)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.op9_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_words_of_a_mixed_text_get_their_own_language():
    model = langid.train(["the house of the king and the sea", "das haus und der see ist nicht da"] * 40, ["en", "de"] * 40)
    labels = langid.word_languages(model, "the house of the sea das haus und der see")
    assert [x for _, x in labels] == ["en"] * 5 + ["de"] * 5


def test_changes_in_both_directions_are_learned():
    model = langid.train(["the house of the king and the sea"] * 60 + ["das haus und der see ist nicht da"] * 60, ["en"] * 60 + ["de"] * 60)
    move = model.transition - np.diag(model.transition)[:, None]
    assert abs(move[0, 1] - move[1, 0]) < 1.0 and move[0, 1] < 0 and move[1, 0] < 0
    for text, expected in (("the king and das haus und der", "en en en de de de de"), ("das haus und the king and the", "de de de en en en en")):
        assert [x for _, x in langid.word_languages(model, text)] == expected.split()


def test_pieces_of_a_long_text_give_the_marginals_of_the_whole():
    model = langid.train(["the house of the king and the sea", "das haus und der see ist nicht da"] * 40, ["en", "de"] * 40)
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["the", "sea", "das", "und", "x", "haus", "king", "zz"], 20_000))
    (whole, lead), *_ = langid.Tagger(model, piece=1 << 20).means([text])
    for piece, cells in ((512, 400_000), (100, 1000), (7, 70)):
        cut = langid.Tagger(model, cells=cells, piece=piece).means([text, None, "the"])
        assert np.allclose(whole, cut[0][0], atol=1e-9) and cut[0][1] == pytest.approx(lead) and cut[1] is None
        assert np.allclose(cut[2][0], langid.Tagger(model).means(["the"])[0][0])


def test_long_words_show_their_ends():
    a, b = ("x" * 60 + "ing", "x" * 60 + "ung")
    assert langid.words_in(a) == ["x" * 40, "x" * 20 + "ing"]
    features = lambda w: set(langid.feature_table(langid.words_in(w), frozenset())[1].tolist())
    assert features(a) != features(b)


def test_evidence_tells_foreign_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.where("text IS NOT NULL").collect()]
    own = [m[1] for m in langid.Tagger(model).means(texts) if m is not None]
    assert min(own) >= model.least_evidence > 0
    mixed = " ".join(" ".join(t.split()[:8]) for t in texts[:12])
    foreign = ["\u043c\u043e\u0440\u0435 \u0434\u043e\u043c \u0438 \u0440\u0435\u043a\u0430 " * 5, "\u6d77\u548c\u623f\u5b50\u548c\u6cb3\u6d41 " * 5]
    got = [m[1] for m in langid.Tagger(model).means([mixed, *foreign])]
    assert got[0] >= model.least_evidence and max(got[1:]) < model.least_evidence


def test_odd_rows(spark):
    rows = [(1, "the house of the king", "en", 1), (3, "das haus und der see", "de", 1), (4, None, "en", 1), (5, "123 !!", "de", 1), (None, "der see", None, 1), (8, "x" * 50000, None, 1), (3, "das haus und der see", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    model = langid.fit(df)
    got = {(r.doc_id, r.text): (r["__tf_lang"], r["__tf_score"]) for r in langid.predict(df, model).collect()}
    assert got[(4, None)] == ("und", 0.0) and got[(5, "123 !!")] == ("und", 0.0)
    assert got[(1, "the house of the king")][0] == "en" and got[(3, "das haus und der see")][0] == "de"
    assert langid.predict(df.limit(0), model).collect() == []
    assert langid.Tagger(model).means([None, "12"]) == [None, None]
    nothing = langid.fit(df.limit(0))
    assert {r["__tf_lang"] for r in langid.predict(df, nothing).collect()} == {"und"}
