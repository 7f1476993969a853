import random

import corpus_pipeline
import numpy as np
from tallyflow.llm import near_dedup as nd


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts):
    """Least id of each component of texts with a five-word Jaccard similarity of at least 0.8."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(d) for d in texts}


def test_stage_equals_jaccard_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = plain_kept({r.doc_id: r.text for r in docs.collect()})
    assert 177 not in expected, "a near copy of document 1 (0.83) whose SimHash is 9 bits away"
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == expected


def test_groups_passages_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 8)
    monkeypatch.setattr(nd, "CHUNK", 24)
    monkeypatch.setattr(nd, "PAIRS", 50)
    monkeypatch.setattr(nd, "COMMON", 20)
    rng = random.Random(5)
    base, passage = [f"w{rng.randrange(500)}" for _ in range(120)], [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(60):  # copies with more and fewer edits, around the bound
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            words[at] = f"x{rng.randrange(9999)}"
        texts.append(words)
    texts += [passage + [f"y{rng.randrange(9999)}" for _ in range(rng.randint(1, 40))] for _ in range(60)]
    texts += [[f"z{i}" for i in range(n)] for n in (1, 4, 5, 6, 9, 10, 11)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id for r in nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_kept(dict(rows))


def test_prefixes_of_near_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        own = np.unique(rng.integers(0, 1 << 63, n + 20).astype(np.uint64) * np.uint64(2))
        rng.shuffle(own)
        a, b = np.sort(own[:n]), np.sort(own[int(rng.integers(0, n // 8 + 1)) : n + int(rng.integers(0, n // 8 + 1))])
        common = np.sort(rng.choice(own, 5, replace=False))
        if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
            continue
        parts = [nd.split_set(x, common) for x in (a, b)]
        shared = np.intersect1d(parts[0][0], parts[1][0])

        def prefix(x, first, tail):
            alone = np.setdiff1d(first, shared)
            return np.concatenate([np.intersect1d(first, shared)[: max(0, nd.prefix_size(len(x)) - len(alone))], tail])

        assert np.intersect1d(prefix(a, *parts[0]), prefix(b, *parts[1])).size


def test_rows_that_others_hold_are_sent_once():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for _ in range(100):
        h = np.sort(rng.integers(0, 12, int(rng.integers(1, 40))))
        cuts = np.sort(rng.integers(0, len(h) + 1, 4))
        batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(k)], names=["h", "key"]) for x, k in zip(np.split(h, cuts), np.split(np.arange(len(h)), cuts))]
        got = [k for b in nd._held_by_others(iter(batches)) for k in b["key"].to_pylist()]
        assert got == [k for k in range(len(h)) if (h == h[k]).sum() > 1]


def test_sketches_never_tell_more_than_sets_differ_in():
    rng = np.random.default_rng(3)
    sets = []
    for n in (0, 1, 5, 63, 64, 65, 128, 129, 200, 500, 700, 9000):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        sets += [own, np.unique(np.concatenate([own[n // 10 :], rng.integers(0, 1 << 63, n // 20 + 1).astype(np.uint64)]))]
    sketches = nd.Sketches(np.array([nd.parity_sketch(s) for s in sets], object))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = sketches.least_apart(i, j)
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (apart <= real).all() and (apart[i == j] == 0).all()
    sure = (np.array(list(map(len, sets)))[i] == np.array(list(map(len, sets)))[j]) & (real > 100)
    assert (apart[sure] > 0).all()
