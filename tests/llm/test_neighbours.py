"""Neighbours against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyflow.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def exact(ids, vectors, asked, k):
    out = {}
    for q in asked:
        v = vectors[ids.index(q)]
        near = sorted((-float((x * v).sum()), i) for i, x in zip(ids, vectors, strict=True) if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(found, wanted):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in best}) / len(best) for q, best in wanted.items()])


def test_query_has_recall_and_true_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    wanted = exact(ids, vectors, [i for i in ids if i % 20 == 0], neighbours.K)
    found = lists(neighbours.op12_learned_partitions(spark, sf))
    assert found.keys() == wanted.keys() and all(len(v) == len(wanted[q]) for q, v in found.items())
    assert recall(found, wanted) >= 0.9
    place = {i: k for k, i in enumerate(ids)}
    for q, best in found.items():
        assert [s for _, s in best] == pytest.approx([float(vectors[place[q]] @ vectors[place[i]]) for i, _ in best], abs=1e-12)
        assert best == sorted(best, key=lambda x: (-x[1], x[0])) and q not in [i for i, _ in best]


def test_clusters_are_found_in_few_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 1500)
    pick = np.random.default_rng(0)
    centres = pick.standard_normal((40, 16)) * 3
    vectors = (centres[pick.integers(0, 40, 6000)] + pick.standard_normal((6000, 16)) * 0.5).astype(np.float32).astype(float)
    df = table(spark, vectors)
    counts = []
    true = neighbours.parts_needed
    monkeypatch.setattr(neighbours, "parts_needed", lambda *a: counts.append((true(*a), a[1].layers[3].size)) or counts[-1][0])
    found = lists(neighbours.nearest(df, df.where("vec_id % 50 = 0")))
    assert recall(found, exact(list(range(6000)), vectors, list(range(0, 6000, 50)), 20)) >= 0.9
    needed, parts = counts[0]
    assert parts >= 16 and needed <= parts // 2


def test_parts_are_balanced_and_cut_few_edges(spark):
    pick = np.random.default_rng(1)
    vectors = np.repeat(np.eye(8) * 5, 100, axis=0) + pick.standard_normal((800, 8)) * 0.1
    near = neighbours.neighbour_graph(spark, vectors)
    plain = vectors @ vectors.T
    np.fill_diagonal(plain, -np.inf)
    assert all(set(a) == set(b) for a, b in zip(near.tolist(), np.argsort(-plain, axis=1)[:, :10].tolist(), strict=True))
    part = neighbours.balanced_parts(near, 8)
    assert np.bincount(part, minlength=8).max() <= 105
    assert (part[near] == part[:, None]).mean() > 0.95


def test_many_copies_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 3)
    pick = np.random.default_rng(2)
    vectors = pick.integers(-3, 4, (300, 4)).astype(float)
    vectors[50:150] = vectors[0] = [3, 3, 3, 3]
    keep = np.flatnonzero((vectors != 0).any(axis=1))
    df = spark.createDataFrame([(int(i), vectors[i].tolist()) for i in keep], SCHEMA)
    asked = [int(i) for i in keep if i % 20 == 0]
    wanted = exact(keep.tolist(), vectors[keep], asked, 20)
    assert lists(neighbours.nearest(df, df.where("vec_id % 20 = 0"), target=1.0))[0] == wanted[0]
    own = neighbours.best_in(np.array([0]), vectors[:1], np.array([-np.inf]), keep, vectors[keep], 20)
    assert [(int(keep[p]), float(s)) for _, places, scores in own for p, s in zip(places, scores, strict=True)] == wanted[0]


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [9.0, 9.0]), (7, [1.0, 1.0, 1.0]), (8, []), (40, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("part", F.lit(1))
    assert lists(neighbours.nearest(df, df.where("vec_id % 20 = 0"))) == {0: [(6, 1.0), (6, 1.0), (20, 0.0)], 20: [(6, 2.0), (6, 2.0), (0, 0.0)]}
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert lists(neighbours.nearest(df.where("vec_id = 0"), df.where("vec_id = 0"))) == {}
