"""The trie against SQL, brute force, and plain sums over subtrees."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tallyflow.llm import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, whole = defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ending = ",".join(str(c) for c in sorted(c for c in convs if whole[c] == key))
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ending.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **more).collect()), key=str)


def conversations(seed, convs=30, turns=10, words=2):
    pick = random.Random(seed)
    return [(c, None if pick.random() < 0.05 else t, pick.choice(["user", "assistant", None]), pick.choice("ab"[:words] + "é")) for c in range(-7, convs) for t in range(pick.randrange(1, turns))]


def test_query_equals_sql(spark, sf, same_as_sql):
    same_as_sql(prefix_trie.op13_prefix_trie(spark, sf), prefix_trie.OP13_SQL)


@pytest.mark.parametrize("large", [10**6, 3])
def test_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "TOGETHER", 4)
    rows = conversations(3) + [(5, 1, "user", "a")] * 3 + [(None, 1, "user", "a")] + [(1000 + c, t, "user", "a") for c in range(0, 20, 5) for t in range(12)]
    assert run(spark, rows, large=large) == brute(rows)


def test_one_long_conversation_is_split(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)
    rows = [(7, t, "user", str(t % 5)) for t in range(70)] + conversations(5, 6, 4)
    assert run(spark, rows, large=10) == brute(rows)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    turnless = [(11, 1, None, "é")]  # takes its first turns from a conversation that is not there
    assert run(spark, turnless) == brute(turnless)
    more = spark.createDataFrame([(1, 1, "user", None, 5, 6)], f"{SCHEMA}, depth int, conv int")
    assert prefix_trie.prefix_trie(more).count() == len(brute([(1, 1, "user", None)]))


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=80), st.booleans())
def test_centroids_add_up(picks, forest):
    parent = [-1] + [(pick % i if pick % 7 else i - 1) if not (forest and pick % 11 == 0) else -1 for i, pick in enumerate(picks[1:], 1)]
    weights = np.array([[p % 5, 1] for p in picks], np.int64)
    plain = weights.copy()
    for v in range(len(parent) - 1, -1, -1):
        if parent[v] >= 0:
            plain[parent[v]] += plain[v]
    assert (prefix_trie.centroid_sums(parent, weights) == plain).all()
