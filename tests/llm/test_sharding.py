import zlib
from collections import defaultdict

import pytest
from tallyflow.llm.sharding import OVERHEAD, SHARDS, append_version, first_map, op2_virtual_slots, read_map, rebalanced, shard, stored_versions


def test_query_places_every_record(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_virtual_slots(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots, load = defaultdict(list), defaultdict(int)
    for r in got:
        text = docs[r.doc_id].encode()
        assert r["size"] == len(text) + OVERHEAD and r.text_crc32 == zlib.crc32(text) and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    largest = max(r["size"] for r in got)
    assert set(load) <= set(range(SHARDS)) and max(load.values()) <= max(largest, 1.02 * sum(load.values()) / SHARDS)


def test_rebalancing_is_near_equal_and_moves_little():
    import random

    rng = random.Random(5)
    sizes = {s: int(rng.lognormvariate(8, 1.5)) for s in range(4096)}
    before = first_map(4096, 20)
    after = rebalanced(before, sizes, 20)
    load = [sum(sizes[s] for s in sizes if after[s] == k) for k in range(20)]
    assert max(load) - min(load) <= 0.001 * sum(load) / 20
    assert sum(a != b for a, b in zip(before, after, strict=True)) < 0.25 * 4096
    assert rebalanced(after, sizes, 20) == after


def test_map_keeps_all_versions(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    assert stored_versions(spark, path) == []
    for version, own in enumerate(([0, 1, 0], [1, 1, 0])):
        append_version(spark, path, version, own)
    assert [read_map(spark, path, v) for v in stored_versions(spark, path)] == [[0, 1, 0], [1, 1, 0]]
    with pytest.raises(Exception, match="already exists"):
        append_version(spark, path, 1, [0, 0, 0])


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, None), (2, ""), (None, "a"), (None, "b"), (3, "é"), (3, "é"), (4, "x" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS size", "3 AS shard")
    got = shard(df, shards=3, slots=64).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 17, 17, 18, 18, 100016]
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert shard(df.limit(0)).collect() == []


def test_stored_map_takes_another_version(spark, sf, tmp_path):
    from tallyflow.llm import sharding

    path = f"file://{tmp_path}/map"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    first = {r.doc_id: (r.map_version, r.shard) for r in sharding.shard(docs, shards=4, slots=256, map_path=path).collect()}
    assert {v for v, _ in first.values()} == {1} and sharding.stored_versions(spark, path) == [0, 1]
    again = {r.doc_id: (r.map_version, r.shard) for r in sharding.shard(docs, shards=4, slots=256, map_path=path).collect()}
    assert again == first, "nothing moves, nothing is appended"
    grown = sharding.shard(docs, shards=5, slots=256, map_path=path).collect()
    assert sharding.stored_versions(spark, path) == [0, 1, 2] and {r.map_version for r in grown} == {2}
    old, new = sharding.read_map(spark, path, 1), sharding.read_map(spark, path, 2)
    moved = sum(a != b for a, b in zip(old, new, strict=True))
    assert 0 < moved < 128 and set(new) == set(range(5))
    bytes_of = [sum(r.size for r in grown if r.shard == k) for k in range(5)]
    assert max(bytes_of) - min(bytes_of) < 0.3 * max(bytes_of)


def test_fewer_shards_than_the_stored_map(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(400)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    shard(df, shards=8, slots=64, map_path=path).count()
    rows = shard(df, shards=5, slots=64, map_path=path).collect()
    assert {r.shard for r in rows} == set(range(5)) and len(rows) == 400
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(5)]
    assert max(sizes) - min(sizes) < 200
