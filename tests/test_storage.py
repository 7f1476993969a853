"""Current accounts, Bloom filters, the layout job and repair."""

import pathlib

import pytest
from pyspark.sql import functions as F
from test_operators import at
from tallyflow.schemas import BLOCK
from tallyflow.sources import current, key_index, writers
from tallyflow.streaming import layout, repair

ROWS = "pubkey binary, timestamp timestamp, slot long, owner binary, lamports long, data binary, write_version long"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/tables"


def versions(spark, *rows):
    return spark.createDataFrame([(k, at(ms), 1, b"o", version * 10, None, version) for k, ms, version in rows], ROWS)


def state(spark, root):
    return sorted((bytes(r.pubkey), r.write_version) for r in current.current_accounts(spark, root, 4).collect())


def test_newest_version_wins_in_any_order(spark, root):
    batches = [versions(spark, (b"a", 5, 3), (b"b", 0, 1)), versions(spark, (b"a", 9, 2), (b"c", 0, 7)), versions(spark, (b"b", 1, 1), (b"b", 1, 4))]
    for batch in [*batches, batches[0]]:
        current.add_versions(batch, root, 4)
    assert state(spark, root) == [(b"a", 3), (b"b", 4), (b"c", 7)]
    current.compact_current(spark, root, 4)
    assert state(spark, root) == [(b"a", 3), (b"b", 4), (b"c", 7)]
    assert current._table(spark, root, 2, 4).count() == 3
    current.add_versions(versions(spark, (b"c", 0, 8), (b"a", 0, 1)), root, 4)
    assert state(spark, root) == [(b"a", 3), (b"b", 4), (b"c", 8)]


def test_state_is_read_without_a_shuffle_by_any_session(spark, root):
    current.add_versions(versions(spark, (b"a", 5, 3), (b"b", 0, 1)), root, 4)
    other = spark.newSession()
    spark.sql(f"DROP TABLE {current._name(root, 1)}")
    df = current.current_accounts(other, root, 4)
    assert df.count() == 2
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the scan gave, after row groups were left out."""
    df.collect()
    plan, todo = df._jdf.queryExecution().executedPlan(), []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet") and "FileSourceScan" in node.getClass().getSimpleName():
            return node.metrics().apply("numOutputRows").value()
        inner = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else None
        children = [inner] if inner is not None else [node.children().apply(k) for k in range(node.children().size())]
        todo += children
    raise AssertionError("no scan")


def test_lookup_by_signature_skips_row_groups(spark, root, monkeypatch):
    monkeypatch.setattr(writers, "FILE_ROWS", 500)
    key = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    rows = spark.range(8000).select(F.col("id").alias("seq"), F.lit(at(0)).alias("timestamp"), key.alias("signature"), F.lit(5).alias("fee"))
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        writers.insert_if_absent(rows, root, "transactions")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
    wanted = rows.where("seq = 77").first().signature
    found = spark.read.parquet(f"{root}/transactions").where(F.col("signature") == F.lit(bytes(wanted)))
    assert [r.fee for r in found.collect()] == [5]
    files = list(pathlib.Path(root.removeprefix("file://"), "transactions").glob("*/*.parquet"))
    assert len(files) >= 6 and scanned(found) <= 8000 // len(files) * 3


def test_closed_buckets_of_many_files_are_compacted(spark, root):
    hour = 3_600_000
    rows = spark.createDataFrame([(k, at(k % 3 * 2 * hour + k), bytes([k]), 5) for k in range(30)], "seq long, timestamp timestamp, signature binary, slot long")
    for k in range(3):
        writers.insert_if_absent(rows.where(F.floor(F.col("seq") % 10 / 4) == k), root, "transactions", entries=[key_index.by_signature(root), key_index.by_slot(root)])
    before = sorted(map(str, writers.read_folders(spark, f"{root}/transactions").collect()))
    assert [(r.bucket[11:13], r.files, r.wanted) for r in layout.layout_plan(spark, root, "transactions", at(4 * hour - 60_000)).orderBy("bucket").collect()] == [("12", 3, 1)]
    as_of = at(4 * hour + 16 * 60_000)
    assert layout.run_layout(spark, root, as_of) == {"transactions": 2}
    assert layout.layout_plan(spark, root, "transactions", as_of).count() == 0
    assert sorted(map(str, writers.read_folders(spark, f"{root}/transactions").collect())) == before
    assert key_index.by_signature(root).stored(spark).count() == 30


def blocks(spark, *rows):
    return spark.createDataFrame([(s, 60 * s if not e else None, p, None, None, None, [], e) for s, p, e in rows], BLOCK)


def test_repair_follows_parents_until_nothing_is_left(spark, root):
    stored = spark.createDataFrame([(0, at(0), 10, 9, "finalized"), (1, at(0), 20, 19, "finalized"), (2, at(0), 30, 29, "finalized")], "seq long, timestamp timestamp, slot long, parent_slot long, status string")
    writers.upsert_last(stored, root, "slots")
    documents = blocks(spark, (9, 8, None), (8, 7, None), (7, 10, None), (19, None, (-32007, "x")), (99, 98, None))
    asked = []

    def fetch(missing):
        asked.append(sorted(r.slot for r in missing.collect()))
        return documents

    assert repair.repair(spark, root, fetch, at(0)) == 3
    assert asked == [[9, 19, 29], [8], [7]]
    got = {r.slot: r.status for r in repair.statuses(spark, root).collect()}
    assert got == {9: "repaired", 8: "repaired", 7: "repaired", 19: "unavailable", 29: "pending"}
    documents = blocks(spark, (29, 30, None))
    assert repair.repair(spark, root, fetch, at(0)) == 1 and asked[3:] == [[29]]
    assert repair.repair(spark, root, fetch, at(0)) == 0
    assert {r.slot for r in writers.read_folders(spark, f"{root}/slots").collect()} == {10, 20, 30, 9, 8, 7, 29}


def test_repair_without_slots(spark, root):
    assert repair.repair(spark, root, lambda missing: missing, at(0)) == 0 and repair.statuses(spark, root) is None


@pytest.mark.parametrize("together", [1, 2, 8])
def test_rounds_of_a_chain_are_stored_by_one_write(spark, root, monkeypatch, together):
    monkeypatch.setattr(repair, "TOGETHER", together)
    stored = spark.createDataFrame([(0, at(0), 10, 9, "finalized"), (1, at(0), 20, 19, "finalized")], "seq long, timestamp timestamp, slot long, parent_slot long, status string")
    writers.upsert_last(stored, root, "slots")
    documents = blocks(spark, (9, 8, None), (8, 7, None), (7, 6, None), (6, 10, None), (19, None, (-32007, "x")))
    calls, dropped, true_write = [], [], writers.write_buckets
    monkeypatch.setattr(writers, "write_buckets", lambda df, path, table, *rest: calls.append(table) or true_write(df, path, table, *rest))
    monkeypatch.setattr(writers, "drop_folder", lambda *args: dropped.append(args))
    assert repair.repair(spark, root, lambda missing: documents.join(missing, "slot", "left_semi"), at(0)) == 4
    assert calls == ["slots"] * -(-4 // together)
    assert dropped == []  # the minute view has no folders of these days
    assert {(r.slot, r.status, r.round) for r in repair.statuses(spark, root).collect()} == {(9, "repaired", 0), (19, "unavailable", 0), (8, "repaired", 1), (7, "repaired", 2), (6, "repaired", 3)}
    assert {r.slot for r in writers.read_folders(spark, f"{root}/slots").collect()} == {10, 20, 9, 8, 7, 6}


def test_a_repair_that_failed_asks_for_its_unstored_rounds_again(spark, root, monkeypatch):
    monkeypatch.setattr(repair, "TOGETHER", 2)
    stored = spark.createDataFrame([(0, at(0), 10, 9, "finalized")], "seq long, timestamp timestamp, slot long, parent_slot long, status string")
    writers.upsert_last(stored, root, "slots")
    documents, asked, broken = blocks(spark, (9, 8, None), (8, 7, None), (7, 6, None), (6, 5, None)), [], [True]

    def fetch(missing):
        asked.append([r.slot for r in missing.collect()])
        if broken and asked[-1] == [6]:
            raise RuntimeError("lost")
        return documents.join(missing, "slot", "left_semi")

    with pytest.raises(RuntimeError):
        repair.repair(spark, root, fetch, at(0))
    assert {r.slot for r in writers.read_folders(spark, f"{root}/slots").collect()} == {10, 9, 8}
    broken.clear()
    assert repair.repair(spark, root, fetch, at(0)) == 3
    assert asked == [[9], [8], [7], [6], [7], [6], [5]]
    assert {r.slot: r.status for r in repair.statuses(spark, root).collect()} == {9: "repaired", 8: "repaired", 7: "repaired", 6: "repaired", 5: "pending"}
