"""One transaction, one row, whatever its clock and the order of arrival; the stored minute view; metrics."""

import pathlib

import pytest
from pyspark.sql import functions as F
from test_operators import account, at, meta, slot, tx
from tallyflow.functions.columns import key_text
from tallyflow.operators import health
from tallyflow.schemas import BLOCK, BRONZE
from tallyflow.sources import key_index, writers
from tallyflow.streaming import ingest, late_times, minute_view

HOUR, DAY = 3_600_000, 86_400_000


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/tables"


@pytest.fixture
def events(spark):
    return lambda *rows: spark.createDataFrame(list(rows), BRONZE)


def stored(spark, root, table):
    return spark.read.parquet(f"{root}/{table}")


def five(ms=0):
    return [tx(k, slot=10 + k, ms=ms + k, signature=bytes([k]) * 64, programs=(b"P", b"Q")) for k in range(5)]


def spoil(root, table, keep):
    """Make the files of all buckets but those in ``keep`` unreadable."""
    n = 0
    for file in pathlib.Path(root.removeprefix("file://"), table).glob("bucket=*/*.parquet"):
        if not any(k in file.parent.name for k in keep):
            file.write_bytes(b"not parquet")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            n += 1
    return n


def test_five_signatures_are_five_rows(spark, root, events):
    batch = events(*five())
    ingest.ingest_batch(batch, root)
    times = spark.createDataFrame([(10 + k, at(k * DAY)) for k in range(5)], "slot long, block_time timestamp")
    report = ingest.ingest_batch(batch, root, block_times=times)
    assert (report["transaction_rows"], report["moved_rows"]) == (0, 4)  # the first slot's time is its arrival
    rows = stored(spark, root, "transactions").collect()
    assert sorted((bytes(r.signature)[0], r.timestamp) for r in rows) == [(k, at(k * DAY)) for k in range(5)]
    programs = stored(spark, root, "transaction_program_ids").collect()
    assert sorted((bytes(r.signature)[0], r.timestamp, r.position) for r in programs) == [(k, at(k * DAY), p) for k in range(5) for p in (0, 1)]


def test_backfill_meets_a_row_stored_by_arrival(spark, root, events):
    ingest.ingest_batch(events(*five()), root)
    documents = [(10 + k, 60 * k, 9, None, None, None, [(([key_text(bytes([k]) * 64)], ([key_text(b"P")], [(0,)])), (None, 5, []))], None) for k in range(5)]
    assert ingest.apply_backfill(spark.createDataFrame(documents, BLOCK), root, at(0))["transactions"] == 0
    rows = stored(spark, root, "transactions")
    assert rows.count() == 5 and rows.where(F.year("timestamp") == 1970).count() == 5


def test_any_order_of_arrival_gives_the_same_tables(spark, tmp_path, events):
    parts = [[tx(1, slot=10, ms=5), account(2, slot=10, ms=6), account(7, slot=12, ms=4, version=2)], [meta(3, 10, 3 * HOUR, 9), tx(1, slot=10, ms=5)], [meta(8, 10, 5 * HOUR, 9), meta(4, 11, 50, 2), tx(5, slot=11, ms=7, signature=b"T")]]
    seen = set()
    for number, order in enumerate([parts, parts[::-1], [parts[1], parts[2], parts[0]]]):
        root = f"file://{tmp_path}/{number}"
        for part in order:
            ingest.ingest_batch(events(*part), root)
        seen.add(tuple(str(sorted((r.timestamp, r.slot) for r in stored(spark, root, t).collect())) for t in ("transactions", "account_updates")) + (str(sorted(r.timestamp for r in stored(spark, root, "transaction_program_ids").collect())),))
    assert len(seen) == 1
    (tables,) = seen
    assert str((at(5 * HOUR), 10)) in tables[0] and str((at(50), 11)) in tables[0] and str((at(4), 12)) in tables[1]


def test_a_move_that_failed_is_completed(spark, root, events, monkeypatch):
    ingest.ingest_batch(events(*five()), root)
    times = spark.createDataFrame([(10 + k, at(DAY + k)) for k in range(5)], "slot long, block_time timestamp")
    true_drop, calls = writers.drop_folder, []

    def fail(*args):
        calls.append(args)
        if len(calls) == 2:  # the programs have moved, the transactions are in both places
            raise RuntimeError("lost")
        true_drop(*args)

    monkeypatch.setattr(writers, "drop_folder", fail)
    with pytest.raises(RuntimeError):
        late_times.correct_times(times, root)
    assert stored(spark, root, "transactions").count() == 10
    late_times.correct_times(times, root)
    assert stored(spark, root, "transactions").count() == 5 and stored(spark, root, "transaction_program_ids").count() == 10
    assert stored(spark, root, "transactions").where(F.col("timestamp") < F.lit(at(DAY))).count() == 0


def test_only_buckets_that_may_hold_a_signature_are_read(spark, root, events):
    for day in range(3):
        ingest.ingest_batch(events(*[tx(k, slot=100_000 * day + k, ms=day * DAY, signature=bytes([day, k])) for k in range(3)]), root)
    assert spoil(root, "transactions", ["2024-01-02"]) == 2
    again = events(*[tx(k, slot=100_000 + k, ms=9 * DAY, signature=bytes([1, k])) for k in range(3)], tx(9, slot=700_000, ms=9 * DAY, signature=b"new"))
    assert ingest.ingest_batch(again, root)["transaction_rows"] == 1


def test_index_entries_of_dropped_buckets_go(spark, root, events):
    ingest.ingest_batch(events(*five(), tx(9, slot=20, ms=DAY, signature=b"x")), root)
    index = key_index.by_signature(root)
    assert index.stored(spark).count() == 6
    writers.prune(spark, root, "transactions", at(HOUR))
    index.compact(spark, list(writers.folders(spark, f"{root}/transactions")))
    assert index.stored(spark).count() == 1
    assert ingest.ingest_batch(events(*five(DAY)), root)["transaction_rows"] == 5


def test_held_stream_waits_and_times_out(spark, tmp_path):
    schema = "slot long, observed_at timestamp, block_time timestamp"
    rows, times = f"file://{tmp_path}/rows", f"file://{tmp_path}/times"

    def run():
        left, right = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(p) for p in (rows, times))
        held = late_times.held_for_block_time(left.drop("block_time"), right, "1 minute")
        held.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
        return sorted((r.slot, r.timestamp) for r in spark.read.schema("slot long, timestamp timestamp").parquet(f"file://{tmp_path}/out").collect())

    def land(path, *new):
        spark.createDataFrame(list(new), schema).coalesce(1).write.mode("append").parquet(path)

    land(rows, (1, at(0), None), (2, at(10), None))
    land(times, (9, at(0), at(1)))
    assert run() == []
    land(times, (1, at(30_000), at(777)))
    assert run() == [(1, at(777))]
    land(rows, (3, at(HOUR), None))
    land(times, (9, at(HOUR), at(1)))
    run()
    land(times, (9, at(HOUR + 1), at(1)))
    assert run() == [(1, at(777)), (2, at(10))]


def test_minute_view_equals_a_full_recompute(spark, root, events):
    batches = [[slot(k, k + 1, "finalized", k, ms=k * 20_000) for k in range(12)], [slot(20, 5, "dead", 1, ms=80_000), slot(21, 9, "finalized", 2, ms=160_000)], [slot(30, 40, "finalized", 30, ms=2 * DAY)], [slot(31, 40, "dead", 30, ms=2 * DAY)]]
    from tallyflow.operators.project import slot_rows

    for batch in batches:
        rows = slot_rows(events(*batch))
        writers.upsert_last(rows, root, "slots")
        for _ in range(2):
            minute_view.refresh(rows, root)
        whole = health.slot_health(stored(spark, root, "slots"), F.lit(at(3 * DAY)), "10 days").collect()
        assert sorted(minute_view.stored_health(spark, root, F.lit(at(3 * DAY)), "10 days").collect(), key=str) == sorted(whole, key=str)
    assert "2024-01-03" not in str(list(writers.folders(spark, f"{root}/slot_health_1m")))
    assert len(minute_view.stored_health(spark, root, F.lit(at(3 * DAY)), "1 hour").collect()) == 0


def test_days_that_a_batch_does_not_touch_are_not_read(spark, root, events):
    from tallyflow.operators.project import slot_rows

    first, second = (slot_rows(events(slot(k, k + 1, "finalized", k, ms=k * DAY))) for k in range(2))
    for rows in (first, second):
        writers.upsert_last(rows, root, "slots")
        minute_view.refresh(rows, root)
    assert spoil(root, "slots", ["2024-01-02"]) == 1 and spoil(root, "slot_health_1m", ["2024-01-02"]) == 1
    assert minute_view.refresh(second, root) == 1


def test_metrics_have_hours_and_are_pruned(spark, root, events):
    for k, ms in enumerate((0, 10, 2 * HOUR, 30 * HOUR)):
        for _ in range(2):
            ingest.ingest_batch(events(account(k, ms=ms, version=k)), root, batch_id=k, max_age="1 day" if k == 3 else None)
    rows = writers.read_folders(spark, f"{root}/pipeline_metrics").collect()
    assert sorted((r.batch_id, r.bucket, r.account_rows) for r in rows) == [(3, "2024-01-02 18:00:00", 1)]


def test_programs_have_their_own_retention(spark, root, events):
    ingest.ingest_batch(events(tx(1, slot=1, ms=0, signature=b"a"), tx(2, slot=2, ms=2 * HOUR, signature=b"b")), root, max_age="1 day")
    assert stored(spark, root, "transactions").count() == 2
    assert {bytes(r.signature) for r in stored(spark, root, "transaction_program_ids").collect()} == {b"b"}


def test_programs_of_stored_transactions_are_not_read(spark, root, events):
    ingest.ingest_batch(events(*five()), root)
    assert spoil(root, "transaction_program_ids", []) > 0
    assert ingest.ingest_batch(events(*five()), root)["transaction_rows"] == 0


def test_programs_of_a_failed_write_are_replaced(spark, root, events, monkeypatch):
    true_write = writers.write_buckets

    def fail(df, path, table, *rest):
        if table == "transactions":
            raise RuntimeError("lost")
        true_write(df, path, table, *rest)

    with monkeypatch.context() as patched:
        patched.setattr(writers, "write_buckets", fail)
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(events(*five()), root)
    assert stored(spark, root, "transaction_program_ids").count() == 10
    times = spark.createDataFrame([(10 + k, at(k * DAY)) for k in range(5)], "slot long, block_time timestamp")
    report = ingest.ingest_batch(events(*five()), root, block_times=times)
    assert (report["transaction_rows"], report["program_rows"]) == (5, 10)
    programs = stored(spark, root, "transaction_program_ids").collect()
    assert sorted((bytes(r.signature)[0], r.timestamp, r.position) for r in programs) == [(k, at(k * DAY), p) for k in range(5) for p in (0, 1)]


def test_a_move_inside_a_bucket_writes_it_once(spark, root, events, monkeypatch):
    ingest.ingest_batch(events(*five(), tx(9, slot=20, ms=DAY, signature=b"x")), root)
    calls, true_write = [], writers.write_buckets
    monkeypatch.setattr(writers, "write_buckets", lambda df, path, table, *rest: calls.append(table) or true_write(df, path, table, *rest))
    times = spark.createDataFrame([(10 + k, at(1000 + k)) for k in range(3)] + [(13, at(DAY + 5))], "slot long, block_time timestamp")
    assert late_times.correct_times(times, root)["transactions"] == 4
    # the first bucket with its new times, the other day by an addition, the first again without the row that left
    assert calls == ["transaction_program_ids"] * 3 + ["transactions"] * 3
    calls.clear()
    assert late_times.correct_times(times.where("slot <> 13").withColumn("block_time", F.col("block_time") + F.expr("INTERVAL 1 SECOND")), root)["transactions"] == 3
    assert calls == ["transaction_program_ids", "transactions"]
    rows = {bytes(r.signature)[0]: r.timestamp for r in stored(spark, root, "transactions").collect()}
    assert rows == {0: at(2000), 1: at(2001), 2: at(2002), 3: at(DAY + 5), 4: at(4), ord("x"): at(DAY)}
    assert stored(spark, root, "transaction_program_ids").count() == stored(spark, root, "transaction_program_ids").select("signature", "position").distinct().count()


def test_listing_leaves_the_session_as_it_was(spark, root, events):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    ingest.ingest_batch(events(*[tx(k, slot=k, ms=k * DAY, signature=bytes([k])) for k in range(6)]), root)
    path = f"{root}/transactions"
    have = sorted(writers.folders(spark, path))
    assert [n[:10] for n in have] == [f"2024-01-0{k + 1}" for k in range(6)]
    for names in (have, have[1:], have[:2]):  # all, all but one, few of them
        assert sorted(r.bucket for r in writers.read_folders(spark, path, names=names).collect()) == names
    assert spark.conf.get(name) == before
