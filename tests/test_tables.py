"""Writes, retention, replay and the stream, on Parquet tables in a temporary folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_operators import T0, account, at, meta, slot, tx
from tallyflow.functions.columns import key_text
from tallyflow.operators import decoders
from tallyflow.operators.lookup import latest_checkpoint
from tallyflow.schemas import BLOCK, BRONZE
from tallyflow.sources import readers, writers
from tallyflow.streaming import ingest

DAY = 86_400_000


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/tables"


@pytest.fixture
def events(spark):
    return lambda *rows: spark.createDataFrame(list(rows), BRONZE)


def stored(spark, root, table):
    return spark.read.parquet(f"{root}/{table}")


def test_ingest_stores_each_row_once_and_checkpoints(spark, root, events):
    logs = ["Program A invoke [1]", "Program B invoke [2]", "Program C invoke [2]"]
    batch = events(account(1), account(2, ms=3), tx(3, programs=(b"P", b"Q"), logs=logs), slot(4), slot(5, status="confirmed"), meta(6, 10, 500, 20))
    for _ in range(2):
        report = ingest.ingest_batch(batch, root, [decoders.ProgramActivity([key_text(b"P")]), decoders.CallEdges()])
    assert report["account_rows"] == 0 and report["received"] == 6
    accounts = stored(spark, root, "account_updates").collect()
    assert [(r.timestamp, r.slot) for r in accounts] == [(at(500), 10)]
    assert stored(spark, root, "transactions").count() == 1
    assert stored(spark, root, "transaction_program_ids").count() == 2
    assert [r.status for r in stored(spark, root, "slots").collect()] == ["confirmed"]
    decoded = stored(spark, root, "custom_decoded_events").collect()
    assert sorted((r.decoder_name, r.event_index) for r in decoded) == [("cpi-edge", 2), ("program-activity", 0), ("program-activity", 0), ("program-activity", 0)]
    checkpoint = latest_checkpoint(stored(spark, root, "ingestion_checkpoints")).first()
    assert (checkpoint.last_processed_slot, checkpoint.last_observed_at) == (10, at(20))
    assert stored(spark, root, "pipeline_metrics").count() == 1


def test_upsert_keeps_the_last_and_other_buckets(spark, root, events):
    from tallyflow.operators.project import slot_rows

    assert writers.upsert_last(slot_rows(events(slot(1, 7), slot(2, 8, ms=2 * DAY))), root, "slots") == 2
    assert writers.upsert_last(slot_rows(events(slot(3, 7, "finalized", 6))), root, "slots") == 1
    got = sorted((r.slot, r.parent_slot, r.status) for r in stored(spark, root, "slots").collect())
    assert got == [(7, 6, "finalized"), (8, None, "processed")]


def test_retention_drops_old_buckets_and_rewrites_the_edge(spark, root, events):
    from tallyflow.operators.project import account_rows

    rows = account_rows(events(account(1, ms=-2 * DAY), account(2, ms=-100, version=2), account(3, ms=0, version=3), account(4, ms=DAY, version=4)))
    writers.insert_if_absent(rows, root, "account_updates")
    assert writers.prune(spark, root, "account_updates", at(0)) == 2
    assert sorted(r.write_version for r in stored(spark, root, "account_updates").collect()) == [3, 4]
    assert writers.prune(spark, root, "account_updates", at(0)) == 0
    back = readers.read_table(spark, root, "account_updates", since=str(at(1)), until=str(at(2 * DAY)))
    assert [r.write_version for r in back.collect()] == [4]


def test_clustered_files_are_sorted_and_compacted(spark, root):
    rows = spark.createDataFrame([(T0, b"s", bytes([i % 7]), i) for i in range(50)], "timestamp timestamp, signature binary, program_id binary, position short")
    for _ in range(2):
        writers.write_clustered(rows, root, "transaction_program_ids")
    buckets = [r.bucket for r in stored(spark, root, "transaction_program_ids").select(F.col("bucket").cast("string").alias("bucket")).distinct().collect()]
    writers.compact(spark, root, "transaction_program_ids", buckets)
    df = stored(spark, root, "transaction_program_ids")
    assert df.count() == 100 and len(df.inputFiles()) == 1
    order = [bytes(r.program_id) for r in df.collect()]
    assert order == sorted(order)


def test_backfill_adds_what_is_absent(spark, root, events):
    block = spark.createDataFrame([(10, 60, 9, None, None, None, [(([key_text(b"sig")], ([key_text(b"k")], [(0,)])), (None, 5, []))], None), (11, 61, 10, None, None, None, [], None)], BLOCK)
    for expected in (1, 0):
        report = ingest.apply_backfill(block, root, T0)
        assert report == {"slots": 2, "transactions": expected, "programs": expected}
    assert sorted((r.slot, r.parent_slot, r.status) for r in stored(spark, root, "slots").collect()) == [(10, 9, "confirmed"), (11, 10, "confirmed")]


def test_live_transaction_is_not_backfilled_again(spark, root, events):
    minute = dt.datetime(1970, 1, 1, 0, 1)
    live = events(tx(1, slot=10, signature=bytes(range(64)), programs=(bytes(range(32)),)), (2, "block_meta", 10, at(0), None, None, None, (minute, 1)))
    ingest.ingest_batch(live, root)
    text = key_text(bytes(range(64))), key_text(bytes(range(32)))
    block = spark.createDataFrame([(10, 60, 9, None, None, None, [(([text[0]], ([text[1]], [(0,)])), (None, 5, []))], None)], BLOCK)
    assert ingest.apply_backfill(block, root, T0) == {"slots": 1, "transactions": 0, "programs": 0}
    assert [bytes(r.signature) for r in stored(spark, root, "transactions").collect()] == [bytes(range(64))]


def test_nothing_is_left_beside_the_tables(spark, root, events, tmp_path):
    from tallyflow.sources.writers import scratch_path

    before = set((p := __import__("pathlib").Path(scratch_path(spark, "x").removeprefix("file://")).parents[1]).iterdir())
    for _ in range(2):
        ingest.ingest_batch(events(account(1), tx(2), slot(3)), root)
    assert {p.name for p in (tmp_path / "tables").iterdir()} == {"account_updates", "transactions", "transaction_program_ids", "slots", "pipeline_metrics", "ingestion_checkpoints", "transactions_by_signature", "rows_by_slot"}
    assert set(p.iterdir()) == before


def test_buckets_have_their_units_and_orders(spark, root, events):
    from tallyflow.operators.project import account_rows, slot_rows

    writers.insert_if_absent(account_rows(events(account(1, ms=3_600_001), account(2, version=2), account(3, ms=5, version=3), account(4, ms=7_200_000, version=4))), root, "account_updates")
    writers.upsert_last(slot_rows(events(slot(1, 7), slot(2, 8, ms=7_200_000))), root, "slots")
    names = lambda table: sorted({str(r[0]) for r in stored(spark, root, table).select("bucket").collect()})
    assert names("account_updates") == ["2024-01-01 12:00:00", "2024-01-01 14:00:00"] and len(names("slots")) == 1
    rows = [r.timestamp for r in stored(spark, root, "account_updates").where("bucket = '2024-01-01 12:00:00'").coalesce(1).collect()]
    assert rows == sorted(rows, reverse=True)


def test_failed_batch_keeps_its_position(spark, root, events, tmp_path, monkeypatch):
    landing = f"file://{tmp_path}/landing"
    events(account(1), account(2, version=2), tx(3)).coalesce(1).write.parquet(landing)
    true_write, calls = writers.write_checkpoint, []

    def fail_once(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return true_write(*args)

    monkeypatch.setattr(writers, "write_checkpoint", fail_once)
    source = lambda: readers.read_events(spark, landing, streaming=True, max_files=1)
    with pytest.raises(Exception, match="lost"):
        ingest.start_ingest(source(), root, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert not writers.exists(spark, f"{root}/ingestion_checkpoints")
    ingest.start_ingest(source(), root, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert stored(spark, root, "account_updates").count() == 2 and stored(spark, root, "transactions").count() == 1
    assert stored(spark, root, "ingestion_checkpoints").count() == 1
    events(account(4, version=4)).coalesce(1).write.mode("append").parquet(landing)
    ingest.start_ingest(source(), root, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert stored(spark, root, "account_updates").count() == 3


def test_unreadable_documents_are_set_aside(spark, tmp_path):
    (tmp_path / "blocks.json").write_text('{"slot": 1, "blockTime": 60, "transactions": []}\n{"slot": 2, "blockTi\n')
    df = readers.read_blocks(spark, f"file://{tmp_path}/blocks.json").cache()
    assert df.where("_corrupt_record IS NULL").count() == 1 and df.where("_corrupt_record IS NOT NULL").count() == 1


def test_stream_drops_repeats_within_the_watermark(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.createDataFrame([(i % 5, at(i)) for i in range(20)], "k long, timestamp timestamp").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("k long, timestamp timestamp").parquet(path)
    ingest.dedup_stream(stream, ["k"], "1 hour").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5


def test_later_batches_know_earlier_block_times(spark, root, events):
    times = spark.createDataFrame([(10, at(900))], "slot long, block_time timestamp")
    ingest.ingest_batch(events(account(1), account(2, slot=11, ms=7)), root, block_times=times, max_age="1 hour")
    got = {r.slot: r.timestamp for r in stored(spark, root, "account_updates").collect()}
    assert got == {10: at(900), 11: at(7)}


def test_day_is_in_milliseconds():
    assert at(DAY) - T0 == dt.timedelta(days=1)


def test_a_landing_of_several_files_is_one_batch(spark, sf, monkeypatch, tmp_path):
    from tallyflow.plans import catalog

    monkeypatch.setattr(catalog, "LANDED_POSITIONS", 200)
    root = catalog._restarted(spark, sf)
    rows = writers.read_folders(spark, f"{root}/pipeline_metrics").orderBy("batch_id").collect()
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert [r.batch_id for r in rows] == [0, 1, 2] and all(r.received >= n // 3 for r in rows)
    assert spark.read.parquet(f"{root}-landing").select("lane").distinct().count() == n // 200 > 1
