"""Many thin buckets share the folder of their month; rows, keys, moves, retention and reads are those of single buckets."""

import pytest
from pyspark.sql import functions as F
from test_late_times import DAY, HOUR, events, five, root, stored  # noqa: F401
from test_operators import at, slot, tx
from tallyflow.operators import health
from tallyflow.operators.project import slot_rows
from tallyflow.sources import readers, writers
from tallyflow.streaming import ingest, late_times, layout, minute_view

BOTH = ("transactions", "transaction_program_ids")


@pytest.fixture(autouse=True)
def few(monkeypatch):
    monkeypatch.setattr(writers, "FEW", 2)


def names(spark, root, table):  # noqa: F811
    return sorted(writers.folders(spark, f"{root}/{table}"))


def times_of(spark, root):  # noqa: F811
    programs = sorted((bytes(r.signature)[0], r.timestamp) for r in stored(spark, root, "transaction_program_ids").where("position = 1").collect())
    rows = sorted((bytes(r.signature)[0], r.timestamp) for r in stored(spark, root, "transactions").collect())
    assert programs == rows
    return dict(rows) if len(rows) == len(dict(rows)) else rows


def test_thin_buckets_of_a_batch_share_folders_and_move(spark, root, events, monkeypatch):  # noqa: F811
    batch = events(*[tx(k, slot=10 + k, ms=k * DAY, signature=bytes([k]) * 64, programs=(b"P", b"Q")) for k in range(5)])
    ingest.ingest_batch(batch, root)
    assert [names(spark, root, t) for t in BOTH] == [["2024-01"]] * 2
    # one moves inside the month, three to another, one stays; the run fails before the old rows go
    times = spark.createDataFrame([(10, at(HOUR)), (11, at(40 * DAY)), (12, at(41 * DAY)), (13, at(42 * DAY))], "slot long, block_time timestamp")
    true_write, appended = writers.write_buckets, []

    def fail(df, path, table, mode, *rest):
        if mode == "overwrite" and table == "transactions" and appended:
            raise RuntimeError("lost")
        appended.extend([table] if mode == "append" and table == "transactions" else [])
        true_write(df, path, table, mode, *rest)

    with monkeypatch.context() as patched:
        patched.setattr(writers, "write_buckets", fail)
        with pytest.raises(RuntimeError):
            late_times.correct_times(times, root)
    assert stored(spark, root, "transactions").count() == 8
    for _ in range(2):
        late_times.correct_times(times, root)
        assert times_of(spark, root) == {0: at(HOUR), 1: at(40 * DAY), 2: at(41 * DAY), 3: at(42 * DAY), 4: at(4 * DAY)}
    assert [names(spark, root, t) for t in BOTH] == [["2024-01", "2024-02"]] * 2
    assert ingest.ingest_batch(batch, root, block_times=times)["transaction_rows"] == 0


def test_a_shared_folder_is_read_pruned_and_compacted_by_its_times(spark, root, events, monkeypatch):  # noqa: F811
    monkeypatch.setattr(writers, "SHARED_ROWS", 2)
    rows = [tx(k, slot=10 + k, ms=k * DAY, signature=bytes([k]) * 64, programs=(b"P", b"Q")) for k in range(5)]
    ingest.ingest_batch(events(*rows), root)
    ingest.ingest_batch(events(tx(5, slot=15, ms=5 * DAY, signature=bytes([5]) * 64, programs=(b"P", b"Q"))), root)  # a few rows join what the month began with
    assert [names(spark, root, t) for t in BOTH] == [["2024-01"]] * 2
    assert sorted(bytes(r.signature)[0] for r in readers.read_table(spark, root, "transactions", at(DAY), at(3 * DAY)).collect()) == [1, 2]
    assert layout.layout_plan(spark, root, "transactions", at(29 * DAY)).count() == 0
    assert [(r.bucket, r.files > 1) for r in layout.layout_plan(spark, root, "transactions", at(40 * DAY)).collect()] == [("2024-01", True)]
    assert layout.run_layout(spark, root, at(40 * DAY), ["transactions"]) == {"transactions": 1}
    assert layout.layout_plan(spark, root, "transactions", at(40 * DAY)).count() == 0  # once is enough
    assert writers.prune(spark, root, "transactions", at(2 * DAY + 1)) == 3
    assert sorted(bytes(r.signature)[0] for r in stored(spark, root, "transactions").collect()) == [3, 4, 5]


def test_minute_view_in_shared_folders_equals_a_full_recompute(spark, root, events):  # noqa: F811
    first = [slot(k, k + 1, "finalized", k, ms=k * DAY) for k in range(4)]
    for batch in (first, [slot(9, 3, "dead", 1, ms=2 * DAY), slot(10, 30, "finalized", 28, ms=2 * DAY + HOUR)]):
        rows = slot_rows(events(*batch))
        writers.upsert_last(rows, root, "slots")
        minute_view.refresh(rows, root)
        whole = health.slot_health(stored(spark, root, "slots"), F.lit(at(5 * DAY)), "10 days").collect()
        assert sorted(minute_view.stored_health(spark, root, F.lit(at(5 * DAY)), "10 days").collect(), key=str) == sorted(whole, key=str)
    assert [names(spark, root, t) for t in ("slots", "slot_health_1m")] == [["2024-01"]] * 2
    assert len(minute_view.stored_health(spark, root, F.lit(at(3 * DAY)), "2 hours").collect()) == 1


def test_other_months_keep_their_buckets(spark, root, events):  # noqa: F811
    ingest.ingest_batch(events(*five()), root)
    ingest.ingest_batch(events(*[tx(k, slot=10 + k, ms=k * DAY, signature=bytes([k, 1])) for k in range(5)]), root)
    assert all(len(n) > writers.MONTH for n in names(spark, root, "transactions")) and stored(spark, root, "transactions").count() == 10
