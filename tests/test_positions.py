"""The interval set of positions, bounded replay, and sketches that add up."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F
from tallyflow.operators import sketches
from tallyflow.streaming import positions
from tallyflow.streaming.positions import Batch


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/tables"


@pytest.fixture
def add(spark, root):
    return lambda *seqs, part=10: positions.add_positions(spark.createDataFrame([(s,) for s in seqs], "seq long"), root, part)


def stored(spark, root):
    return sorted((r.low, r.high) for r in positions.intervals(spark, root).collect())


def test_batches_in_any_order_merge(spark, root, add):
    present = [k for k in range(60) if k not in (0, 17, 18, 39, 40, 59)]
    random.Random(1).shuffle(present)
    for k in range(0, 54, 9):
        add(*present[k : k + 9], *present[:2])
    assert stored(spark, root) == [(1, 9), (10, 16), (19, 19), (20, 29), (30, 38), (41, 49), (50, 58)]
    holes = [(r.first_missing, r.last_missing, r.missing) for r in positions.gap_set(spark, root, 2).collect()]
    assert sorted(holes) == [(17, 18, 2), (39, 40, 2)]
    add(17, 18, None)
    assert len(positions.gap_set(spark, root).collect()) == 1


def test_a_batch_touches_its_parts_only(spark, root, add):
    add(1, 2, 35)
    for file in pathlib.Path(root.removeprefix("file://")).glob("present_positions/part=0/*.parquet"):
        file.write_bytes(b"not parquet")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert add(36, 41) == 2
    assert positions.next_batch(spark, root, 34, 2, 10) == Batch(35, 36, "full")


def test_replay_stops_at_the_first_gap_and_knows_the_end(spark, root, add):
    def after(last, most):
        return positions.next_batch(spark, root, last, most, 10)

    assert after(None, 5) == Batch(0, -1, "end")
    add(*range(25), *range(27, 30))
    assert after(None, 5) == Batch(0, 4, "full") and after(4, 10) == Batch(5, 14, "full")
    assert after(14, 100) == Batch(15, 24, "gap") and after(24, 100) == Batch(25, 24, "gap")
    assert after(26, 3) == Batch(27, 29, "full") and after(26, 4) == Batch(27, 29, "end") and after(29, 4) == Batch(30, 29, "end")
    assert after(None, 0) == Batch(0, -1, "full")
    events = spark.range(40).withColumnRenamed("id", "seq")
    assert [r.seq for r in positions.replay(events, after(26, 9)).collect()] == [27, 28, 29]
    add(25, 26)
    assert after(14, 100) == Batch(15, 29, "end")
    plan = sorted((r.first, r.last, r.ends) for r in positions.replay_plan(spark, root, 4).collect())
    assert plan == [(0, 3, "full"), (4, 7, "full"), (8, 9, "full"), (10, 13, "full"), (14, 17, "full"), (18, 19, "full"), (20, 23, "full"), (24, 27, "full"), (28, 29, "end")]


def test_no_positions(spark, root):
    assert positions.gap_set(spark, root).count() == 0 and positions.replay_plan(spark, root, 3).count() == 0
    assert positions.add_positions(spark.createDataFrame([], "seq long"), root) == 0


def test_sketches_add_up(spark):
    rows = spark.range(20_000).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("observed_at"), (F.col("id") % 500).alias("pubkey"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("owner")
    ).withColumn("block_time", F.when(F.col("pubkey") != 7, F.col("observed_at") - F.make_dt_interval(secs=F.col("pubkey"))))
    hourly = sketches.lag_sketches(rows)
    assert hourly.count() == 6
    (whole,) = sketches.merged_lags(hourly, [0.5, 0.99]).collect()
    assert whole.lags == 19_960 and abs(whole.lag_p50_ms - 250_000) <= 3000 and abs(whole.lag_p99_ms - 494_000) <= 3000
    assert sketches.merged_lags(hourly, [0.5], "day").count() == 1
    accounts = sketches.account_sketches(rows, time="observed_at")
    (day,) = sketches.merged_accounts(accounts, "day").collect()
    assert day.updates == 20_000 and abs(day.accounts - 500) <= 15
    assert {(r.owner, round(r.accounts / 250)) for r in sketches.merged_accounts(accounts, by=["owner"]).collect()} == {("a", 1), ("b", 1)}


def test_long_logs_take_linear_time(spark):
    from tallyflow.operators import decoders

    lines = [f"Program P{k % 5} invoke [{k % 4 + 1}]" if k % 3 else f"Program P{k % 5} success" for k in range(10_000)]
    df = spark.createDataFrame([(1, 2, lines, True)], "signature long, slot long, log_messages array<string>, success boolean").withColumn("timestamp", F.current_timestamp())
    edges = decoders.call_edges(df).orderBy("at").collect()
    latest, wanted = {}, []
    for at, line in enumerate(lines):
        if "invoke" in line:
            name, depth = line.split()[1], int(line[-2])
            if depth > 1 and depth - 1 in latest:
                wanted.append((at, latest[depth - 1], name, depth, True))
            latest[depth] = name
    assert [(e.at, e.caller, e.callee, e.depth, e.success) for e in edges] == wanted


def test_call_edges_share_the_pass_over_events(spark):
    from test_operators import tx
    from tallyflow.operators import decoders
    from tallyflow.schemas import BRONZE

    df = spark.createDataFrame([tx(1, logs=["Program A invoke [1]", "Program B invoke [2]", "Program B failed: x"])], BRONZE)
    rows = decoders.decode(df, [decoders.CallEdges(), decoders.ProgramActivity(["P"])])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + rows._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1
    assert [r.payload for r in rows.where("decoder_name = 'cpi-edge'").collect()] == ['{"caller":"A","callee":"B","depth":2,"success":false}']


def test_small_parts_share_a_folder(spark, root):
    def add(*seqs):
        return positions.add_positions(spark.createDataFrame([(s,) for s in seqs], "seq long"), root, 10, 10)

    assert add(*range(0, 95, 2), 203) == 2 and add(*range(1, 95, 2)) == 1
    assert sorted(p.name for p in pathlib.Path(root.removeprefix("file://"), "present_positions").glob("part=*")) == ["part=0", "part=20"]
    assert stored(spark, root) == [(10 * k, min(10 * k + 9, 94)) for k in range(10)] + [(203, 203)]
    assert positions.next_batch(spark, root, 14, 20, 10, 10) == Batch(15, 34, "full")
    assert positions.next_batch(spark, root, 89, 20, 10, 10) == Batch(90, 94, "gap")
