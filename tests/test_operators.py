"""Operators on literal rows: the cases the stream's rules define."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tallyflow.functions.columns import key_text
from tallyflow.operators import decoders, enrich, gaps, health, keyed, lookup, metrics, project, watch
from tallyflow.schemas import BLOCK, BRONZE, RAW_TX
from tallyflow.sources import readers

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def account(seq, slot=10, owner=b"P", pubkey=b"A", ms=0, version=1, lamports=5):
    return (seq, "account", slot, at(ms), (pubkey, owner, lamports, version, b""), None, None, None)


def tx(seq, slot=10, signature=b"S", programs=(b"P",), accounts=(b"A",), ms=0, fee=5, success=True, logs=()):
    return (seq, "transaction", slot, at(ms), None, (signature, fee, success, list(accounts), list(programs), list(logs)), None, None)


def slot(seq, number=10, status="processed", parent=None, ms=0):
    return (seq, "slot", number, at(ms), None, None, (parent, status), None)


def meta(seq, number=10, time_ms=0, ms=0):
    return (seq, "block_meta", number, at(ms), None, None, None, (at(time_ms), 1))


@pytest.fixture
def events(spark):
    return lambda *rows: spark.createDataFrame(list(rows), BRONZE)


P, Q, A = map(key_text, (b"P", b"Q", b"A"))


def watch_of(spark, *rows):
    return readers.watchlist_of(spark, rows)


@pytest.mark.parametrize("in_row", [1000, 0])
def test_program_watch_with_slots_and_account_watch(spark, events, monkeypatch, in_row):
    monkeypatch.setattr(watch, "IN_ROW", in_row)
    df = events(account(1), tx(2, programs=(b"P", b"T")), slot(3), slot(4, status="confirmed", ms=500), account(5, owner=b"S", pubkey=b"B"))
    got = watch.watched(df, watch_of(spark, ("p", "program", P, True, False)))
    assert sorted(r.seq for r in got.collect()) == [1, 2, 3, 4]
    got = watch.watched(df, watch_of(spark, ("p", "account", A, False, False)))
    assert sorted(r.seq for r in got.collect()) == [1, 2]
    assert watch.watched(df, watch_of(spark).limit(0)).count() == 5


@pytest.mark.parametrize("in_row", [1000, 0])
def test_watch_tags_each_protocol(spark, events, monkeypatch, in_row):
    monkeypatch.setattr(watch, "IN_ROW", in_row)
    df = events(account(1), tx(2, programs=(b"P", b"Q")), slot(3))
    both = watch_of(spark, ("a", "program", P, True, False), ("b", "program", Q, False, False), ("b", "program", P, False, False))
    got = watch.watched(df, both, tag=True)
    assert sorted((r.seq, r.protocol) for r in got.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")]


OWNER, OTHER = bytes(range(32)), bytes(range(1, 33))


@pytest.mark.parametrize("in_row", [1000, 0])
def test_keys_of_32_bytes_are_compared_as_bytes(spark, events, monkeypatch, in_row):
    monkeypatch.setattr(watch, "IN_ROW", in_row)
    df = events(account(None, owner=OWNER), account(None, owner=OTHER, pubkey=OWNER), tx(3, programs=(OTHER, OWNER)), tx(3, signature=b"Z", accounts=(OWNER,)), account(5, owner=b"amm-program"))
    entry = watch_of(spark, ("p", "program", f" {key_text(OWNER)} ", False, False))
    assert watch.validate_watchlist(entry).first().valid
    assert sorted((r.seq or 0, bytes(r.account.owner) if r.account else bytes(r.transaction.signature)) for r in watch.watched(df, entry).collect()) == [(0, OWNER), (3, b"S")]
    by_account = watch_of(spark, ("p", "account", key_text(OWNER), False, False), ("q", "account", key_text(OWNER), False, False))
    assert watch.watched(df, by_account).count() == 2 and watch.watched(df, by_account, tag=True).count() == 4
    assert [r.seq for r in watch.watched(df, watch_of(spark, ("p", "program", "amm-program", False, False))).collect()] == [5]
    rows = decoders.decode(df, [decoders.ProgramActivity([key_text(OWNER), "amm-program"])]).collect()
    assert sorted(r.record_key for r in rows) == sorted([A, A, key_text(b"S")])


def test_rollup_compares_bytes(spark, events):
    df = events(account(1, owner=OWNER, lamports=10**9), tx(2, programs=(OWNER, OTHER)), tx(3, signature=b"Z", programs=(b"x",)))
    rows = project.transaction_rows(df)
    got = metrics.protocol_rollup(rows, project.program_rows(rows), project.account_rows(df), watch_of(spark, ("p", "program", key_text(OWNER), False, False), ("p", "program", key_text(OTHER), False, False))).collect()
    assert [(r.protocol, r.transactions, r.value_locked, r.accounts) for r in got] == [("p", 1, 1.0, 1)]


def test_merged_watchlists_hold_each_key_once(spark):
    one, two = watch_of(spark, ("a", "program", P, False, False)), watch_of(spark, ("b", "program", P, True, False), ("b", "account", A, False, None))
    got = watch.merge_watchlists(one, readers.watchlist(two)).collect()
    assert [(r.kind, r.key, r.include_slots, r.include_blocks_meta) for r in got] == [("account", A, False, True), ("program", P, True, False)]


def test_rows_take_block_time_and_else_arrival(spark, events):
    df = events(account(1, slot=5), account(2, slot=6, ms=70), tx(3, slot=5), slot(4, 5, ms=9), meta(5, 5, 1000), meta(6, 5, 2000))
    times = project.block_times(df)
    assert [(r.slot, r.block_time) for r in times.collect()] == [(5, at(2000))]
    assert sorted((r.seq, r.timestamp) for r in project.account_rows(df, times).collect()) == [(1, at(2000)), (2, at(70))]
    assert [r.timestamp for r in project.transaction_rows(df, times).collect()] == [at(2000)]
    assert [r.timestamp for r in project.slot_rows(df).collect()] == [at(9)]


def test_newest_block_times_stay(spark):
    times = spark.createDataFrame([(s, at(1000 * s)) for s in (1, 2, 3, 4)], "slot long, block_time timestamp")
    assert sorted(r.slot for r in enrich.newest_slots(times, 3).collect()) == [2, 3, 4]


def test_flattening(spark):
    keys = [b"a", b"b", b"c"]
    rows = [
        (b"1", (None, 7, ["x"]), (keys, [(2,), (0,), (9,), (2,)])),
        (b"2", ("boom", None, None), (keys, [])),
        (b"3", None, (keys, [(1,)])),
        (b"4", (None, 1, []), None),
    ]
    got = project.flatten_transactions(spark.createDataFrame(rows, RAW_TX)).orderBy("signature").collect()
    assert [(r.success, r.fee, [bytes(p) for p in r.program_ids], r.log_messages) for r in got] == [
        (True, 7, [b"c", b"a"], ["x"]), (False, 0, [], []), (False, 0, [b"b"], []), (True, 1, [], []),
    ]


def test_program_positions_and_back(spark, events):
    tx_rows = project.transaction_rows(events(tx(1, programs=(b"P", b"Q")), tx(2, signature=b"N", programs=())))
    for base in (0, 1):
        rows = project.program_rows(tx_rows, base).collect()
        assert sorted((bytes(r.program_id), r.position) for r in rows) == [(b"P", base), (b"Q", base + 1)]
    back = project.with_program_ids(tx_rows, project.program_rows(tx_rows)).collect()
    assert {bytes(r.signature): [bytes(p) for p in r.program_ids] for r in back} == {b"S": [b"P", b"Q"], b"N": []}


def calls(spark, logs, success=True):
    df = spark.createDataFrame([(T0, 1, "sig", success, logs)], "timestamp timestamp, slot long, signature string, success boolean, log_messages array<string>")
    edges = decoders.call_edges(df)
    return edges, [(r.caller, r.callee, r.depth, r.success) for r in edges.orderBy("at").collect()]


def test_nested_calls(spark):
    logs = [f"Program {p} invoke [{d}]" for d, p in enumerate("ABC", 1)] + [f"Program {p} success" for p in "CBA"]
    assert calls(spark, logs)[1] == [("A", "B", 2, True), ("B", "C", 3, True)]


def test_call_rules(spark):
    assert calls(spark, ["Program B invoke [2]"])[1] == []
    assert calls(spark, [])[1] == []
    stale = ["Program A invoke [1]", "Program A success", "Program D invoke [2]", "Program D failed: custom error"]
    assert calls(spark, stale)[1] == [("A", "D", 2, False)]
    own_flag = ["Program A invoke [1]", "  Program B invoke [2]  ", "Program log: hello", "Program C invoke [ 2]"]
    assert calls(spark, own_flag, success=False)[1] == [("A", "B", 2, False)]
    twice = ["Program A invoke [1]", "Program B invoke [2]", "Program B failed", "Program B invoke [2]", "Program B success"]
    edges, rows = calls(spark, twice)
    assert rows == [("A", "B", 2, True)] * 2
    stored = decoders.call_edges_stored(edges).collect()
    assert [(r["at"], r.depth) for r in stored] == [(1, 2)]


def test_decoders_side_by_side(spark, events):
    logs = ["Program A invoke [1]", "Program B invoke [2]"]
    df = events(account(1), tx(2, logs=logs), account(3, owner=b"other"), slot(4), meta(5))
    got = decoders.decode(df, [decoders.ProgramActivity([P]), decoders.CallEdges()])
    assert sorted((r.decoder_name, r.record_key, r.event_index, r.payload) for r in got.collect()) == [
        ("cpi-edge", key_text(b"S"), 2, '{"caller":"A","callee":"B","depth":2,"success":true}'),
        ("program-activity", A, 0, '"account_update"'), ("program-activity", key_text(b"S"), 0, '"transaction"'),
    ]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decoders_read_events_once_and_lines_once(spark, events, tmp_path):
    path = f"file://{tmp_path}/events"
    events(account(1), tx(2)).write.parquet(path)
    stored = readers.read_events(spark, path)
    several = [decoders.ProgramActivity([P]), decoders.ProgramActivity([Q]), decoders.ProgramActivity(["amm-program"])]
    assert plan_of(decoders.decode(stored, several)).count("FileScan") == 1
    tagged = stored.withColumn("protocol", F.lit("a"))
    assert plan_of(decoders.decode_by_protocol(tagged, {"a": several[:1], "b": several[1:]})).count("FileScan") == 1
    lines = stored.select("slot", F.col("observed_at").alias("timestamp"), "transaction.signature", "transaction.success", "transaction.log_messages")
    assert plan_of(decoders.call_edges(lines)).count("regexp_extract") == 4, "two for calls, two for outcomes, each over every line once"


def test_user_decoder(spark, events):
    def by_fee(signature, fee):
        if fee > 5:
            yield bytes(signature).decode(), 0, str(fee)
            yield bytes(signature).decode(), 1, str(fee + 1)

    df = events(tx(1, fee=9), tx(2, fee=1)).where("kind = 'transaction'")
    got = decoders.decode(df, [decoders.RowDecoder("fees", by_fee, ["transaction.signature", "transaction.fee"])])
    assert sorted((r.timestamp, r.slot, r.decoder_name, r.record_key, r.event_index, r.payload) for r in got.collect()) == [(T0, 10, "fees", "S", 0, "9"), (T0, 10, "fees", "S", 1, "10")]


def test_progress_of_block_times_alone(spark, events):
    df = events(meta(1, 100, 0, 10), meta(2, 101, 100, 120))
    row = metrics.batch_progress(df).first()
    assert (row.max_slot, row.max_observed_at, row.max_block_time) == (101, at(120), at(100))
    assert metrics.batch_progress(df, ("slot",)).first().max_slot is None


def slots_of(spark, *rows):
    return spark.createDataFrame(list(rows), "slot long, parent_slot long, timestamp timestamp, status string")


def test_health_edges(spark):
    minute = dt.timedelta(minutes=1)
    df = slots_of(
        spark, (5, 2, T0, "finalized"), (6, None, T0, "finalized"), (7, 6, T0, "processed"), (8, None, T0 + minute, "finalized"), (9, 8, T0 - 60 * minute, "finalized"), (10, 9, T0 - 59 * minute, "finalized")
    )
    got = {r.bucket: (r.slot_count, r.skipped_slots, r.skip_rate, r.slots_per_second) for r in health.slot_health(df, F.lit(T0)).collect()}
    assert got == {T0: (2, 2, 0.5, 2 / 60), T0 + minute: (1, None, None, 1 / 60), T0 - 59 * minute: (1, 0, 0.0, 1 / 60)}
    summary = health.network_stress(health.slot_health(df, F.lit(T0))).first()
    assert (summary.slot_skip_rate, summary.total_slots_1h, summary.skipped_slots_1h, summary.stress_level, len(summary.buckets)) == (0.0, 4, 2, "normal", 3)


def test_health_without_rows(spark):
    row = health.network_stress(health.slot_health(slots_of(spark).limit(0), F.lit(T0))).first()
    assert (row.slot_skip_rate, row.slots_per_second, row.total_slots_1h, row.skipped_slots_1h, row.stress_level) == (0.0, 0.0, 0, 0, "normal")


def test_gaps(spark):
    def seqs(*numbers):
        return spark.createDataFrame([(n,) for n in numbers], "seq long")

    assert [r.seq for r in gaps.missing_seqs(seqs(0, 1, 2, 3, 4, 5, 7, 8), 0, 9).collect()] == [6]
    assert gaps.missing_seqs(seqs(*range(9)), 0, 9).count() == 0
    for size in (2, 3, 1000):
        rows = gaps.gap_ranges(seqs(10, 13, 14, 19, 60), size).orderBy("first_missing").collect()
        assert [tuple(r) for r in rows] == [(11, 12, 2), (15, 18, 4), (20, 59, 40)]
    assert gaps.gap_ranges(seqs(1).limit(0)).collect() == []
    assert metrics.backlog(seqs(0, 1, 2), 0).first()[0] == 2 and metrics.backlog(seqs(0, 1, 2), None).first()[0] == 3
    assert readers.after_seq(seqs(0, 1, 2), 1).count() == 1 and readers.after_seq(seqs(0, 1, 2), None).count() == 3


def test_missing_and_skipped_slots(spark):
    df = slots_of(spark, (5, 3, T0, "x"), (6, 5, T0, "x"), (7, 5, T0, "x"), (9, None, T0, "x"))
    assert [r.slot for r in gaps.missing_slots(df).collect()] == [3]
    assert sorted(tuple(r) for r in gaps.skipped_slots(df).collect()) == [(5, 3, 1), (7, 5, 1)]
    assert {r.parent_slot: r.children for r in lookup.slot_children(df).collect()} == {3: 1, 5: 2}


def test_backfill_documents(spark):
    s1, s2, s3 = map(key_text, (b"s1", b"s2", b"s3"))
    message = ([key_text(b"k0"), key_text(b"k1"), "not base58: 0"], [(1,), (7,), (2,), (0,), (1,)])
    good = (([s1, "x"], message), (None, 5, ["l"]))
    rows = [
        (1, 60, 0, None, None, None, [good, (([s2], message), None), (([], message), (None, 5, None)), (([s3], message), ("e", None, None)), ((["0"], message), (None, 5, None))], None),
        (2, None, 1, None, None, None, [], None), (3, None, None, None, None, None, None, (-32007, "gone")), (4, None, None, None, None, None, None, (-1, "slot was skipped, or missing")), (5, None, None, None, None, None, None, (-1, "busy")),
    ]
    blocks, now = spark.createDataFrame(rows, BLOCK), F.lit(T0)
    got = project.backfill_transactions(blocks, now).orderBy("signature").collect()
    minute = dt.datetime(1970, 1, 1, 0, 1)
    assert [(r.slot, r.timestamp, bytes(r.signature), r.fee, r.success, list(map(bytes, r.program_ids)), r.log_messages) for r in got] == [
        (1, minute, b"s1", 5, True, [b"k1", b"k0"], ["l"]), (1, minute, b"s3", 0, False, [b"k1", b"k0"], []),
    ]
    assert [(r.slot, r.timestamp, r.parent_slot, r.status) for r in project.backfill_slots(blocks, now).orderBy("slot").collect()] == [(1, minute, 0, "confirmed"), (2, T0, 1, "confirmed")]
    status = {r.slot: r.status for r in project.block_status(blocks).collect()}
    assert status == {1: "repaired", 2: "repaired", 3: "unavailable", 4: "unavailable", 5: "failed"}
    wanted = spark.createDataFrame([(1,), (3,), (8,)], "slot long")
    assert {r.slot: r.status for r in gaps.repair_status(wanted, project.block_status(blocks)).collect()} == {1: "repaired", 3: "unavailable", 8: "pending"}


def test_retention_edge_is_kept(spark):
    df = spark.createDataFrame([(at(100),), (at(105),), (at(125),)], "timestamp timestamp")
    kept, pruned = metrics.retention_split(df, F.lit(at(125)), "0.020 seconds")
    assert (kept.count(), pruned.count()) == (2, 1)
    assert tuple(metrics.retention_counts({"t": df}, F.lit(at(125)), "0.020 seconds").first()) == ("t", 2, 1)


def test_split_valid_names_broken_rules(spark):
    df = spark.createDataFrame([(1, "a"), (-1, "b"), (None, None)], "lamports long, owner string")
    good, bad = watch.split_valid(df, {"amount": "lamports >= 0", "owner": "owner IS NOT NULL"})
    assert good.count() == 1 and sorted(r.broken_rules for r in bad.collect()) == [["amount"], ["amount", "owner"]]


def test_first_and_last_do_not_depend_on_input_order(spark):
    rows = [(i, i % 3, i * 10) for i in range(30)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, k long, v long").repartition(5)
    assert sorted(tuple(r) for r in keyed.first_by_key(df, ["k"]).collect()) == [(0, 0, 0), (1, 1, 10), (2, 2, 20)]
    assert sorted(tuple(r) for r in keyed.last_by_key(df, ["k"]).collect()) == [(27, 0, 270), (28, 1, 280), (29, 2, 290)]


def test_pulse_quirks(spark, events):
    df = events(tx(1, fee=10_000), tx(2, signature=b"B", fee=10_001), account(3, lamports=2_000_000_000), account(4, lamports=1))
    row = metrics.activity_pulse(project.transaction_rows(df), project.account_rows(df)).first()
    assert (row.active_users, row.volume, row.large_transactions, row.distinct_accounts) == (2, 20_001, 1, 1)
    assert row.value_locked == pytest.approx(2.000000001)
    large = metrics.first_large(project.transaction_rows(df)).first()
    assert large.amount == pytest.approx(0.010001) and large.description.startswith("Large transaction: 1.0001E-5")


def test_lookups(spark, events):
    df = events(account(1, ms=0, version=1), account(2, ms=0, version=2, owner=b"Q"), account(3, ms=-5, version=9))
    newest = lookup.latest_account(project.account_rows(df)).first()
    assert newest.write_version == 2 and bytes(newest.owner) == b"Q"
    times = [r.timestamp for r in lookup.accounts_by_owner(project.account_rows(df), b"P").collect()]
    assert times == sorted(times, reverse=True)
    rows = project.transaction_rows(events(tx(1, programs=(b"P",)), tx(2, signature=b"Z", programs=(b"Q",))))
    got = lookup.tx_by_program(rows, project.program_rows(rows), b"P", str(T0), str(at(1)))
    assert [bytes(r.signature) for r in got.collect()] == [b"S"]
    assert lookup.tx_by_program(rows, project.program_rows(rows), b"P", str(at(1)), str(at(9))).count() == 0


def test_backfilled_keys_are_decoded_once(spark):
    good, bad = key_text(b"\x01" * 64), "0OIl"
    rows = [(([s], ([key_text(b"P"), bad], [(0,), (1,)])), (None, 5, [])) for s in (good, bad, good + "\n", "")] + [(([None], ([], [])), (None, 5, [])), (([good], ([], [])), None)]
    out = project.backfill_transactions(spark.createDataFrame([(7, 60, 6, None, None, None, rows, None)], BLOCK), F.lit(at(0)))
    assert sorted((bytes(r.signature), [bytes(p) for p in r.program_ids]) for r in out.collect()) == [(b"", [b"P"]), (b"\x01" * 64, [b"P"])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_decode_all(") == 1 and plan.count("ArrowEvalPython") == 1
