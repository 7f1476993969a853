"""Registered queries of the ledger operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import base58_decode, base58_encode, base58_encode_each, event_slot, key_text, rfc3339, slug, trimmed_list
from tallyflow.operators import decoders, enrich, gaps, health, keyed, lookup, metrics, project, sketches, watch
from tallyflow.plans import views
from tallyflow.plans.views import sql, table
from tallyflow.session import scratch_path
from tallyflow.schemas import BLOCK
from tallyflow.sources import current, readers, writers
from tallyflow.streaming import ingest, late_times, layout, minute_view, positions, repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF, LOOKBACK = "2024-02-01 00:00:00", "40 days"
PROGRAMS, OWNERS, ACCOUNTS = (3, 7, 11), ("purchase",), (5, 8)


def query(needs: str = "", body: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if body is not None:
            ORACLE_SQL[fn.__name__] = sql(needs, body)
        return fn

    return add


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def time_text(column: str):
    """Timestamps leave as text of millisecond precision, whatever the session's zone."""
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSS").alias(column)


T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%g') AS {1}"


def watch_rows(spark: SparkSession) -> DataFrame:
    rows = [("dex", "program", str(p), False, False) for p in PROGRAMS] + [("dex", "program", o, False, False) for o in OWNERS] + [("wallets", "account", str(a), False, True) for a in ACCOUNTS]
    return readers.watchlist_of(spark, rows)


def hex_text(column):
    return F.lower(F.hex(column))


# Health


HEALTH = """
  SELECT {bucket}, count(*) AS slot_count, CAST(sum(slot - parent_slot - 1) AS BIGINT) AS skipped_slots,
         CAST(sum(slot - parent_slot - 1) AS DOUBLE) / nullif(count(*) + sum(slot - parent_slot - 1), 0) AS skip_rate, count(*) / {seconds} AS slots_per_second
  FROM v_slots WHERE status = 'finalized' AND ts > TIMESTAMP '2024-02-01' - INTERVAL 40 DAY GROUP BY date_trunc('{unit}', ts)"""


def _health(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    return health.slot_health(views.slots(spark, sf_dir), at(AS_OF), LOOKBACK, unit)


@query("v_slots", HEALTH.format(bucket=T.format("date_trunc('minute', ts)", "bucket"), seconds="60.0", unit="minute"))
def slot_health_1m(spark, sf_dir):
    return _health(spark, sf_dir, "minute").withColumn("bucket", time_text("bucket"))


@query("v_slots", HEALTH.format(bucket=T.format("date_trunc('hour', ts)", "bucket"), seconds="3600.0", unit="hour"))
def slot_health_1h(spark, sf_dir):
    return _health(spark, sf_dir, "hour").withColumn("bucket", time_text("bucket"))


LEVEL = "CASE WHEN {0} < 0.02 THEN 'normal' WHEN {0} < 0.05 THEN 'elevated' WHEN {0} < 0.10 THEN 'high' ELSE 'critical' END"
NEWEST = f"""h AS ({HEALTH.format(bucket="date_trunc('hour', ts) AS bucket", seconds="3600.0", unit="hour")}),
n AS (SELECT bucket, slot_count, coalesce(skipped_slots, 0) AS skipped_slots, coalesce(skip_rate, 0) AS skip_rate, slots_per_second FROM h ORDER BY bucket DESC LIMIT 30)"""


@query("v_slots", f", {NEWEST} SELECT {T.format('bucket', 'bucket')}, slot_count, skipped_slots, skip_rate, slots_per_second, {LEVEL.format('skip_rate')} AS stress_level FROM n")
def network_stress_buckets(spark, sf_dir):
    return health.newest_buckets(_health(spark, sf_dir, "hour")).withColumn("bucket", time_text("bucket"))


@query(
    "v_slots",
    f""", {NEWEST}, c AS (SELECT max_by(skip_rate, bucket) AS slot_skip_rate, max_by(slots_per_second, bucket) AS slots_per_second,
    CAST(sum(skipped_slots) AS BIGINT) AS skipped_slots_1h, CAST(sum(slot_count) AS BIGINT) AS total_slots_1h FROM n)
    SELECT *, {LEVEL.format("slot_skip_rate")} AS stress_level FROM c""",
)
def network_stress_summary(spark, sf_dir):
    return health.network_stress(_health(spark, sf_dir, "hour")).drop("buckets")


@query("v_slots", "SELECT slot, status, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM v_slots")
def slot_status_names(spark, sf_dir):
    return views.slots(spark, sf_dir).select("slot", "status", rfc3339(F.col("timestamp")).alias("at"))


# Projections


ACCOUNT_ROWS = f"""SELECT seq, {T.format("coalesce(block_time, observed_at)", "timestamp")}, a.slot, pubkey, owner, lamports, data, write_version
  FROM v_accounts a LEFT JOIN v_block_times b ON a.slot = b.slot"""


def _accounts(spark, sf_dir):
    events = views.event_bronze(table(spark, sf_dir, "events"))
    return project.account_rows(events, project.block_times(events))


def _transactions(spark, sf_dir):
    times = project.block_times(views.event_bronze(table(spark, sf_dir, "events")))
    return project.transaction_rows(views.tx_bronze(spark, sf_dir), times)


def _plain_transactions(spark, sf_dir):
    return project.transaction_rows(views.tx_bronze(spark, sf_dir))


@query("v_accounts v_block_times", ACCOUNT_ROWS)
def account_rows(spark, sf_dir):
    return _accounts(spark, sf_dir).withColumn("timestamp", time_text("timestamp"))


@query("v_tx v_block_times", f"SELECT seq, {T.format('coalesce(block_time, ts)', 'timestamp')}, t.slot, signature, fee, success FROM v_tx t LEFT JOIN v_block_times b ON t.slot = b.slot")
def tx_rows(spark, sf_dir):
    return _transactions(spark, sf_dir).select("seq", time_text("timestamp"), "slot", "signature", "fee", "success")


@query("v_slots", f"SELECT slot AS seq, {T.format('ts', 'timestamp')}, slot, parent_slot, status FROM v_slots")
def slot_rows(spark, sf_dir):
    return project.slot_rows(views.event_bronze(table(spark, sf_dir, "events"))).withColumn("timestamp", time_text("timestamp"))


@query("v_block_times", f"SELECT slot, {T.format('block_time', 'block_time')} FROM v_block_times")
def block_times(spark, sf_dir):
    return project.block_times(views.event_bronze(table(spark, sf_dir, "events"))).withColumn("block_time", time_text("block_time"))


@query("v_block_times", f"SELECT slot, {T.format('block_time', 'block_time')} FROM v_block_times ORDER BY slot DESC LIMIT 1000")
def block_time_topk(spark, sf_dir):
    times = project.block_times(views.event_bronze(table(spark, sf_dir, "events")))
    return enrich.newest_slots(times, 1000).withColumn("block_time", time_text("block_time"))


def _raw_tx(spark, sf_dir):
    """Nested transactions: some without meta, some without fee, one index out of range in ten."""
    base = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "signature").join(views.lines(spark, sf_dir), "signature")
    s = F.col("signature")
    index = F.transform("programs", lambda x, i: F.struct(i.alias("program_id_index")))
    beyond = F.array(F.struct(F.lit(999).alias("program_id_index")))
    meta = F.struct(
        F.when(F.col("o_orderstatus") == "F", F.lit("failed")).alias("err"), F.when(s % 11 != 0, F.round("o_totalprice").cast("long")).alias("fee"), F.when(s % 5 != 0, F.array(F.lit("a"), F.lit("b"))).alias("log_messages")
    )
    message = F.struct(F.col("programs").alias("account_keys"), F.when(s % 10 == 0, F.concat(index, beyond)).otherwise(index).alias("instructions"))
    return base.select("signature", F.when(s % 7 != 0, meta).alias("meta"), message.alias("message"))


@query(
    "v_tx v_tx_ix v_prog",
    """SELECT t.signature, CASE WHEN t.signature % 7 = 0 OR t.signature % 11 = 0 THEN 0 ELSE fee END AS fee, t.signature % 7 <> 0 AND success AS success,
    string_agg(CAST(program AS VARCHAR), ',' ORDER BY position) AS programs, CASE WHEN t.signature % 7 = 0 OR t.signature % 5 = 0 THEN 0 ELSE 2 END AS log_lines
    FROM v_tx t JOIN v_prog p ON t.signature = p.signature GROUP BY t.signature, fee, success""",
)
def flattened_tx(spark, sf_dir):
    out = project.flatten_transactions(_raw_tx(spark, sf_dir))
    return out.select("signature", "fee", "success", F.array_join(F.transform("program_ids", lambda x: x.cast("string")), ",").alias("programs"), F.size("log_messages").alias("log_lines"))


@query("v_tx v_tx_ix v_prog", f"SELECT {T.format('ts', 'timestamp')}, t.signature, program AS program_id, CAST(position AS SMALLINT) AS position FROM v_tx t JOIN v_prog p ON t.signature = p.signature")
def tx_program_ids(spark, sf_dir):
    return project.program_rows(_plain_transactions(spark, sf_dir)).withColumn("timestamp", time_text("timestamp"))


@query("v_tx v_tx_ix v_prog", f"SELECT {T.format('ts', 'timestamp')}, t.signature, program AS program_id, CAST(position + 1 AS SMALLINT) AS position FROM v_tx t JOIN v_prog p ON t.signature = p.signature")
def tx_program_ids_base1(spark, sf_dir):
    return project.program_rows(_plain_transactions(spark, sf_dir), base=1).withColumn("timestamp", time_text("timestamp"))


@query(
    "v_tx v_tx_ix v_prog",
    "SELECT t.signature, count(program) AS n, coalesce(string_agg(CAST(program AS VARCHAR), ',' ORDER BY position), '') AS programs FROM v_tx t LEFT JOIN v_prog p ON t.signature = p.signature GROUP BY 1",
)
def tx_program_list(spark, sf_dir):
    tx = _plain_transactions(spark, sf_dir)
    joined = project.with_program_ids(tx, project.program_rows(tx))
    return joined.select("signature", F.size("program_ids").cast("long").alias("n"), F.array_join(F.transform("program_ids", lambda x: x.cast("string")), ",").alias("programs"))


@query("v_tx v_tx_ix v_prog", "SELECT t.signature, list(program ORDER BY position)[1] AS first_program, count(*) AS n, '\"' || o_orderpriority || '\"' AS note FROM v_tx t JOIN v_prog p ON t.signature = p.signature GROUP BY t.signature, o_orderpriority")
def json_columns(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signature"), F.col("o_orderpriority").alias("note"))
    tx = _plain_transactions(spark, sf_dir).where("size(program_ids) > 0").select("signature", "program_ids").join(notes, "signature")
    text = project.json_columns(tx, ["program_ids", "note"])
    parsed = F.from_json("program_ids", "array<bigint>")
    return text.select("signature", F.get(parsed, F.lit(0)).alias("first_program"), F.size(parsed).cast("long").alias("n"), "note")


# Watchlists and filters


@query("v_accounts", "SELECT 'account' AS kind, seq FROM v_accounts WHERE pubkey IN (5, 8)")
def watched_accounts(spark, sf_dir):
    return watch.watched(views.event_bronze(table(spark, sf_dir, "events")).where("kind = 'account'"), watch_rows(spark).where("kind = 'account'")).select("kind", "seq")


@query("v_tx v_tx_ix", "SELECT 'transaction' AS kind, seq FROM v_tx t WHERE EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND program IN (3, 7, 11))")
def watched_tx(spark, sf_dir):
    return watch.watched(views.tx_bronze(spark, sf_dir), watch_rows(spark).where("kind = 'program'")).select("kind", "seq")


@query(
    "v_accounts v_tx v_tx_ix",
    """SELECT 'account' AS kind, seq FROM v_accounts WHERE pubkey IN (5, 8) OR owner = 'purchase'
    UNION ALL SELECT 'transaction', seq FROM v_tx t WHERE EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND (program IN (3, 7, 11) OR account IN (5, 8)))
    UNION ALL SELECT 'block_meta', event_id FROM events WHERE event_type = 'view'""",
)
def watched_union(spark, sf_dir):
    return watch.watched(views.bronze(spark, sf_dir), watch_rows(spark)).select("kind", "seq")


def _binary_key(value) -> str:
    """The base58 text of the key that stands for a value in ``views.binary_bronze``."""
    return key_text(hashlib.sha256(str(value).encode()).digest())


def _binary_watch(spark: SparkSession) -> DataFrame:
    rows = [("dex", "program", _binary_key(p), False, False) for p in (*PROGRAMS, *OWNERS)] + [("wallets", "account", _binary_key(a), False, True) for a in ACCOUNTS]
    return readers.watchlist_of(spark, rows)


WATCHED = """SELECT 'account' AS kind, seq FROM v_accounts WHERE pubkey IN (5, 8) OR owner = 'purchase'
    UNION ALL SELECT 'transaction', seq FROM v_tx t WHERE EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND (program IN (3, 7, 11) OR account IN (5, 8)))
    UNION ALL SELECT 'block_meta', event_id FROM events WHERE event_type = 'view'"""


@query("v_accounts v_tx v_tx_ix", WATCHED)
def watched_binary(spark, sf_dir):
    return watch.watched(views.binary_bronze(spark, sf_dir), _binary_watch(spark)).select("kind", "seq")


@query("v_accounts v_tx v_tx_ix", WATCHED)
def watched_binary_by_join(spark, sf_dir):
    more = spark.range(watch.IN_ROW).select(F.lit("none").alias("protocol"), F.lit("account").alias("kind"), F.concat(F.lit("0"), F.col("id").cast("string")).alias("key"), F.lit(False).alias("include_slots"), F.lit(False).alias("include_blocks_meta"))
    return watch.watched(views.binary_bronze(spark, sf_dir), _binary_watch(spark).unionByName(more)).select("kind", "seq")


@query("v_tx", "SELECT signature, fee FROM v_tx WHERE o_orderpriority <> '1-URGENT' AND success")
def prefiltered_tx(spark, sf_dir):
    votes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("signature"), F.round("o_totalprice").cast("long").alias("fee"), (F.col("o_orderpriority") == "1-URGENT").alias("is_vote"), (F.col("o_orderstatus") != "F").alias("success")
    )
    return watch.prefilter(votes).select("signature", "fee")


RULES = {"lamports": "lamports >= 0", "owner": "owner IS NOT NULL"}


def _checked(spark, sf_dir):
    rows = _accounts(spark, sf_dir).select("seq", (F.col("lamports") - 1000).alias("lamports"), F.when(F.col("owner") != "signup", F.col("owner")).alias("owner"))
    return watch.split_valid(rows, RULES)


@query("v_accounts", "SELECT seq, lamports - 1000 AS lamports, owner FROM v_accounts WHERE lamports >= 1000 AND owner <> 'signup'")
def valid_rows(spark, sf_dir):
    return _checked(spark, sf_dir)[0]


@query(
    "v_accounts",
    """SELECT seq, lamports - 1000 AS lamports, concat_ws(',', CASE WHEN lamports < 1000 THEN 'lamports' END, CASE WHEN owner = 'signup' THEN 'owner' END) AS broken
    FROM v_accounts WHERE lamports < 1000 OR owner = 'signup'""",
)
def quarantine_rows(spark, sf_dir):
    return _checked(spark, sf_dir)[1].select("seq", "lamports", F.array_join("broken_rules", ",").alias("broken"))


@query(
    "",
    """WITH u AS (SELECT 'program' AS kind, CAST(l_partkey % 50 AS VARCHAR) AS key, l_linenumber = 1 AND l_suppkey % 9 = 0 AS s, l_suppkey % 4 <> 0 AS m FROM lineitem
    UNION ALL SELECT 'account', CAST(user_id AS VARCHAR), false, event_type <> 'error' FROM events)
    SELECT kind, key, bool_or(s) AS include_slots, bool_or(m) AS include_blocks_meta FROM u GROUP BY 1, 2""",
)
def merged_watchlist(spark, sf_dir):
    programs = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_suppkey") % 7).alias("protocol"), F.lit("program").alias("kind"), (F.col("l_partkey") % 50).cast("string").alias("key"),
        ((F.col("l_linenumber") == 1) & (F.col("l_suppkey") % 9 == 0)).alias("include_slots"), (F.col("l_suppkey") % 4 != 0).alias("include_blocks_meta"),
    )
    accounts = table(spark, sf_dir, "events").select(F.lit("users").alias("protocol"), F.lit("account").alias("kind"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", F.lit(False)).alias("include_blocks_meta"))
    return watch.merge_watchlists(readers.watchlist(programs), readers.watchlist(accounts))


@query("", "SELECT c_custkey, c_custkey % 3 <> 0 AS valid, c_custkey % 3 = 0 AS has_reason FROM customer")
def validated_watchlist(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    good = base58_encode(F.unhex(F.sha2(F.col("c_custkey").cast("string"), 256)))
    key = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" "), good)).when(F.col("c_custkey") % 2 == 0, F.lit("   ")).otherwise(F.concat(F.lit("0"), "c_name"))
    rows = customers.select("c_custkey", key.alias("key"), F.lit("account").alias("kind"))
    return watch.validate_watchlist(rows).select("c_custkey", "valid", F.col("reason").isNotNull().alias("has_reason"))


@query("", "SELECT o_orderkey, o_orderkey % 10 = 0 AS quarantined FROM orders")
def corrupt_quarantine(spark, sf_dir):
    text = F.to_json(F.struct(F.col("o_orderkey").alias("slot"), F.col("o_custkey").alias("blockTime")))
    cut = F.when(F.col("o_orderkey") % 10 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    path = scratch_path(spark, "documents")
    table(spark, sf_dir, "orders").select(cut).write.text(path)
    blocks = readers.read_blocks(spark, path)
    number = F.coalesce("slot", F.regexp_extract("_corrupt_record", r'"slot":([0-9]+)', 1).cast("long"))
    return blocks.select(number.alias("o_orderkey"), F.col("_corrupt_record").isNotNull().alias("quarantined"))


@query("", "SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug, len(string_split(p_name, ' ')) AS words FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"), F.size(trimmed_list(F.replace("p_name", F.lit(" "), F.lit(" , ")))).cast("long").alias("words"))


# Decoders


ACTIVITY = f"""SELECT {T.format("observed_at", "timestamp")}, slot, 'program-activity' AS decoder_name, CAST(pubkey AS VARCHAR) AS record_key, CAST(0 AS SMALLINT) AS event_index, '"account_update"' AS payload
  FROM v_accounts WHERE owner = 'purchase'
  UNION ALL SELECT {T.format("ts", "timestamp")}, slot, 'program-activity', CAST(signature AS VARCHAR), 0, '"transaction"' FROM v_tx t
  WHERE EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND program IN (3, 7, 11))"""


def _activity():
    return decoders.ProgramActivity([*PROGRAMS, *OWNERS])


@query("v_accounts v_tx v_tx_ix", ACTIVITY)
def program_activity(spark, sf_dir):
    return decoders.decode(views.bronze(spark, sf_dir), [_activity()]).withColumn("timestamp", time_text("timestamp"))


@query(
    "v_accounts v_tx v_tx_ix",
    """SELECT slot, sha256(CAST(pubkey AS VARCHAR)) AS key, '"account_update"' AS payload FROM v_accounts WHERE owner = 'purchase'
    UNION ALL SELECT slot, sha256(CAST(signature AS VARCHAR)), '"transaction"' FROM v_tx t WHERE EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND program IN (3, 7, 11))""",
)
def activity_base58(spark, sf_dir):
    rows = decoders.decode(views.binary_bronze(spark, sf_dir), [decoders.ProgramActivity([_binary_key(p) for p in (*PROGRAMS, *OWNERS)])])
    return rows.select("slot", hex_text(base58_decode("record_key")).alias("key"), "payload")


@query("v_logs v_edges", "SELECT signature, pos AS at, caller, callee, depth, success FROM v_edges")
def call_edges(spark, sf_dir):
    return decoders.call_edges(views.logs(spark, sf_dir)).select("signature", F.col("at").cast("long"), "caller", "callee", F.col("depth").cast("long"), "success")


@query(
    "v_logs v_edges",
    "SELECT signature, pos AS at, caller, callee, depth, success FROM (SELECT *, row_number() OVER (PARTITION BY signature, depth ORDER BY pos) AS k FROM v_edges) WHERE k = 1",
)
def call_edges_stored(spark, sf_dir):
    edges = decoders.call_edges(views.logs(spark, sf_dir))
    return decoders.call_edges_stored(edges).select("signature", F.col("at").cast("long"), "caller", "callee", F.col("depth").cast("long"), "success")


def _log_events(spark, sf_dir):
    rows = views.logs(spark, sf_dir)
    tx = F.struct("signature", F.lit(0).cast("long").alias("fee"), "success", F.array().cast("array<bigint>").alias("accounts"), F.array((F.col("signature") % 50)).alias("program_ids"), "log_messages")
    empty = views.tx_bronze(spark, sf_dir)
    return rows.select(F.col("signature").alias("seq"), F.lit("transaction").alias("kind"), "slot", F.col("timestamp").alias("observed_at"), tx.alias("transaction"), *[F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in ("account", "slot_update", "block_meta")])


@query(
    "v_logs v_edges",
    """SELECT signature AS slot, 'cpi-edge' AS decoder_name, CAST(depth AS SMALLINT) AS event_index FROM v_edges
    UNION ALL SELECT conv_id, 'program-activity', 0 FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 50 IN (3, 7, 11)""",
)
def decoded_union(spark, sf_dir):
    return decoders.decode(_log_events(spark, sf_dir), [decoders.CallEdges(), _activity()]).select("slot", "decoder_name", "event_index")


@query(
    "v_accounts v_tx v_tx_ix",
    """SELECT 'dex' AS protocol, record_key FROM (
    SELECT CAST(pubkey AS VARCHAR) AS record_key FROM v_accounts WHERE owner = 'purchase'
    UNION ALL SELECT CAST(signature AS VARCHAR) FROM v_tx t WHERE EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND program IN (3, 7, 11)))
    UNION ALL SELECT 'wallets', CAST(pubkey AS VARCHAR) FROM v_accounts WHERE pubkey IN (5, 8) AND owner = 'click'""",
)
def decoded_per_protocol(spark, sf_dir):
    tagged = watch.watched(views.bronze(spark, sf_dir), watch_rows(spark), tag=True)
    return decoders.decode_by_protocol(tagged, {"dex": [_activity()], "wallets": [decoders.ProgramActivity(["click"])]}).select("protocol", "record_key")


@query("v_accounts v_tx v_tx_ix", f"SELECT * FROM ({ACTIVITY}) WHERE record_key = '5'")
def decoded_by_key(spark, sf_dir):
    return lookup.decoded_by_key(decoders.decode(views.bronze(spark, sf_dir), [_activity()]), "program-activity", "5").withColumn("timestamp", time_text("timestamp"))


# Metrics


@query(
    "v_tx",
    f"""SELECT greatest((SELECT max(event_id) FROM events), (SELECT max(slot) FROM v_tx)) AS max_slot,
    {T.format("greatest((SELECT max(ts) FROM events), (SELECT max(ts) FROM v_tx))", "max_observed_at")}, {T.format("(SELECT max(ts) FROM events WHERE event_type = 'view')", "max_block_time")}""",
)
def batch_progress(spark, sf_dir):
    return metrics.batch_progress(views.bronze(spark, sf_dir)).select("max_slot", time_text("max_observed_at"), time_text("max_block_time"))


def _daily(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)
    return events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("event_type") != "view").alias("account_rows"), F.count(F.lit(1)).alias("slot_rows"), seconds.alias("elapsed")
    )


@query(
    "",
    """SELECT count(*) AS received_events, count(DISTINCT date_trunc('day', ts)) AS flush_count, count(*) FILTER (WHERE event_type <> 'view') AS account_rows_written, count(*) AS slot_rows_written FROM events""",
)
def pipeline_report(spark, sf_dir):
    return metrics.pipeline_report(_daily(spark, sf_dir))


@query(
    "",
    f"""WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS received, count(*) FILTER (WHERE event_type <> 'view') AS w, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed FROM events GROUP BY 1)
    SELECT {T.format("day", "day")}, CASE WHEN elapsed < 0.1 THEN 0.0 ELSE received / elapsed END AS events_per_second, CASE WHEN elapsed < 0.1 THEN 0.0 ELSE w / elapsed END AS rows_per_second FROM d""",
)
def rates(spark, sf_dir):
    return metrics.rates(_daily(spark, sf_dir), "received", "account_rows", "elapsed").select(time_text("day"), "events_per_second", "rows_per_second")


@query("", "SELECT greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000) AS BIGINT)) AS lag_ms FROM events WHERE event_type = 'view'")
def index_lag(spark, sf_dir):
    times = project.block_times(views.event_bronze(table(spark, sf_dir, "events")))
    return metrics.index_lag(times, at(AS_OF))


LAGS = """l AS (SELECT greatest(0, CAST(floor((epoch_us(observed_at) - epoch_us(block_time)) / 1000) AS BIGINT)) AS lag FROM v_accounts a JOIN v_block_times b ON a.slot = b.slot)"""


def _lagged(spark, sf_dir):
    events = views.event_bronze(table(spark, sf_dir, "events"))
    return events.where("kind = 'account'").select("slot", "observed_at").join(project.block_times(events), "slot")


@query("v_accounts v_block_times", f", {LAGS} SELECT quantile_cont(lag, 0.5) AS lag_p50_ms, quantile_cont(lag, 0.95) AS lag_p95_ms FROM l")
def index_lag_p95(spark, sf_dir):
    return metrics.lag_percentiles(_lagged(spark, sf_dir), [0.5, 0.95], exact=True)


@query("v_accounts v_block_times", f", {LAGS} SELECT count(*) AS lags, true AS within_bound FROM l")
def index_lag_p95_approx(spark, sf_dir):
    """The approximate percentile's rank is within 1/10000 of all rows of the exact one (the function's default accuracy)."""
    rows = _lagged(spark, sf_dir)
    found = metrics.lag_percentiles(rows, [0.95])
    lag = metrics.lags(rows).crossJoin(F.broadcast(found))  # one row on that side
    n = F.count(F.lit(1))
    rank, bound = 0.95 * n, n / 10000 + 1
    return lag.agg(n.alias("lags"), ((F.count_if(F.col("lag") < F.col("lag_p95_ms")) <= rank + bound) & (F.count_if(F.col("lag") <= F.col("lag_p95_ms")) >= rank - bound)).alias("within_bound"))


@query("", "SELECT count(*) AS unprocessed FROM events WHERE event_id > 5000")
def backlog(spark, sf_dir):
    return metrics.backlog(table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq"), 5000)


@query(
    "v_tx v_accounts",
    f""", t AS (SELECT date_trunc('day', ts) AS bucket, count(*) AS active_users, CAST(sum(fee) AS BIGINT) AS volume, count(*) FILTER (WHERE fee > 10000) AS large_transactions FROM v_tx GROUP BY 1),
    a AS (SELECT date_trunc('day', observed_at) AS bucket, CAST(sum(lamports) AS DOUBLE) / 1e9 AS value_locked, count(DISTINCT pubkey) AS distinct_accounts FROM v_accounts GROUP BY 1)
    SELECT {T.format("coalesce(t.bucket, a.bucket)", "bucket")}, coalesce(active_users, 0) AS active_users, coalesce(volume, 0) AS volume, coalesce(large_transactions, 0) AS large_transactions,
    coalesce(value_locked, 0) AS value_locked, coalesce(distinct_accounts, 0) AS distinct_accounts, coalesce(active_users, 0) / 86400.0 AS transactions_per_second FROM t FULL JOIN a ON t.bucket = a.bucket""",
)
def activity_pulse(spark, sf_dir):
    accounts = project.account_rows(views.event_bronze(table(spark, sf_dir, "events")))
    return metrics.activity_pulse(_plain_transactions(spark, sf_dir), accounts).withColumn("bucket", time_text("bucket"))


@query("v_tx", "SELECT signature, fee, fee / 1e6 AS amount FROM v_tx WHERE fee > 10000 ORDER BY seq LIMIT 5")
def large_tx_first5(spark, sf_dir):
    return metrics.first_large(_plain_transactions(spark, sf_dir)).select("signature", "fee", "amount")


@query("v_tx", "SELECT signature, fee, fee / 1e6 AS amount FROM v_tx WHERE fee > 10000")
def large_transactions(spark, sf_dir):
    return metrics.large_transactions(_plain_transactions(spark, sf_dir)).select("signature", "fee", "amount")


@query(
    "v_tx v_tx_ix v_accounts",
    """, t AS (SELECT count(*) AS transactions, CAST(sum(fee) AS BIGINT) AS volume FROM v_tx t WHERE EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND program IN (3, 7, 11))),
    a AS (SELECT CAST(sum(lamports) AS DOUBLE) / 1e9 AS value_locked, count(DISTINCT pubkey) AS accounts FROM v_accounts WHERE owner = 'purchase')
    SELECT 'dex' AS protocol, transactions, volume, value_locked, accounts FROM t, a""",
)
def protocol_rollup(spark, sf_dir):
    tx = _plain_transactions(spark, sf_dir)
    return metrics.protocol_rollup(tx, project.program_rows(tx), _accounts(spark, sf_dir), watch_rows(spark))


def _retained(spark, sf_dir):
    accounts = project.account_rows(views.event_bronze(table(spark, sf_dir, "events")))
    return {"account_updates": accounts, "slots": views.slots(spark, sf_dir), "transactions": _plain_transactions(spark, sf_dir)}


@query(
    "v_accounts v_tx",
    """SELECT 'account_updates' AS table_name, count(*) FILTER (WHERE observed_at >= TIMESTAMP '2024-01-10') AS kept, count(*) FILTER (WHERE observed_at < TIMESTAMP '2024-01-10') AS pruned FROM v_accounts
    UNION ALL SELECT 'slots', count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10'), count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') FROM events
    UNION ALL SELECT 'transactions', count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10'), count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') FROM v_tx""",
)
def retention_counts(spark, sf_dir):
    return metrics.retention_counts(_retained(spark, sf_dir), at("2024-01-20"), "10 days")


@query("v_accounts", "SELECT seq FROM v_accounts WHERE observed_at >= TIMESTAMP '2024-01-10'")
def retained_rows(spark, sf_dir):
    return metrics.retention_split(_retained(spark, sf_dir)["account_updates"], at("2024-01-20"), "10 days")[0].select("seq")


@query("v_accounts v_tx", "SELECT 'account_updates' AS table_name, count(*) AS rows FROM v_accounts UNION ALL SELECT 'slots', count(*) FROM events UNION ALL SELECT 'transactions', count(*) FROM v_tx")
def row_counts(spark, sf_dir):
    return metrics.row_counts(_retained(spark, sf_dir))


@query(
    "v_accounts",
    """, e AS (SELECT 'account' AS kind, slot, seq FROM v_accounts UNION ALL SELECT 'slot', event_id, event_id FROM events UNION ALL SELECT 'block_meta', CAST(floor(event_id / 10) AS BIGINT), event_id FROM events WHERE event_type = 'view')
    SELECT kind, count(*) AS events, max(slot) AS slot FROM e WHERE seq > 300 GROUP BY 1""",
)
def replayed_events(spark, sf_dir):
    """What a replay after position 300 brings: events and the highest slot of each kind."""
    later = readers.after_seq(views.event_bronze(table(spark, sf_dir, "events")), 300)
    return later.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.max(event_slot()).alias("slot"))


# Gaps and slots


def _present(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_id").alias("seq"))


@query("", "SELECT range AS seq FROM range((SELECT max(event_id) + 1 FROM events WHERE event_type <> 'error')) WHERE range NOT IN (SELECT event_id FROM events WHERE event_type <> 'error')")
def seq_gaps(spark, sf_dir):
    present = _present(spark, sf_dir)
    top = present.agg(F.max("seq")).first()[0]
    return gaps.missing_seqs(present, 0, (top or 0) + 1)


@query(
    "",
    """WITH p AS (SELECT event_id AS seq, lead(event_id) OVER (ORDER BY event_id) AS nxt FROM events WHERE event_type <> 'error')
    SELECT seq + 1 AS first_missing, nxt - 1 AS last_missing, nxt - seq - 1 AS missing FROM p WHERE nxt - seq > 1""",
)
def seq_gap_ranges(spark, sf_dir):
    return gaps.gap_ranges(_present(spark, sf_dir), bucket_size=1000)


@query("", "SELECT event_id AS seq, CASE WHEN event_type <> 'error' THEN CAST(floor(event_id / 10) AS BIGINT) END AS slot FROM events")
def seq_with_slot(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq")
    known = events.where("event_type <> 'error'").select("seq", F.floor(F.col("seq") / 10).cast("long").alias("slot"))
    return enrich.with_slot(events.select("seq"), known)


def _stored_slots(spark, sf_dir):
    return views.slots(spark, sf_dir).where("event_type <> 'error'")


@query("v_slots", "SELECT DISTINCT parent_slot AS slot FROM v_slots WHERE event_type <> 'error' AND parent_slot IS NOT NULL AND parent_slot NOT IN (SELECT slot FROM v_slots WHERE event_type <> 'error')")
def missing_parents(spark, sf_dir):
    return gaps.missing_slots(_stored_slots(spark, sf_dir))


@query("v_slots", "SELECT slot, parent_slot, slot - parent_slot - 1 AS skipped FROM v_slots WHERE slot - parent_slot > 1")
def skipped_slots(spark, sf_dir):
    return gaps.skipped_slots(views.slots(spark, sf_dir))


@query("v_slots", "SELECT parent_slot, count(*) AS children, min(slot) AS first_child FROM v_slots WHERE parent_slot IS NOT NULL GROUP BY 1")
def slots_by_parent(spark, sf_dir):
    return lookup.slot_children(views.slots(spark, sf_dir))


@query("v_slots", "SELECT parent_slot, count(*) AS children FROM v_slots WHERE parent_slot IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def slot_forks(spark, sf_dir):
    return lookup.slot_children(views.slots(spark, sf_dir)).where("children > 1").select("parent_slot", "children")


# Backfill


def _blocks(spark, sf_dir):
    """Block documents as JSON files with one document for each slot's transactions; one slot in 13 is unavailable, one in 17 fails."""
    s, slot = F.col("signature"), F.col("slot")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signature"), F.struct(F.col("o_orderkey").alias("signature"), "o_orderstatus", "o_totalprice").alias("own"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("signature"), F.struct(F.col("l_orderkey").alias("signature"), "l_linenumber", "l_partkey", "l_suppkey").alias("line"))
    # one shuffle of short rows by slot, and no join: a document has both its transactions and their lines
    rows = orders.unionByName(lines, allowMissingColumns=True).select(F.floor(s / 4).cast("long").alias("slot"), "own", "line").repartition("slot")
    each = rows.groupBy("slot").agg(F.collect_list("own").alias("own"), F.sort_array(F.collect_list("line")).alias("lines")).where("size(own) > 0")
    texts = base58_encode_each(F.transform("own", lambda o: views.digest(o["signature"])))
    keys = base58_encode_each(F.transform("lines", lambda x: views.digest(x["l_partkey"] % 50)))
    coded = each.select("slot", "own", F.transform("lines", lambda x: x["signature"]).alias("of"), texts.alias("texts"), keys.alias("keys")).withColumn("lines", F.arrays_zip("of", "keys"))
    whole = coded.select("slot", F.transform("own", lambda o, i: F.struct(o.alias("own"), F.get("texts", i).alias("text"), F.transform(F.filter("lines", lambda x: x["of"] == o["signature"]), lambda x: x["keys"]).alias("keys"))).alias("each"))

    def document(x):
        own, keys = x["own"], x["keys"]
        message = F.struct(keys.alias("accountKeys"), F.transform(keys, lambda _, i: F.struct(i.alias("programIdIndex"))).alias("instructions"))
        signatures = F.when(own["signature"] % 19 != 0, F.array(x["text"])).otherwise(F.array().cast("array<string>"))
        meta = F.struct(F.when(own["o_orderstatus"] == "F", F.lit("failed")).alias("err"), F.round(own["o_totalprice"]).cast("long").alias("fee"), F.array(F.lit("x")).alias("logMessages"))
        return F.struct(F.struct(signatures.alias("signatures"), message.alias("message")).alias("transaction"), F.when(own["signature"] % 7 != 0, meta).alias("meta"))

    error = F.when(slot % 13 == 0, F.struct(F.lit(-32007).alias("code"), F.lit("n/a").alias("message"))).when(slot % 17 == 0, F.struct(F.lit(-32000).alias("code"), F.lit("server").alias("message")))
    grouped = whole.select("slot", F.transform("each", document).alias("transactions"))
    path = scratch_path(spark, "documents")
    grouped.select(F.to_json(F.struct("slot", F.when(slot % 3 != 0, slot * 60).alias("blockTime"), (slot - 1).alias("parentSlot"), "transactions", error.alias("error")))).write.text(path)
    return readers.read_blocks(spark, path).where("_corrupt_record IS NULL").drop("_corrupt_record")


BLOCK_OK = "slot % 13 <> 0 AND slot % 17 <> 0"
BLOCK_TIME = "CASE WHEN slot % 3 <> 0 THEN make_timestamp(slot * 60 * 1000000) ELSE TIMESTAMP '2024-02-01' END"


@query(
    "v_tx v_tx_ix v_prog",
    f""", l AS (SELECT signature, string_agg(sha256(CAST(program AS VARCHAR)), ',' ORDER BY position) AS programs FROM v_prog GROUP BY 1)
    SELECT slot, {T.format(BLOCK_TIME, "timestamp")}, sha256(CAST(t.signature AS VARCHAR)) AS signature, fee, success, coalesce(programs, '') AS programs
    FROM v_tx t LEFT JOIN l ON t.signature = l.signature WHERE {BLOCK_OK} AND t.signature % 7 <> 0 AND t.signature % 19 <> 0""",
)
def backfill_tx(spark, sf_dir):
    out = project.backfill_transactions(_blocks(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return out.select("slot", time_text("timestamp"), hex_text("signature").alias("signature"), "fee", "success", F.array_join(F.transform("program_ids", hex_text), ",").alias("programs"))


@query("v_tx", f"SELECT DISTINCT {T.format(BLOCK_TIME, 'timestamp')}, slot, slot - 1 AS parent_slot, 'confirmed' AS status FROM v_tx WHERE {BLOCK_OK}")
def backfill_slots(spark, sf_dir):
    return project.backfill_slots(_blocks(spark, sf_dir), F.lit(AS_OF).cast("timestamp")).withColumn("timestamp", time_text("timestamp"))


@query("v_tx", "SELECT DISTINCT slot, CASE WHEN slot % 13 = 0 THEN 'unavailable' WHEN slot % 17 = 0 THEN 'failed' ELSE 'repaired' END AS status FROM v_tx")
def block_status(spark, sf_dir):
    return project.block_status(_blocks(spark, sf_dir))


@query(
    "v_slots v_tx",
    """, r AS (SELECT DISTINCT parent_slot AS slot FROM v_slots WHERE event_type <> 'error' AND parent_slot IS NOT NULL AND parent_slot NOT IN (SELECT slot FROM v_slots WHERE event_type <> 'error')),
    b AS (SELECT DISTINCT slot FROM v_tx)
    SELECT r.slot, CASE WHEN b.slot IS NULL THEN 'pending' WHEN r.slot % 13 = 0 THEN 'unavailable' WHEN r.slot % 17 = 0 THEN 'failed' ELSE 'repaired' END AS status FROM r LEFT JOIN b ON r.slot = b.slot""",
)
def repair_status(spark, sf_dir):
    return gaps.repair_status(gaps.missing_slots(_stored_slots(spark, sf_dir)), project.block_status(_blocks(spark, sf_dir)))


@query(
    "v_tx",
    f"""SELECT sha256(CAST(signature AS VARCHAR)) AS signature, 'live' AS origin FROM v_tx WHERE signature % 5 <> 0
    UNION ALL SELECT sha256(CAST(signature AS VARCHAR)), 'backfill' FROM v_tx WHERE signature % 5 = 0 AND {BLOCK_OK} AND signature % 7 <> 0 AND signature % 19 <> 0""",
)
def live_plus_backfill(spark, sf_dir):
    live = table(spark, sf_dir, "orders").select(views.digest(F.col("o_orderkey")).alias("signature"), F.lit("live").alias("origin")).where("o_orderkey % 5 <> 0")
    filled = project.backfill_transactions(_blocks(spark, sf_dir), F.lit(AS_OF).cast("timestamp")).select("signature", F.lit("backfill").alias("origin"))
    return keyed.live_and_backfilled(live, filled, ["signature"]).select(hex_text("signature").alias("signature"), "origin")


def _landed(events: DataFrame) -> DataFrame:
    """Events as files, which each step of a batch reads."""
    path = scratch_path(events.sparkSession, "landing")
    events.write.parquet(path)
    return events.sparkSession.read.schema(events.schema).parquet(path)


@query(
    "v_tx v_tx_ix v_prog",
    f""", l AS (SELECT signature, count(*) AS programs FROM v_prog GROUP BY 1)
    SELECT sha256(CAST(t.signature AS VARCHAR)) AS signature, slot, {T.format(BLOCK_TIME, "timestamp")}, fee, success, 1 AS stored, coalesce(programs, 0) AS programs FROM v_tx t LEFT JOIN l ON t.signature = l.signature
    WHERE t.signature % 5 <> 0 OR ({BLOCK_OK} AND t.signature % 7 <> 0 AND t.signature % 19 <> 0)""",
)
def backfill_after_live(spark, sf_dir):
    """Four fifths of the transactions come live with their block times; the documents bring all of them, twice."""
    root, as_of = scratch_path(spark, "tables"), F.lit(AS_OF).cast("timestamp")
    live = views.binary_bronze(spark, sf_dir).where("kind = 'transaction' AND seq % 5 <> 0")
    live = _landed(live.withColumn("observed_at", F.col("observed_at").cast("timestamp")))
    slot = F.col("slot")
    times = live.select("slot").distinct().withColumn("block_time", F.when(slot % 3 != 0, F.timestamp_seconds(slot * 60)).otherwise(as_of))
    ingest.ingest_batch(live, root, block_times=times)
    blocks = _blocks(spark, sf_dir)
    for _ in range(2):
        ingest.apply_backfill(blocks, root, AS_OF)
    rows = writers.read_folders(spark, f"{root}/transactions").groupBy("signature").agg(F.count(F.lit(1)).cast("int").alias("stored"), *[F.min(c).alias(c) for c in ("slot", "timestamp", "fee", "success")])
    children = writers.read_folders(spark, f"{root}/transaction_program_ids").groupBy("signature").agg(F.count(F.lit(1)).alias("programs"))
    joined = rows.join(children, "signature", "left").withColumn("programs", F.coalesce("programs", F.lit(0).cast("long")))
    return joined.select(hex_text("signature").alias("signature"), "slot", time_text("timestamp"), "fee", "success", "stored", "programs")


# Keys, lookups


@query("", "SELECT user_id, event_type, arg_min(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins(spark, sf_dir):
    return keyed.first_by_key(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


@query("", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def last_wins(spark, sf_dir):
    return keyed.last_by_key(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


@query("", f"SELECT event_type AS stream_name, arg_max(event_id, ts) AS last_processed_slot, {T.format('max(ts)', 'last_observed_at')}, arg_max(props, ts) AS notes FROM events GROUP BY 1")
def latest_checkpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream_name"), F.col("event_id").alias("last_processed_slot"), F.col("ts").alias("last_observed_at"), F.col("props").alias("notes"))
    return lookup.latest_checkpoint(rows).withColumn("last_observed_at", time_text("last_observed_at"))


@query(
    "v_accounts v_block_times",
    """SELECT pubkey, owner, lamports, write_version FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY coalesce(block_time, observed_at) DESC, write_version DESC) AS k
    FROM v_accounts a LEFT JOIN v_block_times b ON a.slot = b.slot) WHERE k = 1""",
)
def latest_account(spark, sf_dir):
    return lookup.latest_account(_accounts(spark, sf_dir)).select("pubkey", "owner", "lamports", "write_version")


@query("v_accounts v_block_times", ACCOUNT_ROWS + " WHERE owner = 'purchase'")
def accounts_by_owner(spark, sf_dir):
    return lookup.accounts_by_owner(_accounts(spark, sf_dir), "purchase").withColumn("timestamp", time_text("timestamp"))


@query("v_accounts v_block_times", ACCOUNT_ROWS + " WHERE pubkey = 8")
def account_history(spark, sf_dir):
    return lookup.account_history(_accounts(spark, sf_dir), 8).withColumn("timestamp", time_text("timestamp"))


@query("v_tx v_tx_ix", "SELECT signature, fee FROM v_tx t WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01' AND EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND program = 7)")
def tx_by_program_range(spark, sf_dir):
    tx = _plain_transactions(spark, sf_dir)
    return lookup.tx_by_program(tx, project.program_rows(tx), 7, "1996-01-01", "1997-01-01").select("signature", "fee")


@query("v_accounts v_block_times", ACCOUNT_ROWS + " WHERE a.slot = 42")
def rows_of_slot(spark, sf_dir):
    return lookup.rows_of_slot(_accounts(spark, sf_dir), 42).withColumn("timestamp", time_text("timestamp"))


@query("v_tx", "SELECT signature, fee, success FROM v_tx WHERE signature = 1234")
def tx_by_signature(spark, sf_dir):
    return lookup.tx_by_signature(_plain_transactions(spark, sf_dir), 1234).select("signature", "fee", "success")


def _signed(spark, sf_dir):
    return views.tx_bronze(spark, sf_dir).select("transaction.signature", "transaction.fee", F.col("transaction.accounts").alias("signers"))


@query("v_tx v_tx_ix", "SELECT signature, fee FROM v_tx t WHERE EXISTS (SELECT 1 FROM v_tx_ix x WHERE x.signature = t.signature AND account = 5)")
def tx_by_signer(spark, sf_dir):
    return lookup.tx_by_signer(_signed(spark, sf_dir), 5).select("signature", "fee")


@query("v_tx v_tx_ix", "SELECT t.signature, fee FROM v_tx t JOIN v_tx_ix x ON x.signature = t.signature AND pos = 1 AND account = 5")
def tx_by_fee_payer(spark, sf_dir):
    return lookup.tx_by_fee_payer(_signed(spark, sf_dir), 5).select("signature", "fee")


@query("v_tx v_tx_ix", "SELECT p.account AS signer, o.account AS other, count(DISTINCT p.signature) AS transactions FROM v_tx_ix p JOIN v_tx_ix o ON o.signature = p.signature JOIN v_tx t ON t.signature = p.signature WHERE p.pos = 1 AND o.account <> p.account GROUP BY 1, 2")
def co_signers(spark, sf_dir):
    return lookup.co_signers(_signed(spark, sf_dir))


# Writes and streams: into the shared folder, and read back


def _twice(spark, sf_dir, fn, name: str, rows: DataFrame) -> DataFrame:
    """Store the first three quarters, then all rows again; the table must hold each key once."""
    root = scratch_path(spark, "tables")
    fn(rows.where("seq % 4 <> 3"), root, name)
    fn(rows, root, name)
    return spark.read.parquet(f"{root}/{name}")


@query("v_accounts", "SELECT pubkey, owner, lamports, write_version, slot FROM v_accounts")
def insert_if_absent(spark, sf_dir):
    rows = project.account_rows(views.event_bronze(table(spark, sf_dir, "events")))
    return _twice(spark, sf_dir, writers.insert_if_absent, "account_updates", rows).select("pubkey", "owner", "lamports", "write_version", "slot")


@query("", f"SELECT {T.format("date_trunc('day', ts)", 'timestamp')}, event_id % 100 AS slot, arg_max(event_type, event_id) AS status FROM events GROUP BY date_trunc('day', ts), 2")
def upsert_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("timestamp"), (F.col("event_id") % 100).alias("slot"), F.col("event_type").alias("status"))
    return _twice(spark, sf_dir, writers.upsert_last, "slots", rows).select(time_text("timestamp"), "slot", "status")


@query("v_tx v_tx_ix v_prog", f"SELECT {T.format("date_trunc('month', ts)", 'bucket')}, count(*) AS n, count(DISTINCT program) AS programs FROM v_tx t JOIN v_prog p ON t.signature = p.signature GROUP BY date_trunc('month', ts)")
def clustered_write(spark, sf_dir):
    root = scratch_path(spark, "tables")
    writers.write_clustered(project.program_rows(_plain_transactions(spark, sf_dir)), root, "transaction_program_ids", "month")
    back = spark.read.parquet(f"{root}/transaction_program_ids")
    return back.groupBy(F.col("bucket").cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("program_id").alias("programs")).withColumn("bucket", time_text("bucket"))


@query("", f"SELECT 'main' AS stream_name, max(event_id) AS last_processed_slot, {T.format('max(ts)', 'last_observed_at')}, 'flush_reason=size' AS notes FROM events")
def checkpoint_rows(spark, sf_dir):
    root = scratch_path(spark, "tables")
    events = views.event_bronze(table(spark, sf_dir, "events"))
    for part in ("seq % 2 = 0", "true"):
        writers.write_checkpoint(metrics.batch_progress(events.where(part)), root, "main")
    return lookup.latest_checkpoint(spark.read.parquet(f"{root}/ingestion_checkpoints")).withColumn("last_observed_at", time_text("last_observed_at"))


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return readers.read_events(spark, f"{sf_dir}/events.parque[t]", streaming=True, schema=schema)  # a pattern: streams take no single file


def _collected(spark, df, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a Parquet table, and read it back."""
    out = scratch_path(spark, "stream")
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("v_slots", HEALTH.format(bucket=T.format("date_trunc('hour', ts)", "bucket"), seconds="3600.0", unit="hour"))
def stream_slot_health(spark, sf_dir):
    slots = _event_stream(spark, sf_dir).select(F.col("event_id").alias("slot"), views._parent().alias("parent_slot"), F.col("ts").alias("timestamp"), views.status_name(views._status_code()).alias("status"))
    out = scratch_path(spark, "stream")
    totals = health.slot_health_stream(slots, bucket="hour")

    def store(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    totals.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = keyed.last_by_key(spark.read.parquet(out), ["bucket"], "batch").drop("batch")
    return last.withColumn("bucket", time_text("bucket"))


@query("", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedup(spark, sf_dir):
    doubled = _event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = _collected(spark, ingest.dedup_stream(doubled, ["event_id"], "1 hour", "ts").select("event_id", "event_type"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("v_accounts v_block_times", ACCOUNT_ROWS.replace("SELECT seq, ", "SELECT "))
def stream_ingest(spark, sf_dir):
    root = scratch_path(spark, "tables")
    source = views.event_bronze(_event_stream(spark, sf_dir))
    ingest.start_ingest(source, root, f"{root}-checkpoint", [_activity()]).awaitTermination()
    return spark.read.parquet(f"{root}/account_updates").select(time_text("timestamp"), "slot", "pubkey", "owner", "lamports", "data", "write_version")


@query("v_accounts", f"SELECT seq, {T.format('observed_at', 'timestamp')} FROM v_accounts WHERE observed_at >= TIMESTAMP '2024-01-10 07:30:00'")
def pruned_table(spark, sf_dir):
    root = scratch_path(spark, "tables")
    writers.write_clustered(project.account_rows(views.event_bronze(table(spark, sf_dir, "events"))), root, "account_updates")
    writers.prune(spark, root, "account_updates", "2024-01-10 07:30:00")
    return readers.read_table(spark, root, "account_updates").select("seq", time_text("timestamp"))


#: Positions of the events table for each file of a landing.
LANDED_POSITIONS = 100_000


def _restarted(spark, sf_dir) -> str:
    """Three landings of as many files, one micro-batch each: the run stops after two, and the third brings a late tenth of the first once more.

    Block times come from a table, so that a row that comes again has the same time.
    """
    root = scratch_path(spark, "tables")
    raw = table(spark, sf_dir, "events")
    whole = views.event_bronze(raw)
    times, events = _landed(project.block_times(whole)), whole.where("kind <> 'block_meta'")
    landing = f"{root}-landing"
    part = F.col("seq") % 3
    # dealt by hash, each file gets some thirty thousand positions of a landing, so none is missing
    files = max(1, raw.count() // LANDED_POSITIONS)

    def land(rows: DataFrame) -> None:
        lane = F.pmod(F.xxhash64("seq"), F.lit(files)).cast("int")
        rows.withColumn("lane", lane).repartition(files, "lane").write.mode("append").partitionBy("lane").parquet(landing)

    def run() -> None:
        source = readers.read_events(spark, f"{landing}/lane=*", streaming=True, max_files=files, schema=events.schema)
        ingest.start_ingest(source, root, f"{root}-checkpoint", block_times=lambda: times).awaitTermination()

    land(events.where(part == 0))
    land(events.where(part == 1))
    run()
    land(events.where((part == 2) | ((part == 0) & (F.col("seq") % 10 == 0))))
    run()
    return root


@query("v_accounts v_block_times", ACCOUNT_ROWS.replace("SELECT seq, ", "SELECT "))
def stream_restart(spark, sf_dir):
    return spark.read.parquet(f"{_restarted(spark, sf_dir)}/account_updates").select(time_text("timestamp"), "slot", "pubkey", "owner", "lamports", "data", "write_version")


@query(
    "v_accounts",
    """, e AS (SELECT event_id AS seq FROM events UNION ALL SELECT seq FROM v_accounts), r AS (SELECT count(*) AS n FROM e), late AS (SELECT count(*) AS n FROM e WHERE seq % 3 = 0 AND seq % 10 = 0)
    SELECT CAST(3 AS BIGINT) AS batches, CAST(r.n + late.n AS BIGINT) AS received, (SELECT count(*) FROM v_accounts) AS account_rows, CAST(0 AS BIGINT) AS pruned FROM r, late""",
)
def batch_metrics(spark, sf_dir):
    rows = spark.read.parquet(f"{_restarted(spark, sf_dir)}/pipeline_metrics")
    return rows.agg(F.count(F.lit(1)).alias("batches"), F.sum("received").alias("received"), F.sum("account_rows").alias("account_rows"), F.sum("pruned").alias("pruned"))


# Rows whose block time comes late, the stored minute view, metrics


def _late_transactions(spark, sf_dir) -> DataFrame:
    """Four fifths of the transactions, which arrive a second apart and without block times."""
    live = views.binary_bronze(spark, sf_dir).where("kind = 'transaction' AND seq % 5 <> 0")
    return _landed(live.withColumn("observed_at", F.timestamp_seconds(F.lit(1_706_745_600) - F.col("seq"))))


@query(
    "v_tx v_tx_ix v_prog",
    f""", l AS (SELECT signature, count(*) AS programs FROM v_prog GROUP BY 1),
    t AS (SELECT *, {BLOCK_OK} AND slot % 3 <> 0 AS timed, {BLOCK_OK} AND signature % 7 <> 0 AND signature % 19 <> 0 AS filled FROM v_tx)
    SELECT sha256(CAST(t.signature AS VARCHAR)) AS signature, CAST(1 AS BIGINT) AS stored, coalesce(programs, 0) AS programs, strftime(CASE WHEN timed THEN make_timestamp(slot * 60 * 1000000)
      WHEN t.signature % 5 = 0 THEN TIMESTAMP '2024-02-01' WHEN slot % 2 = 0 THEN make_timestamp((slot * 60 + 1) * 1000000) ELSE make_timestamp((1706745600 - t.signature) * 1000000) END, '%Y-%m-%d %H:%M:%S.%g') AS timestamp
    FROM t LEFT JOIN l ON t.signature = l.signature WHERE t.signature % 5 <> 0 OR filled""",
)
def late_block_time(spark, sf_dir):
    """Transactions by arrival; the same again when every second slot's block time is known; then the documents, which time two slots in three."""
    root, live = scratch_path(spark, "tables"), _late_transactions(spark, sf_dir)
    ingest.ingest_batch(live, root)
    even = live.select("slot").where("slot % 2 = 0").distinct().withColumn("block_time", F.timestamp_seconds(F.col("slot") * 60 + 1))
    ingest.ingest_batch(live, root, block_times=even)
    ingest.apply_backfill(_blocks(spark, sf_dir), root, AS_OF)
    rows = writers.read_folders(spark, f"{root}/transactions").groupBy("signature").agg(F.count(F.lit(1)).alias("stored"), F.max("timestamp").alias("timestamp"))
    own = writers.read_folders(spark, f"{root}/transaction_program_ids").groupBy("timestamp", "signature").agg(F.count(F.lit(1)).alias("programs"))
    return rows.join(own, ["timestamp", "signature"], "left").select(hex_text("signature").alias("signature"), "stored", F.coalesce("programs", F.lit(0).cast("long")).alias("programs"), time_text("timestamp"))


@query("v_accounts v_block_times", ACCOUNT_ROWS.replace("SELECT seq, ", "SELECT "))
def late_metas(spark, sf_dir):
    """Accounts in three micro-batches, and after them the block times; an earlier part of these comes twice."""
    root = scratch_path(spark, "tables")
    events = views.event_bronze(table(spark, sf_dir, "events"))
    metas = events.where("kind = 'block_meta'")
    for part in [events.where(f"kind = 'account' AND seq % 3 = {k}") for k in (2, 0, 1)] + [metas.where("seq % 2 = 0"), metas]:
        ingest.ingest_batch(part, root)
    return spark.read.parquet(f"{root}/account_updates").select(time_text("timestamp"), "slot", "pubkey", "owner", "lamports", "data", "write_version")


@query("v_accounts v_block_times", f"SELECT a.seq, a.slot, {T.format("coalesce(b.block_time, observed_at)", "timestamp")} FROM v_accounts a LEFT JOIN v_block_times b ON a.slot = b.slot")
def held_stream(spark, sf_dir):
    """A stream that holds accounts for their block time; a last, later event lets go of what still waits."""
    root = scratch_path(spark, "stream")
    events = views.event_bronze(table(spark, sf_dir, "events"))
    times = late_times.learned(events).withColumn("kind", F.lit("time")).join(events.where("kind = 'block_meta'").select("seq", "observed_at"), "seq")
    end = events.limit(1).select(F.lit(-1).cast("long").alias("seq"), F.lit("end").alias("kind"), F.lit(-1).cast("long").alias("slot"), F.lit("2030-01-01").cast("timestamp").alias("observed_at"), F.lit(None).cast("timestamp").alias("block_time"))
    accounts = events.where("kind = 'account'").select("seq", "kind", "slot", F.col("observed_at").cast("timestamp").alias("observed_at"), F.lit(None).cast("timestamp").alias("block_time"))
    landed = accounts.unionByName(times.select("seq", "kind", "slot", F.col("observed_at").cast("timestamp").alias("observed_at"), F.col("block_time").cast("timestamp").alias("block_time")))
    out = f"{root}/out"

    def run(rows: DataFrame) -> None:
        rows.coalesce(4).write.mode("append").parquet(f"{root}/in")
        source = readers.read_events(spark, f"{root}/in", streaming=True, schema=landed.schema)
        held = late_times.held_for_block_time(source.where("kind <> 'time'").select("seq", "slot", "observed_at"), source.where("kind <> 'account'").select("slot", "observed_at", "block_time"), "90 days")
        held.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(out).awaitTermination()

    for rows in (landed, end):
        run(rows)
    return spark.read.parquet(out).where("seq >= 0").select("seq", "slot", time_text("timestamp"))


@query("v_slots", HEALTH.format(bucket=T.format("date_trunc('minute', ts)", "bucket"), seconds="60.0", unit="minute"))
def refreshed_health(spark, sf_dir):
    """Slots come half of them first, with another status and no parent, then all; each batch refreshes its own minutes."""
    root = scratch_path(spark, "tables")
    rows = views.slots(spark, sf_dir).select("seq", "timestamp", "slot", "parent_slot", "status")
    early = rows.where("slot % 2 = 0").withColumns({"parent_slot": F.lit(None).cast("long"), "status": F.lit("finalized")})
    for batch in (early, rows.where("slot % 3 = 0"), rows):
        writers.upsert_last(batch, root, "slots")
        minute_view.refresh(batch, root)
    return minute_view.stored_health(spark, root, at(AS_OF), LOOKBACK).withColumn("bucket", time_text("bucket"))


@query(
    "v_accounts",
    """, e AS (SELECT event_id AS seq, ts, 0 AS account FROM events UNION ALL SELECT seq, observed_at, 1 FROM v_accounts), b AS (SELECT *, seq % 3 AS batch_id FROM e UNION ALL SELECT *, 2 FROM e WHERE seq % 3 = 0 AND seq % 10 = 0)
    SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS timestamp, strftime(date_trunc('hour', max(ts)), '%Y-%m-%d %H:%M:%S') AS bucket, batch_id, count(*) AS received, sum(account) FILTER (WHERE seq % 3 = batch_id) AS account_rows FROM b GROUP BY batch_id""",
)
def metrics_by_hour(spark, sf_dir):
    rows = writers.read_folders(spark, f"{_restarted(spark, sf_dir)}/pipeline_metrics")
    return rows.select(time_text("timestamp"), "bucket", "batch_id", "received", "account_rows")


@query("v_accounts", ACTIVITY.split("UNION ALL")[0].replace("CAST(0 AS SMALLINT) AS event_index", "0 AS event_index"))
def stored_decoded(spark, sf_dir):
    root = scratch_path(spark, "tables")
    for _ in range(2):
        ingest.ingest_batch(views.event_bronze(table(spark, sf_dir, "events")).where("kind = 'account'"), root, [_activity()])
    rows = spark.read.parquet(f"{root}/custom_decoded_events")
    return rows.select(time_text("timestamp"), "slot", "decoder_name", "record_key", F.col("event_index").cast("int"), "payload")


@query("", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'account: empty' WHEN c_custkey % 4 = 1 THEN 'account: not base58' WHEN c_custkey % 4 = 2 THEN 'account: 3 bytes, not 32' END AS reason FROM customer")
def watchlist_reasons(spark, sf_dir):
    k = F.col("c_custkey") % 4
    key = F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit("0"), "c_name")).when(k == 2, base58_encode(F.lit(b"abc"))).otherwise(base58_encode(F.unhex(F.sha2(F.col("c_custkey").cast("string"), 256))))
    return watch.validate_watchlist(table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), F.lit("account").alias("kind"))).select("c_custkey", "reason")


# Positions as intervals, sketches


def _positions(spark, sf_dir, part: int) -> str:
    """The interval set after four batches of positions in an order of their own, one of them twice."""
    root, present = scratch_path(spark, "tables"), _present(spark, sf_dir)
    for k in (2, 0, 3, 2, 1):
        positions.add_positions(present.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == k), root, part, positions.PART // part)
    return root


@query("", ORACLE_SQL["seq_gap_ranges"])
def gap_set(spark, sf_dir):
    return positions.gap_set(spark, _positions(spark, sf_dir, 1000), 100)


@query(
    "",
    """WITH p AS (SELECT event_id AS seq, event_id // 1000 AS part FROM events WHERE event_type <> 'error'), i AS (SELECT part, min(seq) AS low, max(seq) AS high FROM (SELECT *, seq - row_number() OVER (PARTITION BY part ORDER BY seq) AS run FROM p) GROUP BY part, run),
    b AS (SELECT unnest(range(low, high + 1, 7)) AS first, low, high FROM i)
    SELECT first, least(first + 6, high) AS last, CASE WHEN first + 6 < high OR high + 1 IN (SELECT seq FROM p) THEN 'full' WHEN high = (SELECT max(seq) FROM p) THEN 'end' ELSE 'gap' END AS ends FROM b""",
)
def contiguous_batch(spark, sf_dir):
    return positions.replay_plan(spark, _positions(spark, sf_dir, 1000), 7)


def _sketched_lags(spark, sf_dir, rows: DataFrame) -> DataFrame:
    """Hourly sketches of three batches, stored; one batch comes twice."""
    root = scratch_path(spark, "tables")
    for k in (0, 1, 2, 1):
        hourly = sketches.lag_sketches(rows.where(F.col("slot") % 3 == k)).withColumns({"stream_name": F.lit("main"), "batch_id": F.lit(k), "seq": F.lit(0)})
        writers.insert_if_absent(hourly, root, "lag_sketches")
    return writers.read_folders(spark, f"{root}/lag_sketches")


@query("v_accounts v_block_times", f", {LAGS.replace('AS lag FROM', "AS lag, date_trunc('day', observed_at) AS day FROM")} SELECT {T.format('day', 'timestamp')}, count(*) AS lags, true AS within_bound FROM l GROUP BY day")
def merged_lag_sketches(spark, sf_dir):
    """Each day's p50, p95 and p99 from hourly sketches: their ranks among the day's lags are within the stated bound."""
    rows, ps = _lagged(spark, sf_dir), {"lag_p50_ms": 0.5, "lag_p95_ms": 0.95, "lag_p99_ms": 0.99}
    daily = sketches.merged_lags(_sketched_lags(spark, sf_dir, rows), list(ps.values()), "day")
    own = rows.select(F.date_trunc("day", "observed_at").cast("timestamp_ntz").alias("timestamp"), metrics.lag_millis(F.col("observed_at"), F.col("block_time")).alias("lag"))
    joined = own.join(daily.withColumnRenamed("lags", "n"), "timestamp")
    n = F.count(F.lit(1))
    good = [(F.count_if(F.col("lag") < F.col(c)) <= p * n + sketches.RANK_ERROR * n + 1) & (F.count_if(F.col("lag") <= F.col(c)) >= p * n - sketches.RANK_ERROR * n - 1) for c, p in ps.items()]
    return joined.groupBy("timestamp").agg(F.max("n").alias("lags"), (good[0] & good[1] & good[2] & (n == F.max("n"))).alias("within_bound")).withColumn("timestamp", time_text("timestamp"))


@query("v_accounts", f"SELECT {T.format("date_trunc('day', observed_at)", 'timestamp')}, owner, count(*) AS updates, count(DISTINCT pubkey) AS accounts, true AS within_error FROM v_accounts GROUP BY date_trunc('day', observed_at), owner")
def distinct_accounts_rollup(spark, sf_dir):
    """Distinct accounts of each day and owner from hourly sketches of three batches, beside the true figure."""
    root = scratch_path(spark, "tables")
    accounts = project.account_rows(views.event_bronze(table(spark, sf_dir, "events")))
    for k in range(3):
        hourly = sketches.account_sketches(accounts.where(F.col("seq") % 3 == k)).withColumns({"stream_name": F.lit("main"), "batch_id": F.lit(k), "seq": F.lit(0)})
        writers.insert_if_absent(hourly, root, "account_sketches")
    daily = sketches.merged_accounts(writers.read_folders(spark, f"{root}/account_sketches"), "day", ["owner"]).withColumnRenamed("accounts", "estimate")
    true = accounts.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("timestamp"), "owner").agg(F.count_distinct("pubkey").alias("accounts"))
    close = F.abs(F.col("estimate") - F.col("accounts")) <= F.col("accounts") * sketches.DISTINCT_ERROR + 1
    return daily.join(true, ["timestamp", "owner"]).select(time_text("timestamp"), "owner", "updates", "accounts", close.alias("within_error"))


@query("v_accounts", "SELECT protocol, count(*) AS updates, count(DISTINCT pubkey) AS accounts, true AS within_error FROM v_accounts JOIN (VALUES ('shop', 'purchase'), ('shop', 'click'), ('all', 'purchase'), ('all', 'click'), ('all', 'signup'), ('all', 'error')) w(protocol, owner) USING (owner) GROUP BY protocol")
def protocol_accounts(spark, sf_dir):
    """Distinct accounts of protocols that own several programs, from the programs' hourly sketches."""
    accounts = project.account_rows(views.event_bronze(table(spark, sf_dir, "events")))
    watch_of = readers.watchlist_of(spark, [(p, "program", o, False, False) for p, owners in (("shop", ("purchase", "click")), ("all", ("purchase", "click", "signup", "error"))) for o in owners]).select("protocol", F.col("key").alias("owner"))
    estimated = sketches.merged_accounts(sketches.account_sketches(accounts).join(watch_of, "owner"), by=["protocol"]).withColumnRenamed("accounts", "estimate")
    true = accounts.join(watch_of, "owner").groupBy("protocol").agg(F.count_distinct("pubkey").alias("accounts"))
    return estimated.join(true, "protocol").select("protocol", "updates", "accounts", (F.abs(F.col("estimate") - F.col("accounts")) <= F.col("accounts") * sketches.DISTINCT_ERROR + 1).alias("within_error"))


# Current accounts, layout, repair


@query("v_accounts", "SELECT pubkey, arg_max(owner, write_version) AS owner, arg_max(lamports, write_version) AS lamports, max(write_version) AS write_version FROM v_accounts GROUP BY 1")
def current_accounts(spark, sf_dir):
    """Versions come in three batches, newest first, one batch twice, and the table is compacted between them."""
    root = scratch_path(spark, "tables")
    rows = project.account_rows(views.event_bronze(table(spark, sf_dir, "events"))).drop("seq")
    for k in (2, 1, 2, 0):
        current.add_versions(rows.where(F.pmod("write_version", F.lit(3)) == k), root, 8)
        if k == 1:
            current.compact_current(spark, root, 8)
    return current.current_accounts(spark, root, 8).select("pubkey", "owner", "lamports", "write_version")


@query("v_accounts", "SELECT strftime(date_trunc('hour', observed_at) - INTERVAL 1 HOUR * (hour(observed_at) % 2), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS rows, CAST(1 AS BIGINT) AS files FROM v_accounts GROUP BY 1")
def compacted_layout(spark, sf_dir):
    """Accounts in four batches, so buckets of several files; one run of the layout job."""
    root = scratch_path(spark, "tables")
    rows = project.account_rows(views.event_bronze(table(spark, sf_dir, "events")))
    for k in range(4):
        writers.insert_if_absent(rows.where(F.col("seq") % 4 == k), root, "account_updates")
    layout.run_layout(spark, root, AS_OF, ["account_updates"])
    stored = writers.read_folders(spark, f"{root}/account_updates")
    return stored.select("bucket", F.col("_metadata.file_path").alias("file")).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("file").alias("files"))


REPAIRED = "CASE WHEN {0} % 19 = 0 THEN 'pending' WHEN {0} % 13 = 0 THEN 'unavailable' WHEN {0} % 17 = 0 THEN 'failed' ELSE 'repaired' END"


@query(
    "",
    f"""WITH a AS (SELECT event_id - 1 AS slot, {REPAIRED.format("(event_id - 1)")} AS status, CAST(0 AS BIGINT) AS round FROM events WHERE event_id % 4 = 0 AND event_id > 0),
    b AS (SELECT slot - 1 AS slot, {REPAIRED.format("(slot - 1)")} AS status, CAST(1 AS BIGINT) AS round FROM a WHERE status = 'repaired'),
    c AS (SELECT slot - 1 AS slot, {REPAIRED.format("(slot - 1)")} AS status, CAST(2 AS BIGINT) AS round FROM b WHERE status = 'repaired')
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def repair_chain(spark, sf_dir):
    """Every fourth slot is stored; three missing parents lie between two, and each is known only by the one above it."""
    root, s = scratch_path(spark, "tables"), F.col("slot")
    slots = table(spark, sf_dir, "events").select(F.col("event_id").alias("slot"))
    stored = slots.where("slot % 4 = 0").select(s.alias("seq"), F.timestamp_seconds(s * 60).alias("timestamp"), "slot", F.when(s > 0, s - 1).alias("parent_slot"), F.lit("finalized").alias("status"))
    writers.upsert_last(stored, root, "slots")
    error = F.when(s % 13 == 0, F.struct(F.lit(-32007).alias("code"), F.lit("n/a").alias("message"))).when(s % 17 == 0, F.struct(F.lit(-32000).alias("code"), F.lit("server").alias("message")))
    fields = {f.name: f.dataType for f in spark.createDataFrame([], BLOCK).schema}
    given = {"slot": s, "blockTime": s * 60, "parentSlot": s - 1, "transactions": F.array(), "error": error}
    documents = slots.where("slot % 19 <> 0").select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()])
    repair.repair(spark, root, lambda missing: documents.join(missing, "slot", "left_semi"), AS_OF)
    return repair.statuses(spark, root)
