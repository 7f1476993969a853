"""Ledger-shaped views of the star-schema tables: events become account, slot and
block-time events, orders with their lines become transactions, conversations
become call logs. ``SQL`` has the same views for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import status_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parent() -> F.Column:
    return F.when(F.col("event_id") != 0, F.col("event_id") - 1 - F.col("event_id") % 3)


def _status_code() -> F.Column:
    kind = F.col("event_type")
    return F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", 2).when(kind == "signup", 4).otherwise(6)


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_id").alias("slot"), _parent().alias("parent_slot"), F.col("ts").alias("timestamp"), status_name(_status_code()).alias("status"), "event_type"
    )


def event_bronze(events: DataFrame) -> DataFrame:
    """Account, slot and block-time events of the events table, in bronze form."""
    slot, kind = F.floor(F.col("event_id") / 10).cast("long"), F.col("event_type")
    account = F.struct(
        F.col("user_id").alias("pubkey"), kind.alias("owner"), F.round(F.col("value") * 100).cast("long").alias("lamports"), F.col("event_id").alias("write_version"), F.col("props").alias("data")
    )
    update = F.struct(_parent().alias("parent_slot"), status_name(_status_code()).alias("status"))
    meta = F.struct(F.col("ts").alias("block_time"), F.col("event_id").alias("block_height"))
    base = [F.col("event_id").alias("seq"), F.col("ts").alias("observed_at")]

    def rows(df: DataFrame, name: str, slot_col, a=None, s=None, m=None) -> DataFrame:
        return df.select(
            *base, F.lit(name).alias("kind"), slot_col.alias("slot"),
            (account if a else F.lit(None).cast("struct<pubkey: bigint, owner: string, lamports: bigint, write_version: bigint, data: string>")).alias("account"),
            (update if s else F.lit(None).cast("struct<parent_slot: bigint, status: string>")).alias("slot_update"),
            (meta if m else F.lit(None).cast(f"struct<block_time: {df.schema['ts'].dataType.simpleString()}, block_height: bigint>")).alias("block_meta"),
        )

    return (
        rows(events.where(kind != "view"), "account", slot, a=True)
        .unionByName(rows(events, "slot", F.col("event_id"), s=True))
        .unionByName(rows(events.where(kind == "view"), "block_meta", slot, m=True))
        .withColumn("transaction", F.lit(None).cast("struct<signature: bigint, fee: bigint, success: boolean, accounts: array<bigint>, program_ids: array<bigint>, log_messages: array<string>>"))
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signature, programs, signers): a transaction's line keys in order."""
    each = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("signature"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line"))
    ordered = each.groupBy("signature").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return ordered.select("signature", F.transform("lines", lambda x: x["l_partkey"] % 50).alias("programs"), F.transform("lines", lambda x: x["l_suppkey"]).alias("signers"))


def tx_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of orders and lineitem in bronze form."""
    none = F.array().cast("array<bigint>")
    joined = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "signature").join(lines(spark, sf_dir), "signature", "left")
    tx = F.struct(
        F.col("signature"), F.round("o_totalprice").cast("long").alias("fee"), (F.col("o_orderstatus") != "F").alias("success"), F.coalesce("signers", none).alias("accounts"),
        F.coalesce(F.array_distinct("programs"), none).alias("program_ids"), F.array().cast("array<string>").alias("log_messages"),
    )
    return joined.select(
        F.col("signature").alias("seq"), F.col("o_orderdate").alias("observed_at"), F.lit("transaction").alias("kind"), F.floor(F.col("signature") / 4).cast("long").alias("slot"), tx.alias("transaction"),
        F.lit(None).cast("struct<pubkey: bigint, owner: string, lamports: bigint, write_version: bigint, data: string>").alias("account"),
        F.lit(None).cast("struct<parent_slot: bigint, status: string>").alias("slot_update"), F.lit(None).cast("struct<block_time: timestamp_ntz, block_height: bigint>").alias("block_meta"),
    )


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bronze(table(spark, sf_dir, "events")).unionByName(tx_bronze(spark, sf_dir))


def digest(key: F.Column) -> F.Column:
    """A 32-byte key that stands for a number or a name."""
    return F.unhex(F.sha2(key.cast("string"), 256))


def binary_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bronze`` with the stream's own types: every key is 32 bytes."""
    account, tx = (lambda name: F.col(f"account.{name}")), (lambda name: F.col(f"transaction.{name}"))
    accounts = F.struct(digest(account("pubkey")).alias("pubkey"), digest(account("owner")).alias("owner"), account("lamports"), account("write_version"), account("data").cast("binary").alias("data"))
    transactions = F.struct(
        digest(tx("signature")).alias("signature"), tx("fee"), tx("success"), F.transform(tx("accounts"), digest).alias("accounts"), F.transform(tx("program_ids"), digest).alias("program_ids"), tx("log_messages")
    )
    return bronze(spark, sf_dir).withColumns({"account": F.when(F.col("account").isNotNull(), accounts), "transaction": F.when(F.col("transaction").isNotNull(), transactions)})


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with call logs, one for each conversation."""
    role, turn = F.col("role"), F.col("turn")
    line = F.when(turn % 4 == 3, F.concat(F.lit("Program "), role, F.lit(" success"))).otherwise(F.concat(F.lit("Program "), role, F.lit(" invoke ["), (turn % 3 + 1).cast("string"), F.lit("]")))
    each = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    grouped = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select(
        F.col("conv_id").alias("signature"), F.col("conv_id").alias("slot"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id")).cast("timestamp_ntz").alias("timestamp"),
        (F.col("conv_id") % 2 == 0).alias("success"), F.transform("xs", lambda x: x["line"]).alias("log_messages"),
    )


#: The same views for DuckDB; a query lists those it needs.
SQL = {
    "v_slots": """v_slots AS (SELECT event_id AS slot, CASE WHEN event_id <> 0 THEN event_id - 1 - event_id % 3 END AS parent_slot, ts, event_type,
      CASE event_type WHEN 'view' THEN 'processed' WHEN 'click' THEN 'confirmed' WHEN 'purchase' THEN 'finalized' WHEN 'signup' THEN 'completed' ELSE 'dead' END AS status FROM events)""",
    "v_accounts": """v_accounts AS (SELECT event_id AS seq, event_id AS write_version, CAST(floor(event_id / 10) AS BIGINT) AS slot, ts AS observed_at, user_id AS pubkey, event_type AS owner,
      CAST(round(value * 100) AS BIGINT) AS lamports, props AS data FROM events WHERE event_type <> 'view')""",
    "v_block_times": """v_block_times AS (SELECT CAST(floor(event_id / 10) AS BIGINT) AS slot, max_by(ts, event_id) AS block_time FROM events WHERE event_type = 'view' GROUP BY 1)""",
    "v_tx": """v_tx AS (SELECT o_orderkey AS seq, o_orderkey AS signature, CAST(floor(o_orderkey / 4) AS BIGINT) AS slot, o_orderdate AS ts, CAST(round(o_totalprice) AS BIGINT) AS fee,
      o_orderstatus <> 'F' AS success, o_orderpriority FROM orders)""",
    "v_tx_ix": """v_tx_ix AS (SELECT l_orderkey AS signature, l_partkey % 50 AS program, l_suppkey AS account,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)""",
    "v_prog": """v_prog AS (SELECT signature, program, row_number() OVER (PARTITION BY signature ORDER BY first_pos) - 1 AS position
      FROM (SELECT signature, program, min(pos) AS first_pos FROM v_tx_ix GROUP BY 1, 2))""",
    "v_logs": """v_logs AS (SELECT conv_id AS signature, turn AS pos, role AS program, turn % 4 = 3 AS outcome, CASE WHEN turn % 4 <> 3 THEN turn % 3 + 1 END AS depth FROM conversations)""",
    "v_edges": """v_edges AS (
      SELECT c.signature, c.pos, c.program AS callee, c.depth, max_by(p.program, p.pos) AS caller,
             coalesce(any_value(o.ok), c.signature % 2 = 0) AS success
      FROM v_logs c JOIN v_logs p ON p.signature = c.signature AND p.depth = c.depth - 1 AND p.pos < c.pos
      LEFT JOIN (SELECT DISTINCT signature, program, true AS ok FROM v_logs WHERE outcome) o ON o.signature = c.signature AND o.program = c.program
      WHERE c.depth > 1 GROUP BY c.signature, c.pos, c.program, c.depth)""",
}


def sql(needs: str, body: str) -> str:
    """A query over the views named in ``needs``."""
    names = needs.split()
    return ("WITH " + ",\n".join(SQL[n] for n in names) + "\n" if names else "") + body
