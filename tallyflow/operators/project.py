"""Events to rows: flattening, the three clocks, child rows, backfill documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.columns import base58_decode, base58_decode_each, is_base58, watched_programs
from tallyflow.operators.enrich import with_block_time


def _timed(events: DataFrame, kind: str, block_times: DataFrame | None) -> DataFrame:
    own = events.where(F.col("kind") == kind)
    if block_times is None:
        return own.withColumn("timestamp", F.col("observed_at"))
    return with_block_time(own, block_times)


def account_rows(events: DataFrame, block_times: DataFrame | None = None) -> DataFrame:
    """Account updates, timed by the block if its time is known, else by arrival."""
    return _timed(events, "account", block_times).select("seq", "timestamp", "slot", "account.pubkey", "account.owner", "account.lamports", "account.data", "account.write_version")


def transaction_rows(events: DataFrame, block_times: DataFrame | None = None) -> DataFrame:
    """Transactions, timed likewise; the account list serves filters only and is left out."""
    return _timed(events, "transaction", block_times).select(
        "seq", "timestamp", "slot", "transaction.signature", "transaction.fee", "transaction.success", "transaction.program_ids", "transaction.log_messages"
    )


def slot_rows(events: DataFrame) -> DataFrame:
    """Slot updates by arrival time."""
    return events.where("kind = 'slot'").select("seq", F.col("observed_at").alias("timestamp"), "slot", "slot_update.parent_slot", "slot_update.status")


def block_times(events: DataFrame) -> DataFrame:
    """Block time of each slot; of several the last by seq holds. Without a time, arrival stands in."""
    own = events.where("kind = 'block_meta'").select("seq", "slot", F.coalesce("block_meta.block_time", "observed_at").alias("block_time"))
    return own.groupBy("slot").agg(F.max_by("block_time", "seq").alias("block_time"))


def flatten_transactions(raw: DataFrame) -> DataFrame:
    """Nested transactions to columns: no meta means failed, fee 0 and no logs."""
    logs = F.coalesce("meta.log_messages", F.array().cast("array<string>"))
    index = F.transform(F.coalesce("message.instructions", F.expr("cast(array() as array<struct<program_id_index: int>>)")), lambda x: x["program_id_index"])
    keep = [c for c in raw.columns if c not in ("meta", "message")]
    return raw.select(
        *keep,
        F.coalesce("meta.fee", F.lit(0).cast("long")).alias("fee"),
        (F.col("meta").isNotNull() & F.col("meta.err").isNull()).alias("success"),
        F.col("message.account_keys").alias("accounts"),
        _no_null(watched_programs(index, F.col("message.account_keys"))).alias("program_ids"),
        logs.alias("log_messages"),
    )


def _no_null(column: Column) -> Column:
    return F.coalesce(column, F.array())


def program_rows(transactions: DataFrame, base: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each program of a transaction with its position, counted from ``base``, and the columns in ``keep``."""
    return transactions.select("timestamp", "signature", *keep, F.posexplode("program_ids").alias("position", "program_id")).select(
        "timestamp", "signature", "program_id", (F.col("position") + base).cast("short").alias("position"), *keep
    )


def with_program_ids(transactions: DataFrame, programs: DataFrame) -> DataFrame:
    """Put the program list back; transactions without programs get an empty one."""
    lists = programs.groupBy("timestamp", "signature").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "program_id"))), lambda x: x["program_id"]).alias("program_ids"))
    joined = transactions.drop("program_ids").join(lists, ["timestamp", "signature"], "left")
    return joined.withColumn("program_ids", _no_null(F.col("program_ids")))


def json_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays and structs as JSON text; plain text as a JSON string. Nulls stay null."""
    for name in columns:
        if df.schema[name].dataType.simpleString() == "string":
            in_array = F.to_json(F.array(name))  # '["text"]'
            df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.substring(in_array, F.lit(2), F.length(in_array) - 2)))
        else:
            df = df.withColumn(name, F.to_json(name))
    return df


def block_status(blocks: DataFrame) -> DataFrame:
    """``repaired``, ``unavailable`` (skipped by the network) or ``failed`` for each document."""
    skipped = (F.col("error.code") == -32007) | F.contains(F.col("error.message"), F.lit("skipped"))
    return blocks.select("slot", F.when(F.col("error").isNull(), "repaired").when(F.coalesce(skipped, F.lit(False)), "unavailable").otherwise("failed").alias("status"))


def backfill_slots(blocks: DataFrame, as_of: Column) -> DataFrame:
    """Slot rows of block documents: confirmed, at block time or else at ``as_of``."""
    return blocks.where("error IS NULL").select(
        F.coalesce(F.timestamp_seconds("blockTime"), as_of).alias("timestamp"), "slot", F.col("parentSlot").alias("parent_slot"), F.lit("confirmed").alias("status")
    )


def backfill_transactions(blocks: DataFrame, as_of: Column) -> DataFrame:
    """Transactions of block documents, with base58 texts as bytes, like live ones.

    Transactions without meta or without a signature that is base58 are left out.
    Keys keep their index even if one cannot be read, so an instruction never
    points at a wrong key; a program that cannot be read is left out.
    """
    each = blocks.where("error IS NULL").select("slot", F.coalesce(F.timestamp_seconds("blockTime"), as_of).alias("timestamp"), F.explode("transactions").alias("t"))
    keys = F.col("t.transaction.message.accountKeys")
    index = F.transform("t.transaction.message.instructions", lambda x: x["programIdIndex"])
    signature = F.get("t.transaction.signatures", F.lit(0))
    # the text tells which signatures can be read: a filter on what the function gives would run it twice
    texts = each.where(F.col("t.meta").isNotNull() & is_base58(signature)).select(
        "slot", "timestamp",
        base58_decode(signature).alias("signature"),
        F.coalesce("t.meta.fee", F.lit(0).cast("long")).alias("fee"),
        F.col("t.meta.err").isNull().alias("success"),
        base58_decode_each(_no_null(watched_programs(index, keys))).alias("program_ids"),
        F.coalesce("t.meta.logMessages", F.array().cast("array<string>")).alias("log_messages"),
    )
    return texts.withColumn("program_ids", F.filter("program_ids", lambda x: x.isNotNull()))
