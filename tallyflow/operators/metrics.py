"""Progress, throughput, lag, activity and retention counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tallyflow.functions.columns import as_key, key_bytes_of, lag_millis, per_second, time_bucket
from tallyflow.schemas import KINDS


def batch_progress(events: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row: highest slot, latest arrival, latest block time, of the given kinds."""
    return events.where(F.col("kind").isin(*kinds)).agg(
        F.max("slot").alias("max_slot"), F.max("observed_at").alias("max_observed_at"), F.max("block_meta.block_time").alias("max_block_time")
    )


def pipeline_report(batches: DataFrame) -> DataFrame:
    """Running totals over the metrics rows of each batch: received, flushes, rows written by table."""
    counters = [c for c in batches.columns if c.endswith("_rows")]
    return batches.agg(F.coalesce(F.sum("received"), F.lit(0).cast("long")).alias("received_events"), F.count(F.lit(1)).alias("flush_count"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(f"{c}_written") for c in counters])


def rates(report: DataFrame, received: str, written: str, elapsed_seconds: str) -> DataFrame:
    """Events and rows a second; 0 for spans below a tenth of a second."""
    return report.select("*", per_second(F.col(received), F.col(elapsed_seconds)).alias("events_per_second"), per_second(F.col(written), F.col(elapsed_seconds)).alias("rows_per_second"))


def index_lag(rows: DataFrame, as_of: Column, time: str = "block_time") -> DataFrame:
    """One row: milliseconds from the latest block time to ``as_of``; null without one."""
    return rows.agg(F.max(time).alias("latest")).select(lag_millis(as_of, F.col("latest")).alias("lag_ms"))


def lags(rows: DataFrame, block_time: str = "block_time", indexed: str = "observed_at") -> DataFrame:
    """Milliseconds from block to index of each row."""
    return rows.select(lag_millis(F.col(indexed), F.col(block_time)).alias("lag"))


def lag_percentiles(rows: DataFrame, probabilities: list[float], block_time: str = "block_time", indexed: str = "observed_at", exact: bool = False) -> DataFrame:
    """Percentiles of the rows' own lag from block to index.

    The approximate ones are off by at most 1/10000 of all rows in rank and hold a
    small sketch; ``exact`` ones hold every distinct lag in one buffer.
    """
    lag = lags(rows, block_time, indexed)
    fn = F.percentile if exact else F.percentile_approx
    return lag.agg(*[fn("lag", p).alias(f"lag_p{round(100 * p)}_ms") for p in probabilities])


def backlog(events: DataFrame, last: int | None) -> DataFrame:
    """One row: events after the last one processed, all without a checkpoint."""
    pending = events if last is None else events.where(F.col("seq") > last)
    return pending.agg(F.count(F.lit(1)).alias("unprocessed"))


def large_transactions(transactions: DataFrame, min_fee: int = 10_000) -> DataFrame:
    """Transactions above a fee, with the amount and the text of an alert.

    ``amount`` is fee / 1e6 while the text says fee / 1e9: both are kept as
    users know them.
    """
    text = F.format_string("Large transaction: %s", (F.col("fee") / 1e9).cast("string"))
    return transactions.where(F.col("fee") > min_fee).select("*", (F.col("fee") / 1e6).alias("amount"), text.alias("description"))


def first_large(transactions: DataFrame, n: int = 5, min_fee: int = 10_000, newest: bool = False) -> DataFrame:
    """The first (or newest) large transactions in arrival order."""
    order = F.desc("seq") if newest else F.asc("seq")
    return large_transactions(transactions, min_fee).orderBy(order).limit(n)


def activity_pulse(transactions: DataFrame, accounts: DataFrame, bucket: str = "day", seconds: int = 86_400) -> DataFrame:
    """Activity of each time bucket.

    Under their known names every transaction counts as a user and every
    account update adds to the value locked; ``distinct_accounts`` is the
    deduplicated figure.
    """
    kind = transactions.schema["timestamp"].dataType
    at = time_bucket(F.col("timestamp"), bucket).cast(kind).alias("bucket")
    tx = transactions.groupBy(at).agg(F.count(F.lit(1)).alias("active_users"), F.sum("fee").alias("volume"), F.count_if(F.col("fee") > 10_000).alias("large_transactions"))
    locked = accounts.groupBy(at).agg((F.sum("lamports") / 1e9).alias("value_locked"), F.count_distinct("pubkey").alias("distinct_accounts"))
    zero = F.lit(0).cast("long")
    return tx.join(locked, "bucket", "full").select(
        "bucket", F.coalesce("active_users", zero).alias("active_users"), F.coalesce("volume", zero).alias("volume"), F.coalesce("large_transactions", zero).alias("large_transactions"),
        F.coalesce("value_locked", F.lit(0.0)).alias("value_locked"), F.coalesce("distinct_accounts", zero).alias("distinct_accounts"),
        (F.coalesce("active_users", zero) / F.lit(float(seconds))).alias("transactions_per_second"),
    )


def protocol_rollup(transactions: DataFrame, programs: DataFrame, accounts: DataFrame, watch: DataFrame) -> DataFrame:
    """Transactions, volume and value locked of each watched protocol.

    A transaction counts once for a protocol however many of its programs it
    invokes. Keys are compared as bytes, see ``watch.watched``.
    """
    own = watch.where("kind = 'program' AND key IS NOT NULL")

    def wanted(of: DataFrame, column: str) -> DataFrame:
        binary = isinstance(of.schema[column].dataType, BinaryType)
        return own.select("protocol", (key_bytes_of(F.col("key")) if binary else F.col("key").cast("binary")).alias("key")).distinct()

    def keyed(of: DataFrame, column: str) -> DataFrame:
        return of.withColumn("key", as_key(F.col(column), of.schema[column].dataType)).join(wanted(of, column), "key")

    hits = keyed(programs.select("timestamp", "signature", "program_id"), "program_id").select("protocol", "timestamp", "signature").distinct()
    tx = hits.join(transactions.select("timestamp", "signature", "fee"), ["timestamp", "signature"]).groupBy("protocol").agg(F.count(F.lit(1)).alias("transactions"), F.sum("fee").alias("volume"))
    locked = keyed(accounts.select("owner", "lamports", "pubkey"), "owner").groupBy("protocol").agg((F.sum("lamports") / 1e9).alias("value_locked"), F.count_distinct("pubkey").alias("accounts"))
    zero = F.lit(0).cast("long")
    return own.select("protocol").distinct().join(tx, "protocol", "left").join(locked, "protocol", "left").select(
        "protocol", F.coalesce("transactions", zero).alias("transactions"), F.coalesce("volume", zero).alias("volume"), F.coalesce("value_locked", F.lit(0.0)).alias("value_locked"), F.coalesce("accounts", zero).alias("accounts")
    )


def retention_split(df: DataFrame, latest: Column, max_age: str = "1 hour", time: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): rows strictly older than ``latest - max_age`` are pruned."""
    cutoff = (latest - F.expr(f"INTERVAL {max_age}")).cast(df.schema[time].dataType)
    return df.where(F.col(time) >= cutoff), df.where(F.col(time) < cutoff)


def retention_counts(tables: dict[str, DataFrame], latest: Column, max_age: str = "1 hour") -> DataFrame:
    """(table_name, kept, pruned) of each table."""
    parts = []
    for name, df in tables.items():
        cutoff = (latest - F.expr(f"INTERVAL {max_age}")).cast(df.schema["timestamp"].dataType)
        parts.append(df.agg(F.count_if(F.col("timestamp") >= cutoff).alias("kept"), F.count_if(F.col("timestamp") < cutoff).alias("pruned")).select(F.lit(name).alias("table_name"), "kept", "pruned"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of each table."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()])
