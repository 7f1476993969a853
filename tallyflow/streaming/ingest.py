"""Structured Streaming ingest: micro-batches to keyed tables, with retention and a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyflow.operators import project
from tallyflow.operators.decoders import Decoder, decode
from tallyflow.operators.keyed import absent, first_by_key
from tallyflow.operators.metrics import batch_progress
from tallyflow.schemas import TABLES
from tallyflow.sources import key_index, writers
from tallyflow.streaming import late_times, minute_view

RETAINED = ("account_updates", "transactions", "transaction_program_ids", "slots", "slot_health_1m", "custom_decoded_events", "pipeline_metrics")


def dedup_stream(df: DataFrame, key: Sequence[str], watermark: str, time: str = "timestamp") -> DataFrame:
    """Drop rows whose key came before within the watermark."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(key))


def insert_transactions(transactions: DataFrame, root: str) -> tuple[int, int]:
    """Add transactions whose signature is not stored at any time, and their programs; the rows added of each.

    Programs have the bucket of their transaction, so one index serves both tables. They are
    stored before it: where a transaction is stored its programs are too, so only those of new
    ones are looked at. Programs without a transaction are left from a write that failed, and go.
    """
    spark, signatures, slots = transactions.sparkSession, key_index.by_signature(root), key_index.by_slot(root)
    table, children = f"{root}/transactions", f"{root}/transaction_program_ids"
    with writers.staging(spark) as staged:
        rows = staged(writers.with_bucket(first_by_key(transactions, ("signature",)).drop("seq"), "transactions"))
        names = signatures.buckets_of(rows)
        stored = writers.read_folders(spark, table, names=names, schema=rows.drop("program_ids").schema) if names else None
        if stored is not None:
            rows = staged(absent(rows, stored, ("signature",)))
            names = signatures.buckets_of(rows)
        counts = {r["bucket"]: (r["n"], r["programs"]) for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("program_ids").isNotNull(), F.size("program_ids"))), F.lit(0)).alias("programs")).collect()}
        if not counts:
            return 0, 0
        added = {name: n for name, (n, _) in counts.items()}
        months = writers.shared_months(spark, table, "transactions", added)
        rows, added = writers.in_folders(rows, months), writers.folder_rows(added, months)
        programs = writers.folder_rows({name: n for name, (_, n) in counts.items() if n}, months)
        if names:
            _drop_programs(rows, root, names, staged)
        for each in (signatures, slots):
            each.add(rows)
        if programs:
            writers.write_buckets(project.program_rows(rows, keep=("bucket",)), children, "transaction_program_ids", "append", programs)
        writers.write_buckets(rows.drop("program_ids"), table, "transactions", "append", added)
    return sum(added.values()), sum(programs.values())


def _drop_programs(transactions: DataFrame, root: str, names: list[str], staged: Callable[[DataFrame], DataFrame]) -> None:
    """Delete stored programs of transactions that are not stored, in the named buckets."""
    spark, path = transactions.sparkSession, f"{root}/transaction_program_ids"
    stored = writers.read_folders(spark, path, names=names)
    if stored is None:
        return
    hit = [r["bucket"] for r in stored.join(transactions.select("signature"), "signature", "left_semi").select("bucket").distinct().collect()]
    found = writers.read_folders(spark, path, names=hit, schema=stored.schema)
    if found is None:
        return
    rest = staged(absent(found, transactions, ("signature",)))
    kept = writers.bucket_rows(rest)
    if kept:
        writers.write_buckets(rest, path, "transaction_program_ids", "overwrite", kept)
    for name in set(hit) - kept.keys():
        writers.drop_folder(spark, path, "bucket", name)


def ingest_batch(
    events: DataFrame, root: str, decoders: Sequence[Decoder] = (), block_times: DataFrame | None = None, stream: str = "main", max_age: str | None = None, reason: str = "size", batch_id: int = 0
) -> dict[str, int]:
    """Store one micro-batch; safe to repeat.

    Block times are those stored so far, the batch's own among them, else the given ones.
    Rows stored before their block time was known move to it first, so what came in
    another order, or comes again, meets its row. The checkpoint row comes last: a batch
    that fails between writes is run again and completes what is missing.
    """
    kinds = {r["kind"]: r["n"] for r in events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    written = dict.fromkeys(("received", "moved_rows", "account_rows", "transaction_rows", "program_rows", "slot_rows", "decoded_rows"), 0)
    written["received"] = sum(kinds.values())
    if "block_meta" in kinds:
        late_times.remember(late_times.learned(events), root)
    if kinds.keys() & {"account", "transaction", "block_meta"}:
        known = late_times.known_times(events.where(F.col("kind") != "slot"), root, block_times)
        written["moved_rows"] = sum(late_times.correct_times(known, root).values())
    slots = key_index.by_slot(root)
    if "account" in kinds:
        written["account_rows"] = writers.insert_if_absent(project.account_rows(events, known), root, "account_updates", key=("slot", "pubkey", "write_version"), index=slots, entries=[slots])
    if "transaction" in kinds:
        written["transaction_rows"], written["program_rows"] = insert_transactions(project.transaction_rows(events, known), root)
    if "slot" in kinds:
        updates = project.slot_rows(events)
        written["slot_rows"] = writers.upsert_last(updates, root, "slots")
        minute_view.refresh(updates, root)
    if decoders:
        # The first row in arrival order wins a key; payload breaks ties inside one event.
        decoded = decode(events, decoders).withColumn("seq", F.struct("timestamp", "payload"))
        written["decoded_rows"] = writers.insert_if_absent(decoded, root, "custom_decoded_events")
    progress = batch_progress(events)
    written["pruned"] = _retain(progress, root, max_age) if max_age else 0
    _add_metrics(progress, root, stream, batch_id, written)
    writers.write_checkpoint(progress, root, stream, reason)
    return written


def _retain(progress: DataFrame, root: str, max_age: str) -> int:
    """Prune all tables by their age at the latest arrival; a table's own retention holds where it is shorter."""
    spark, pruned = progress.sparkSession, 0
    ages = {t: F.expr(f"INTERVAL {max_age}") if not TABLES[t].max_age else F.least(F.expr(f"CAST(INTERVAL {max_age} AS INTERVAL DAY TO SECOND)"), F.expr(f"CAST(INTERVAL {TABLES[t].max_age} AS INTERVAL DAY TO SECOND)")) for t in RETAINED}
    cutoffs = progress.select(*[(F.col("max_observed_at") - age).alias(t) for t, age in ages.items()]).first()
    for table in RETAINED:
        if cutoffs[table] is not None and writers.exists(spark, f"{root}/{table}"):
            pruned += writers.prune(spark, root, table, cutoffs[table])
    return pruned


def _add_metrics(progress: DataFrame, root: str, stream: str, batch_id: int, written: dict[str, int]) -> None:
    """A row for the batch, at its latest arrival; not a second one if the batch comes again."""
    counts = [F.lit(n).cast("long").alias(c) for c, n in written.items()]
    row = progress.where("max_observed_at IS NOT NULL").select(F.col("max_observed_at").alias("timestamp"), F.lit(stream).alias("stream_name"), F.lit(batch_id).cast("long").alias("batch_id"), *counts, F.lit(0).alias("seq"))
    writers.insert_if_absent(row, root, "pipeline_metrics")


def start_ingest(
    source: DataFrame, root: str, checkpoint: str, decoders: Sequence[Decoder] = (), block_times: Callable[[], DataFrame] | None = None, trigger: dict | None = None, stream: str = "main", max_age: str | None = None
) -> StreamingQuery:
    """Run ``ingest_batch`` on each micro-batch of a stream.

    The source position moves on only when a batch is stored, and a batch is
    stored by key: at-least-once delivery, each row once.
    """

    def each(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            ingest_batch(df, root, decoders, block_times() if block_times else None, stream, max_age, "interval", batch_id)
        finally:
            df.unpersist()

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def apply_backfill(blocks: DataFrame, root: str, as_of) -> dict[str, int]:
    """Store all backfilled slots of a set of block documents in one job.

    Slots are upserted, transactions and their programs added if absent.
    Decoders do not run on backfilled rows.
    """
    now = F.lit(as_of).cast("timestamp")
    with writers.staging(blocks.sparkSession) as staged:
        # without their transactions documents are small, and each step below reads them
        heads = staged(blocks.select("slot", "blockTime", "parentSlot", "error"))
        slots = project.backfill_slots(heads, now).withColumn("seq", F.col("slot"))
        timed = heads.where("error IS NULL AND blockTime IS NOT NULL").select("slot", F.timestamp_seconds("blockTime").alias("block_time"))
        late_times.correct_times(timed.groupBy("slot").agg(F.max("block_time").alias("block_time")), root)
        stored = writers.upsert_last(slots, root, "slots")
        minute_view.refresh(slots, root)
        added, programs = insert_transactions(project.backfill_transactions(blocks, now).withColumn("seq", F.col("slot")), root)
    return {"slots": stored, "transactions": added, "programs": programs}
