"""Fixed schemas of the event stream and of the stored tables, as DDL (which needs no session)."""

from __future__ import annotations

from dataclasses import dataclass

KINDS = ("account", "transaction", "slot", "block_meta")

#: One row for each event; exactly one of the four structs is set, as ``kind`` says.
BRONZE = """
  seq BIGINT, kind STRING, slot BIGINT, observed_at TIMESTAMP,
  account STRUCT<pubkey: BINARY, owner: BINARY, lamports: BIGINT, write_version: BIGINT, data: BINARY>,
  transaction STRUCT<signature: BINARY, fee: BIGINT, success: BOOLEAN, accounts: ARRAY<BINARY>, program_ids: ARRAY<BINARY>, log_messages: ARRAY<STRING>>,
  slot_update STRUCT<parent_slot: BIGINT, status: STRING>,
  block_meta STRUCT<block_time: TIMESTAMP, block_height: BIGINT>
"""

#: A transaction as it comes off the wire, before flattening.
RAW_TX = """
  signature BINARY, meta STRUCT<err: STRING, fee: BIGINT, log_messages: ARRAY<STRING>>,
  message STRUCT<account_keys: ARRAY<BINARY>, instructions: ARRAY<STRUCT<program_id_index: INT>>>
"""

#: A block document for backfill; ``slot`` is the requested position.
BLOCK = """
  slot BIGINT, blockTime BIGINT, parentSlot BIGINT, blockhash STRING, previousBlockhash STRING, blockHeight BIGINT,
  transactions ARRAY<STRUCT<
    transaction: STRUCT<signatures: ARRAY<STRING>, message: STRUCT<accountKeys: ARRAY<STRING>, instructions: ARRAY<STRUCT<programIdIndex: INT>>>>,
    meta: STRUCT<err: STRING, fee: BIGINT, logMessages: ARRAY<STRING>>>>,
  error STRUCT<code: INT, message: STRING>
"""

WATCHLIST = "protocol STRING, kind STRING, key STRING, include_slots BOOLEAN, include_blocks_meta BOOLEAN"


@dataclass(frozen=True)
class Table:
    """A stored table: its key, the unit of the time buckets it is laid out by, the order inside a
    bucket (``-`` for descending columns), columns whose files get Bloom filters, its own
    retention where that is shorter than the others', and whether many thin buckets may share
    the folder of their month (see ``writers.shared_months``)."""

    name: str
    key: tuple[str, ...]
    bucket: str = "2 hours"
    sort: tuple[str, ...] = ("-timestamp",)
    looked_up: tuple[str, ...] = ()
    max_age: str | None = None
    shares: bool = False


TABLES = {
    t.name: t
    for t in (
        Table("account_updates", ("timestamp", "slot", "pubkey", "write_version"), sort=("pubkey", "-timestamp"), looked_up=("pubkey", "owner")),
        Table("transactions", ("timestamp", "signature"), looked_up=("signature",), shares=True),
        Table("transaction_program_ids", ("timestamp", "signature", "program_id", "position"), sort=("program_id", "-timestamp"), looked_up=("program_id",), max_age="1 hour", shares=True),
        Table("slots", ("timestamp", "slot"), "day", shares=True),
        Table("slot_health_1m", ("timestamp",), "day", shares=True),
        Table("custom_decoded_events", ("timestamp", "decoder_name", "record_key", "slot", "event_index"), looked_up=("record_key",)),
        Table("pipeline_metrics", ("timestamp", "stream_name", "batch_id"), "hour"),
        Table("lag_sketches", ("timestamp", "stream_name", "batch_id"), "day"),
        Table("account_sketches", ("timestamp", "owner", "stream_name", "batch_id"), "day"),
        Table("ingestion_checkpoints", ("stream_name",)),
    )
}
