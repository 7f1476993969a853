"""Decoders: events to decoded rows (decoder_name, record_key, slot, timestamp, event_index, payload)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType

from tallyflow.functions.columns import as_key, base58_encode, key_bytes
from tallyflow.operators.watch import key_type

DECODED = ("timestamp", "slot", "decoder_name", "record_key", "event_index", "payload")


class Decoder(Protocol):
    """What ``decode`` takes: a name, and either of two functions.

    ``rows`` gives an array of ``decoded`` structs for each event as an expression;
    all such decoders of a call run in one pass over the events. ``apply`` turns
    events into decoded rows by itself, for what no expression can say.
    """

    name: str


def decoded(name: str, key: Column, kind: DataType, index: Column, payload: Column) -> Column:
    """One decoded row inside an event; binary keys become base58 text later, for the rows that come out only."""
    binary = isinstance(kind, BinaryType)
    return F.struct(
        F.lit(name).alias("decoder_name"), (key if binary else F.lit(None).cast("binary")).alias("raw"), (F.lit(None).cast("string") if binary else key.cast("string")).alias("text"),
        index.cast("short").alias("event_index"), payload.alias("payload"),
    )


_NONE = "array<struct<decoder_name: string, raw: binary, text: string, event_index: smallint, payload: string>>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _exploded(events: DataFrame, rows: Column, *keep: str) -> DataFrame:
    each = events.select(F.col("observed_at").alias("timestamp"), "slot", *keep, F.explode(rows).alias("d"))
    key = F.coalesce("d.text", base58_encode(F.col("d.raw"))) if _has_binary(events) else F.col("d.text")
    return each.select("timestamp", "slot", "d.decoder_name", key.alias("record_key"), "d.event_index", "d.payload", *keep)


def _has_binary(events: DataFrame) -> bool:
    return any(isinstance(key_type(events, p), BinaryType) for p in ("account.pubkey", "transaction.signature"))


def decode(events: DataFrame, decoders: Sequence[Decoder]) -> DataFrame:
    """Rows of all decoders."""
    inside = [d.rows(events) for d in decoders if hasattr(d, "rows")]
    parts = [_exploded(events, F.concat(*inside))] if inside else []
    parts += [d.apply(events).select(*DECODED) for d in decoders if not hasattr(d, "rows")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def decode_by_protocol(tagged: DataFrame, decoders: dict[str, Sequence[Decoder]]) -> DataFrame:
    """Decode each protocol's own events (see ``watched(tag=True)``) with its own decoders, in one pass."""
    inside = [F.when(F.col("protocol") == name, d.rows(tagged)).otherwise(_none()) for name, own in decoders.items() for d in own if hasattr(d, "rows")]
    parts = [_exploded(tagged, F.concat(*inside), "protocol")] if inside else []
    parts += [d.apply(tagged.where(F.col("protocol") == name)).select(*DECODED, F.lit(name).alias("protocol")) for name, own in decoders.items() for d in own if not hasattr(d, "rows")]
    return reduce(lambda a, b: a.unionByName(b), parts)


class ProgramActivity:
    """Account updates that a program owns, and transactions that invoke it.

    A program is named by base58 text, or by plain text that is not base58; keys
    are compared as bytes, and record keys are base58 text.
    """

    name = "program-activity"

    def __init__(self, programs: Sequence):
        self.programs = [str(p) for p in programs]

    def rows(self, events: DataFrame) -> Column:
        def wanted(path: str) -> list[Column]:
            binary = isinstance(key_type(events, path), BinaryType)
            return [F.lit(k) for k in sorted({key_bytes(p) if binary else p.encode() for p in self.programs})]

        owner, many = key_type(events, "account.owner"), key_type(events, "transaction.program_ids")
        owned = as_key(F.col("account.owner"), owner).isin(*wanted("account.owner"))
        invoked = F.arrays_overlap(F.transform("transaction.program_ids", lambda x: as_key(x, many)), F.array(*wanted("transaction.program_ids")))
        zero = F.lit(0)
        account = decoded(self.name, F.col("account.pubkey"), key_type(events, "account.pubkey"), zero, F.lit('"account_update"'))
        transaction = decoded(self.name, F.col("transaction.signature"), key_type(events, "transaction.signature"), zero, F.lit('"transaction"'))
        kind = F.col("kind")
        return F.when((kind == "account") & owned, F.array(account)).when((kind == "transaction") & invoked, F.array(transaction)).otherwise(_none())


def _calls(logs: Column) -> Column:
    """Call lines of a transaction's log: place, program, depth."""
    lines = F.transform(logs, lambda line, i: F.struct(i.alias("at"), F.trim(line).alias("line")))
    return F.filter(
        F.transform(lines, lambda x: F.struct(
            x["at"].alias("at"),
            F.regexp_extract(x["line"], r"(?s)Program (.*?) invoke \[", 1).alias("program"),
            F.regexp_extract(x["line"], r"(?s)Program .*? invoke \[\+?([0-9]+)\]", 1).try_cast("int").alias("depth"),
        )),
        lambda x: x["depth"].isNotNull(),
    )


def _outcomes(logs: Column) -> Column:
    """Outcome lines of a transaction's log: program, and whether it succeeded."""

    def outcome(line: Column) -> Column:
        good = F.regexp_extract(line, r"(?s)Program (.*?) success", 1)
        bad = F.regexp_extract(line, r"(?s)Program (.*?) failed", 1)
        is_good, is_bad = line.rlike(r"(?s)Program .*? success"), line.rlike(r"(?s)Program .*? failed")
        return F.struct(F.when(is_good, good).when(is_bad, bad).alias("program"), is_good.alias("ok"))

    return F.filter(F.transform(logs, lambda line: outcome(F.trim(line))), lambda x: x["program"].isNotNull())


def _edges(calls: Column, outcomes: Column, success: Column) -> Column:
    """Call edges of one transaction, in line order.

    A call at depth d comes from the latest call at depth d - 1 before it, even if
    that one has returned; it succeeded as its program's last outcome line says,
    else as the transaction did. One fold over the calls carries the latest program at
    each depth, and one over the outcomes the last of each program.
    """
    known = F.aggregate(
        outcomes, F.expr("cast(map() as map<string, boolean>)"),
        lambda acc, o: F.map_concat(F.map_filter(acc, lambda k, _: k != o["program"]), F.create_map(o["program"], o["ok"])),
    )

    def step(acc: Column, call: Column) -> Column:
        caller = F.try_element_at(acc["latest"], call["depth"] - 1)
        edge = F.struct(call["at"].alias("at"), caller.alias("caller"), call["program"].alias("callee"), call["depth"].alias("depth"))
        latest = F.map_concat(F.map_filter(acc["latest"], lambda k, _: k != call["depth"]), F.create_map(call["depth"], call["program"]))
        return F.struct(latest.alias("latest"), F.when((call["depth"] > 1) & caller.isNotNull(), F.concat(acc["edges"], F.array(edge))).otherwise(acc["edges"]).alias("edges"))

    start = F.struct(F.expr("cast(map() as map<int, string>)").alias("latest"), F.expr("cast(array() as array<struct<at: int, caller: string, callee: string, depth: int>>)").alias("edges"))
    found = F.aggregate(calls, start, step, lambda acc: acc["edges"])
    # the folds stand in arrays of one, so that each runs once and not once an edge
    both = F.transform(F.array(F.struct(found.alias("edges"), known.alias("known"))), lambda x: F.transform(x["edges"], lambda e: F.struct(
        e["at"].alias("at"), e["caller"].alias("caller"), e["callee"].alias("callee"), e["depth"].alias("depth"), F.coalesce(F.try_element_at(x["known"], e["callee"]), success).alias("success"),
    )))
    return F.get(both, F.lit(0))


def _with_lines(transactions: DataFrame, logs: str) -> DataFrame:
    """Columns __calls and __outcomes: each line is read once, and edges walk the short arrays that are left."""
    return transactions.withColumns({"__calls": _calls(F.col(logs)), "__outcomes": _outcomes(F.col(logs))})


def call_edges(transactions: DataFrame) -> DataFrame:
    """(caller, callee, depth, success) of every nested call; needs no shuffle.

    Takes signature, slot, timestamp, success and log_messages.
    """
    lines = _with_lines(transactions.select("timestamp", "slot", "signature", "success", "log_messages"), "log_messages")
    each = lines.select("timestamp", "slot", "signature", F.explode(_edges(F.col("__calls"), F.col("__outcomes"), F.col("success"))).alias("e"))
    return each.select("timestamp", "slot", "signature", "e.at", "e.caller", "e.callee", "e.depth", "e.success")


def call_edges_stored(edges: DataFrame) -> DataFrame:
    """The edges a table keyed by depth keeps: the first at each depth of a transaction."""
    first = edges.groupBy("timestamp", "slot", "signature", "depth").agg(F.min_by(F.struct("at", "caller", "callee", "success"), "at").alias("e"))
    return first.select("timestamp", "slot", "signature", "e.at", "e.caller", "e.callee", "depth", "e.success")


class CallEdges:
    """Call edges as decoded rows; the event index is the depth."""

    name = "cpi-edge"

    def rows(self, events: DataFrame) -> Column:
        logs = F.col("transaction.log_messages")
        edges = _edges(_calls(logs), _outcomes(logs), F.col("transaction.success"))

        def row(e: Column) -> Column:
            payload = F.to_json(F.struct(e["caller"].alias("caller"), e["callee"].alias("callee"), e["depth"].alias("depth"), e["success"].alias("success")))
            return decoded(self.name, F.col("transaction.signature"), key_type(events, "transaction.signature"), e["depth"], payload)

        return F.when(F.col("kind") == "transaction", F.transform(edges, row)).otherwise(_none())


class RowDecoder:
    """Adapter for user code: a Python function from one event to any number of rows.

    ``decode`` gets the event's columns as keywords and yields (record_key,
    event_index, payload). It runs in Arrow batches on the executors; decoders
    that can be written as expressions should be.
    """

    def __init__(self, name: str, decode: Callable[..., Iterable[tuple[str, int, str]]], columns: Sequence[str]):
        self.name, self.decode, self.columns = name, decode, list(columns)

    def apply(self, events: DataFrame) -> DataFrame:
        name, decode, columns = self.name, self.decode, self.columns
        own = events.select(F.col("observed_at").alias("timestamp"), "slot", *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
        kind = own.schema["timestamp"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [
                    (event.timestamp, event.slot, name, key, index, payload)
                    for event in batch.itertuples(index=False)
                    for key, index, payload in decode(**{c.rpartition(".")[2]: getattr(event, f"c{i}") for i, c in enumerate(columns)})
                ]
                yield pd.DataFrame(rows, columns=list(DECODED))

        return own.mapInPandas(run, f"timestamp {kind}, slot long, decoder_name string, record_key string, event_index short, payload string")
