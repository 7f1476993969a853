"""Watchlists and the filters they drive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType

from tallyflow.functions.columns import as_key, checked_key, key_bytes, key_bytes_of


def merge_watchlists(*lists: DataFrame) -> DataFrame:
    """Union of watchlists: each key once, flags joined by OR, in key order."""
    union = reduce(lambda a, b: a.unionByName(b), lists)
    return union.groupBy("kind", "key").agg(F.bool_or("include_slots").alias("include_slots"), F.bool_or("include_blocks_meta").alias("include_blocks_meta")).orderBy("kind", "key")


def validate_watchlist(watch: DataFrame) -> DataFrame:
    """``watch`` with the 32-byte key (``bytes``), ``valid`` and the ``reason`` if it is not."""
    checked = watch.withColumn("checked", checked_key("key"))
    reason = F.when(F.col("checked.reason").isNotNull(), F.concat_ws(": ", "kind", "checked.reason"))
    return checked.select(*watch.columns, F.col("checked.bytes").alias("bytes"), F.col("checked.reason").isNull().alias("valid"), reason.alias("reason"))


#: Watch entries up to which the filter is an expression in each event's own row.
IN_ROW = 1000

#: Where an event holds what a ``program`` or an ``account`` entry can name: one key of an account, a list of a transaction.
KEYS = {"program": ("account.owner", "transaction.program_ids"), "account": ("account.pubkey", "transaction.accounts")}


def key_type(events: DataFrame, path: str) -> DataType:
    struct, name = path.split(".")
    kind = events.schema[struct].dataType[name].dataType
    return kind.elementType if isinstance(kind, ArrayType) else kind


def _matches(events: DataFrame, rows: list) -> Column:
    """Whether an event is watched by any of some watchlist rows. Keys are compared as bytes."""
    out = F.lit(False)
    for kind, (one, many) in KEYS.items():
        texts = {r.key for r in rows if r.kind == kind and r.key is not None}
        for path in (one, many) if texts else ():
            kind_of = key_type(events, path)
            binary = isinstance(kind_of, BinaryType)
            wanted = [F.lit(k) for k in sorted({key_bytes(t) if binary else t.encode() for t in texts})]
            if path == one:
                own = as_key(F.col(path), kind_of).isin(*wanted)
            else:
                own = F.arrays_overlap(F.col(path) if binary else F.transform(path, lambda x: x.cast("string").cast("binary")), F.array(*wanted))
            out = out | F.coalesce(own, F.lit(False))
    for flag, kind in (("include_slots", "slot"), ("include_blocks_meta", "block_meta")):
        if any(r[flag] for r in rows):
            out = out | (F.col("kind") == kind)
    return F.coalesce(out, F.lit(False))


def event_keys(events: DataFrame) -> Column:
    """All that an event can be watched by: an array of (kind, key), ``text`` kinds where keys are not binary."""

    def pairs(path: str, kind: str, many: bool) -> Column:
        of = key_type(events, path)
        name = kind if isinstance(of, BinaryType) else f"{kind} text"
        own = F.coalesce(F.col(path), F.array()) if many else F.array(path)
        return F.transform(own, lambda x: F.struct(F.lit(name).alias("kind"), as_key(x, of).alias("key")))

    flag = F.array(F.struct(F.lit("flag").alias("kind"), F.col("kind").cast("binary").alias("key")))
    parts = [flag] + [pairs(path, kind, many) for kind, paths in KEYS.items() for path, many in zip(paths, (False, True), strict=True)]
    return F.array_distinct(F.concat(*parts))


def watched(events: DataFrame, watch: DataFrame, tag: bool = False) -> DataFrame:
    """Events that any watch entry matches: by program, by account, or by the flags for slots and block times.

    An entry's key is the bytes its base58 text stands for, or the text's own
    bytes where it is not base58; event columns that are not binary are compared
    by their text. An empty watchlist lets all events through. With ``tag`` there
    is one row for each (event, protocol) with the protocol's name; otherwise each
    event is there once. Up to ``IN_ROW`` entries the filter is an expression and
    nothing is shuffled; beyond that keys are joined, with the same result.
    """
    rows = watch.limit(IN_ROW + 1).collect()
    if not rows:
        return events.withColumn("protocol", F.lit(None).cast("string")) if tag else events
    if len(rows) > IN_ROW:
        return _watched_by_join(events, watch, tag)
    if not tag:
        return events.where(_matches(events, rows))
    names = sorted({r.protocol for r in rows})
    hits = F.filter(F.array(*[F.when(_matches(events, [r for r in rows if r.protocol == n]), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return events.withColumn("protocol", F.explode(hits))


def _watched_by_join(events: DataFrame, watch: DataFrame, tag: bool) -> DataFrame:
    """One pass over the events: each brings its row along with each of its keys, and only rows that match are grouped again."""
    flags = F.array(F.when(F.col("include_slots"), F.lit("slot")), F.when(F.col("include_blocks_meta"), F.lit("block_meta")))
    by_key = watch.where("key IS NOT NULL").select(
        "protocol", F.inline(F.array(F.struct(F.col("kind"), key_bytes_of(F.col("key")).alias("key")), F.struct(F.concat("kind", F.lit(" text")).alias("kind"), F.col("key").cast("binary").alias("key"))))
    )
    by_flag = watch.select("protocol", F.explode(flags).alias("key")).where("key IS NOT NULL").select("protocol", F.lit("flag").alias("kind"), F.col("key").cast("binary").alias("key"))
    wanted = by_key.unionByName(by_flag)
    each = events.select(F.struct(*events.columns).alias("event"), F.monotonically_increasing_id().alias("row"), event_keys(events).alias("keys")).select("event", "row", F.inline("keys"))
    if tag:
        hits = each.join(wanted.distinct(), ["kind", "key"]).groupBy("row", "protocol").agg(F.first("event").alias("event"))
        return hits.select("event.*", "protocol")
    hits = each.join(wanted.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    return hits.groupBy("row").agg(F.first("event").alias("event")).select("event.*")


def prefilter(transactions: DataFrame, votes: bool = False, failed: bool = False) -> DataFrame:
    """Drop votes and failed transactions unless asked for; plain predicates that reach the scan."""
    if not votes:
        transactions = transactions.where("NOT is_vote")
    if not failed:
        transactions = transactions.where("success")
    return transactions


def split_valid(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the rest with the names of the rules they break.

    A rule that gives null counts as broken.
    """
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken_rules", broken)
    return marked.where("size(broken_rules) = 0").drop("broken_rules"), marked.where("size(broken_rules) > 0")
