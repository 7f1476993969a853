"""Removal of repeated substrings by external induced sorting of sharded text.

A byte goes where a string of ``length`` bytes covers it that also starts
anywhere else. Texts are first named by a 128-bit hash: copies of one text are
one text with a count (a text of ``length`` bytes or more that has a copy goes
whole), so groups of copies never multiply.

Sharding. Every start of a ``length``-byte string is put under the least hash
of the string's 32-byte grams. Equal strings have equal least hashes, wherever
they stand, so a shard that gets all segments (runs of starts under one hash,
with the bytes they cover) of a hash sees every repeat of their strings.
Hashes that occur once need no shard. About one start in 185 begins a segment,
so the hashes are a small fraction of the text; only text that holds a hash
seen elsewhere travels. A segment of more than ``CUT`` starts (text that repeats
itself) is cut where its hash occurs again, so that a period of any kind gives
equal parts. Segments that agree byte for byte are joined before the shuffle and
leave their owners behind. Of a hash with more than ``HOT_SEGMENTS`` segments only
starts go on whose whole string has a hash seen twice; such hashes are counted
map-side first and dealt evenly, and what is left of them is joined over all
tasks before the shards are dealt.

Sorting. A shard lays its distinct segments end to end in a memory-mapped scratch
file (the task's own; nothing in it outlives the task) and sorts them by
``induced_sort``, whose queues of (suffix, common prefix) tuples live on disk
beyond a fixed share of memory; neighbours with a common prefix of ``length``
bytes mark their starts. Segments that several texts share byte for byte are
sorted once. Covered bytes go back to their text as spans.

Defined cases: null counts as empty; strings are bytes of UTF-8, matches never
cross texts, overlaps count and strings are judged on the input; repeated rows
are copies; null ids are ordinary values; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm._common import bounded_batches, by_batch, documents, row_key, text_bytes, written
from tallyflow.llm.induced_sort import neighbours, scratch_array

LENGTH = 400
GRAM = 32
#: Bytes of segments in one shard on average, before equal segments are joined.
SHARD_BYTES = 6 << 20
#: A hash with more segments is hot.
HOT_SEGMENTS = 1000
#: Starts of a segment from which on it is cut.
CUT = 4096
SEPARATOR = 0xFF  # no byte of UTF-8
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(of: int) -> np.ndarray:
        steps = np.full(size, of, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return powers(_FACTOR), powers(_INVERSE)


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` consecutive bytes."""
    up, down = _powers(1 << max(12, int(len(text) + 1).bit_length()))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments_of(texts: list[bytes], length: int, gram: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its segments: hash, first start, end of starts, and weight.

    The weight is 2 if the hash occurs more than once among the segment's
    grams, so that the segment may repeat inside itself, else 1.
    """
    empty = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    out = [empty] * len(texts)
    own = [i for i, t in enumerate(texts) if len(t) >= length]
    if not own:
        return out
    sizes = np.array([len(texts[i]) for i in own])
    ends = np.cumsum(sizes)
    h = gram_hashes(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), gram)
    width = length - gram + 1
    least = window_minima(h, width)
    valid = np.repeat(np.arange(len(own)), sizes)[: len(least)]
    valid = np.where(np.arange(len(least)) + length <= ends[valid], valid, -1)
    new = np.append(True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]))
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(least))
    keep = valid[first] >= 0
    first, stop = first[keep], stop[keep]
    value = least[first]
    # Places of the segments' hashes among the grams, by (rank of the hash, place).
    ranked = np.unique(value)
    small = np.flatnonzero(h <= ranked[-1])
    rank = np.minimum(np.searchsorted(ranked, h[small]), len(ranked) - 1)
    hit = ranked[rank] == h[small]
    places = np.sort(rank[hit] * (len(h) + 1) + small[hit])
    base = np.searchsorted(ranked, value) * (len(h) + 1)
    seen = np.searchsorted(places, base + stop - 1 + width, "left") - np.searchsorted(places, base + first, "left")
    seen = np.minimum(seen, 2)
    owner = valid[first]
    long = np.flatnonzero(stop - first > CUT)
    if len(long):
        first, stop, value, seen, owner = cut_long(first, stop, value, seen, owner, long, places, base, width)
    cuts = np.searchsorted(owner, np.arange(len(own) + 1))
    starts = ends - sizes
    for k, i in enumerate(own):
        a, b = cuts[k], cuts[k + 1]
        out[i] = (value[a:b], first[a:b] - starts[k], stop[a:b] - starts[k], seen[a:b])
    return out


def cut_long(first, stop, value, seen, owner, long, places, base, width):
    """Cut segments of many starts at occurrences of their hash, about every ``CUT`` starts.

    A part begins at the first occurrence after so many starts of the part before,
    so text with a period is cut at the same phase again and again.
    """
    rows = []
    for i in long.tolist():
        a, b = np.searchsorted(places, (base[i] + first[i], base[i] + stop[i] - 1 + width))
        own = places[a:b] - base[i]
        edges, at = [], first[i]
        while (k := np.searchsorted(own, at + CUT)) < len(own) and own[k] < stop[i]:
            at = own[k]
            edges.append(at)
        rows += [(s, e, i) for s, e in zip([first[i], *edges], [*edges, stop[i]], strict=True)]
    rest = np.setdiff1d(np.arange(len(first)), long)
    new = np.array(rows, np.int64).reshape(-1, 3)
    source = np.concatenate([rest, new[:, 2]])
    starts, ends = np.concatenate([first[rest], new[:, 0]]), np.concatenate([stop[rest], new[:, 1]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], *(x[source[order]] for x in (value, seen, owner))


def _digest(length: int, gram: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in text_bytes(batch["text"])]
        found = segments_of(texts, length, gram)
        offsets = pa.array(np.append(0, np.cumsum([len(f[0]) for f in found])), pa.int32())
        columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
        struct = pa.StructArray.from_arrays(
            [pa.array(columns[0].view(np.int64)), *(pa.array(c.astype(np.int32)) for c in columns[1:])], names=["hash", "first", "stop", "weight"]
        )
        return pa.RecordBatch.from_arrays(
            [batch["id"], batch["rid"], pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.ListArray.from_arrays(offsets, struct)],
            names=["id", "rid", "tid", "n_bytes", "sha", "segments"],
        )

    return by_batch(run)


_SEGMENTS = "array<struct<hash: long, first: int, stop: int, weight: int>>"
_SPANS = "array<struct<start: long, stop: long>>"


def _hot_windows(length: int):
    """A hash of the whole string at each start of a hot segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, tid, wanted in zip(text_bytes(batch["text"]), batch["tid"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                hashes = gram_hashes(np.frombuffer(text, np.uint8), length).view(np.int64)
                at = np.concatenate([np.arange(s["first"], s["stop"], dtype=np.int32) for s in wanted if s["hot"]])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array([tid] * len(at), pa.binary()), pa.array(at)], names=["window", "tid", "at"])

    return run


def wanted_parts(wanted: list[dict], alive: list[int] | None) -> Iterator[tuple[int, int, int]]:
    """(hash, first start, end of starts) of a text's segments; of hot ones the runs of starts still alive."""
    starts = np.array(alive or (), np.int64)
    for s in wanted:
        if not s["hot"]:
            yield s["hash"], s["first"], s["stop"]
            continue
        own = starts[np.searchsorted(starts, s["first"]) : np.searchsorted(starts, s["stop"])]
        if len(own):
            for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                yield s["hash"], int(run[0]), int(run[-1]) + 1


def _parts(batch: pa.RecordBatch, length: int, hot: bool | None = None) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(tid, hash, first start, bytes) of all wanted parts, or of those of hot or of other hashes."""
    for text, tid, wanted, alive in zip(text_bytes(batch["text"]), *(batch[c].to_pylist() for c in ("tid", "wanted", "alive")), strict=True):
        for key, first, stop in wanted_parts(wanted if hot is None else [s for s in wanted if s["hot"] == hot], alive):
            yield tid, key, first, text[first : stop - 1 + length]


def _contents(length: int, hot: bool):
    """Distinct contents of a task's segments with how often they occur: copies are joined before the shuffle."""

    def rows(held: dict[tuple[int, bytes], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["hash", "bytes", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}
        size = 0
        for batch in batches:
            for _, key, _, own in _parts(batch, length, hot):
                seen = held.get((key, own), 0)
                held[key, own] = seen + 1
                size += 0 if seen else len(own) + 200
                if size > 1 << 25:
                    yield rows(held)
                    held, size = {}, 0
        yield rows(held)

    return run


def _owners(length: int):
    """Which text holds which content, and where."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(xxhash.xxh3_128_digest(own), tid, first) for tid, _, first, own in _parts(batch, length)]
        cids, tids, firsts = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(tids, pa.binary()), pa.array(firsts, pa.int32())], names=["cid", "tid", "first"])

    return by_batch(run)


def repeated_starts(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which starts of a text have another start with the same ``length`` bytes.

    Segments lie end to end, each with one separator; ``ends`` has the places after these.
    """
    flagged = scratch_array(len(text), bool)

    def fits(starts: np.ndarray) -> np.ndarray:
        return starts + length < ends[np.searchsorted(ends, starts, "right")]

    def pair(first: np.ndarray, second: np.ndarray, common: np.ndarray) -> None:
        long = np.flatnonzero((common >= length) & (first >= 0))
        a, b = first[long], second[long]
        both = fits(a) & fits(b)
        flagged[a[both]] = True
        flagged[b[both]] = True

    neighbours(text, length, pair)
    return flagged


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings at the given (sorted) starts cover."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.append(0, gaps + 1)].tolist(), (starts[np.append(gaps, len(starts) - 1)] + length).tolist(), strict=True))


def _sort_shard(length: int):
    """Spans (cid, start, stop) of each content's repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[bytes, list[int]] = {}  # digest to (occurrences, place, size)
        with tempfile.TemporaryFile() as scratch:
            total = 0
            for batch in batches:
                for own, n in zip(batch["bytes"], batch["n"].to_pylist(), strict=True):
                    own = own.as_buffer()
                    found = times.setdefault(xxhash.xxh3_128_digest(own), [0, total, own.size])
                    found[0] += n
                    if found[1] == total:
                        scratch.write(own)
                        scratch.write(bytes([SEPARATOR]))
                        total += own.size + 1
            if not total:
                return
            scratch.flush()
            text = np.memmap(scratch, np.uint8, "r", shape=(total,))
            ends = np.fromiter((at + size + 1 for _, at, size in times.values()), np.int64, len(times))
            flagged = repeated_starts(text, ends, length)
            cids, starts, stops = [], [], []
            for cid, (n, at, size) in times.items():
                found = np.arange(size - length + 1) if n > 1 else np.flatnonzero(flagged[at : at + size - length + 1])
                spans = spans_of(found, length)
                cids += [cid] * len(spans)
                starts += [a for a, _ in spans]
                stops += [b for _, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["cid", "start", "stop"])

    return run


def _kept(batch: pa.RecordBatch) -> pa.RecordBatch:
    gone, digests = [], []
    for text, spans in zip(text_bytes(batch["text"]), batch["spans"].to_pylist(), strict=True):
        merged: list[list[int]] = []
        for a, b in sorted((s["start"], s["stop"]) for s in spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        edges = [0, *(x for span in merged for x in span), len(text)]
        gone.append([{"start": a, "stop": b} for a, b in merged])
        digests.append(hashlib.sha256(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))).hexdigest())
    spans = pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.RecordBatch.from_arrays([batch["tid"], spans, pa.array(digests, pa.string())], names=["tid", "gone", "left_sha"])


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_segments: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all rows (id, tid, n_bytes, sha); one row for each distinct text
    (tid, rid, n, n_bytes); texts with repeats (tid, text, spans)."""
    spark = df.sparkSession
    bounded_batches(spark)
    slim = df.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    digests = written(slim.mapInArrow(_digest(length, gram), f"id long, rid long, tid binary, n_bytes long, sha string, segments {_SEGMENTS}"), "digests")
    texts = digests.groupBy("tid").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n"), F.first("n_bytes").alias("n_bytes"), F.first("segments").alias("segments"))
    texts = written(texts, "texts")

    each = texts.select("tid", "rid", F.inline("segments"))
    repeated = each.groupBy("hash").agg(F.sum("weight").alias("seen"), F.count(F.lit(1)).alias("n")).where("seen > 1").select("hash", (F.col("n") > hot_segments).alias("hot"))
    wanted = each.join(repeated, "hash").groupBy("tid", "rid").agg(F.collect_list(F.struct("hash", "first", "stop", "hot")).alias("wanted"))
    # The text of the row that stands for each wanted text; repeated rows come as often as they are there.
    held = wanted.join(slim.drop("id"), "rid").select("tid", "text", "wanted").mapInArrow(_same_text, "tid binary, text string, wanted array<struct<hash: long, first: int, stop: int, hot: boolean>>")
    held = written(held, "held")

    # A hot hash has segments in very many texts. There a start goes on only if its whole string's hash is seen twice:
    # what is left is what the texts share, so few different contents remain however many texts there are.
    is_hot = F.exists("wanted", lambda x: x["hot"])
    alive = held.withColumn("alive", F.lit(None).cast("array<int>"))
    if not held.where(is_hot).isEmpty():
        windows = held.where(is_hot).mapInArrow(_hot_windows(length), "window long, tid binary, at int")
        # Written, so that the join below deals both sides itself and can split windows that very many texts share.
        again = written(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"), "windows")
        starts = windows.join(again, "window").groupBy("tid").agg(F.array_sort(F.collect_set("at")).alias("alive"))
        alive = alive.where(~is_hot).unionByName(held.where(is_hot).join(starts, "tid", "left"))
        alive = written(alive, "alive")

    total = held.select(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["first"] + F.lit(length)))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    schema = "hash long, bytes binary, n long"
    # Every task sends the contents of hot hashes once; they are joined before one task gets them.
    joined = alive.where(is_hot).mapInArrow(_contents(length, True), schema).groupBy("hash", "bytes").agg(F.sum("n").alias("n"))
    contents = alive.mapInArrow(_contents(length, False), schema).unionByName(joined)
    found = contents.repartition(shards, "hash").mapInArrow(_sort_shard(length), "cid binary, start int, stop int")
    placed = alive.mapInArrow(_owners(length), "cid binary, tid binary, first int").join(found, "cid")
    spans = placed.groupBy("tid").agg(F.collect_list(F.struct((F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))).alias("spans"))
    return digests.drop("segments", "rid"), texts.drop("segments"), held.select("tid", "text").join(spans, "tid")


def _same_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [xxhash.xxh3_128_digest(t or b"") == tid for t, tid in zip(text_bytes(batch["text"]), batch["tid"].to_pylist(), strict=True)]
        yield batch.filter(pa.array(same, pa.bool_()))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans of each row.

    ``n_bytes`` is the size before removal; ``spans`` are the maximal removed runs of
    bytes in order, each from ``start`` to before ``stop``, none where all is kept.
    """
    digests, texts, hit = repeats(df, id_col, text_col, length, gram, shard_bytes, hot_segments)
    partly = hit.mapInArrow(by_batch(_kept), f"tid binary, gone {_SPANS}, left_sha string").dropDuplicates(["tid"])
    none = hashlib.sha256(b"").hexdigest()
    copied = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    by_text = texts.join(partly, "tid", "left").where(copied | F.col("gone").isNotNull()).select(
        "tid",
        F.when(copied, whole).otherwise(F.col("gone")).alias("gone"),
        F.when(copied, F.lit(none)).otherwise(F.col("left_sha")).alias("left_sha"),
    )
    rows = digests.join(written(by_text, "by-text"), "tid", "left").withColumn("spans", F.coalesce("gone", F.array().cast(_SPANS)))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return rows.select(F.col("id").alias(id_col), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.coalesce("left_sha", "sha").alias("kept_sha256"), "spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
