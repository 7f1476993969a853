"""Near copies on five-word shingles: SimHash blocks, exact Jaccard, and an exact join for the rest.

Two texts are near copies where the sets of their five-word shingles (words as
in ``simhash``; a shorter text is one shingle) have a Jaccard similarity of 0.8
or more. Equal sets are one node throughout.

SimHash with pigeonhole blocks (``simhash.links``, on five words) finds close
fingerprints, and each link is verified on the sets. Fingerprints of texts at 0.8
differ in about 10 bits of 64, too many for blocks that still select, so a
prefix-filtered join on the same shingle hashes adds the links that blocks miss;
it misses none. All sets are ordered alike, and two sets with that similarity
share a shingle among the first ``n - ceil(0.8 n) + 1`` of each. The order: a
third of all hashes (the least) come first, of these the ones that no other set
holds before the others; then the rest; shingles of very many texts (a sample
tells which, any choice is right) last. So a set with as many shingles of its own
as its prefix has room for can have no near copy and is done after one shuffle
of that third, and a common passage makes no large bucket.

Of the sets that are left, each is verified with its SimHash neighbours and with
the bucket leader that it meets most often (of texts made from one text, that one
leads), so that a large group becomes one component; then the pairs that share a
bucket and are not yet in one component are made, without those that share too few
prefix shingles or whose parity sketches show them too far apart, and verified.
A parity sketch has, for each cell of a set's hashes, whether their number is odd;
two sets differ in at least as many shingles as their sketches in bits, so no near
pair is lost. Buckets that the same sets meet in are one bucket with a weight.
Components come from ``simhash.components``.

Defined cases: null, empty and blank texts have an empty set and are copies of
each other; null ids come last in a component; rows that agree in id and text
count as one; an empty table gives an empty result; other columns stay. Columns
that start with ``__tf_`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm._common import bounded_batches, by_batch, text_bytes, wide_row_key, written
from tallyflow.llm.simhash import SEED, components, fingerprint_of, links, shingle_hashes

WIDTH = 5
#: Share of all hashes that comes first in the order.
FIRST = 3
#: Texts that the sample of common shingles aims at, and from how many of them on a shingle is common.
SAMPLE = 20_000
COMMON = 50
#: Members up to which the pairs of a bucket are made in step with other buckets.
SMALL = 64
#: Members of a bucket that one task pairs; larger buckets are dealt as pairs of chunks.
CHUNK = 4096
#: Pairs that a task holds before it sends them.
PAIRS = 500_000
#: A parity sketch has 64 bits, doubled until it has one for each shingle, at most 7 times.
WIDEST = 7
#: Sketch words that are compared at once.
COMPARED = 1 << 20


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes of one text, in order."""
    return np.unique(shingle_hashes(text, WIDTH))


def parity_sketch(hashes: np.ndarray) -> bytes:
    """A bit for each cell of the set's hashes, set where their number is odd."""
    cells = 64 << min(WIDEST, max(0, (len(hashes) - 1).bit_length() - 6))
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Parity sketches of many sets, compared at the width of the narrower."""

    def __init__(self, sketches: np.ndarray):
        self.sketches = sketches
        self.level = np.array([len(s).bit_length() - 4 for s in sketches], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in, and rows of, the sketches of this level and those of the next, folded to it."""
        if level not in self.tables:
            own, wider = np.flatnonzero(self.level == level), np.flatnonzero(self.level == level + 1)
            words = 1 << level
            narrow = np.frombuffer(b"".join(self.sketches[own]), "<u8").reshape(-1, words)
            wide = np.frombuffer(b"".join(self.sketches[wider]), "<u8").reshape(-1, 2 * words)
            place = np.zeros(len(self.level), np.int64)
            place[own], place[wider] = np.arange(len(own)), len(own) + np.arange(len(wider))
            self.tables[level] = place, np.concatenate([narrow, wide[:, :words] ^ wide[:, words:]])
        return self.tables[level]

    def least_apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of sets a number of shingles that they differ in at least."""
        apart = np.zeros(len(i), np.int64)
        low = np.minimum(self.level[i], self.level[j])
        comparable = np.maximum(self.level[i], self.level[j]) - low <= 1
        for level in np.unique(low[comparable]).tolist():
            place, rows = self._table(level)
            at = np.flatnonzero(comparable & (low == level))
            step = max(1, COMPARED >> level)
            for part in (at[a : a + step] for a in range(0, len(at), step)):
                apart[part] = np.bitwise_count(rows[place[i[part]]] ^ rows[place[j[part]]]).sum(axis=1)
        return apart


def split_set(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a set that comes first in the order, and what the prefix needs beyond it."""
    first, rest = hashes[: (cut := np.searchsorted(hashes, np.uint64((1 << 64) // FIRST)))], hashes[cut:]
    if common.size and len(hashes):
        seen = [common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x for x in (first, rest)]
        last = np.concatenate([first[seen[0]], rest[seen[1]]])
        first, rest = first[~seen[0]], np.concatenate([rest[~seen[1]], last])
    return first, rest[: max(0, prefix_size(len(hashes)) - len(first))]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that very many texts of a sample hold."""
    rows = texts.count()
    share = max(1, rows // SAMPLE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *map(shingle_set, text_bytes(batch["text"]))]).view(np.int64))], names=["h"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").dropDuplicates(["text"]).mapInArrow(by_batch(run), "h long")
    found = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(COMMON, rows // share // 200))
    return np.sort(np.array([r.h for r in found.select("h").collect()], np.int64).view(np.uint64))


def marked_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, rid, key (equal for equal sets), fp, size, sketch, first and tail of each row."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), wide_row_key(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    common = df.sparkSession.sparkContext.broadcast(common_shingles(slim))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, WIDTH) for t in text_bytes(batch["text"])]
        sets = list(map(np.unique, hashes))
        keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        fps = np.array(list(map(fingerprint_of, hashes)), np.uint64).view(np.int64)
        first, tail = zip(*[split_set(s, common.value) for s in sets], strict=True)
        return pa.RecordBatch.from_arrays(
            [batch["id"], batch["rid"], pa.array(keys), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), pa.array(list(map(parity_sketch, sets)), pa.binary()), _lists(list(first)), _lists(list(tail))],
            names=["id", "rid", "key", "fp", "size", "sketch", "first", "tail"],
        )

    return slim.mapInArrow(by_batch(run), "id long, rid binary, key long, fp long, size int, sketch binary, first array<long>, tail array<long>")


def _held_by_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, key) the ones whose h another key holds; nothing but the last row is kept between batches."""
    last_h = last_key = np.empty(0, np.int64)
    met = False  # whether the last row has been sent
    for batch in batches:
        h, key = np.concatenate([last_h, batch["h"].to_numpy()]), np.concatenate([last_key, batch["key"].to_numpy()])
        if not h.size:
            continue
        same = np.append(h[1:] == h[:-1], False)
        shared = same | np.append(False, same[:-1])
        if last_h.size:
            shared[0] = same[0] and not met
            met = bool(shared[-1]) if len(h) > 1 else met
        else:
            met = bool(shared[-1])
        last_h, last_key = h[-1:], key[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(h[shared]), pa.array(key[shared])], names=["h", "key"])


def open_nodes(nodes: DataFrame) -> DataFrame:
    """key, fp, size, sketch, open (size without shingles that no other set is known to hold) and prefix (without these) of the nodes that may have a near copy."""
    bounded_batches(nodes.sparkSession, 50_000)
    each = nodes.select("key", F.explode("first").alias("h")).repartition("h").sortWithinPartitions("h", "key")
    shared = each.mapInArrow(_held_by_others, "h long, key long")
    of_key = shared.groupBy("key").agg(F.collect_list("h").alias("shared"))
    ordered = F.array_sort("shared")  # below a third of all hashes signed numbers are in the same order
    n = F.col("size")
    room = (n - F.ceil(4 * n / 5) + 1).cast("int") - F.col("n_first") + F.size("shared")
    slim = nodes.select("key", "fp", "size", "sketch", F.size("first").alias("n_first"), "tail").join(of_key, "key", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<long>")))
    prefix = F.concat(F.slice(ordered, F.lit(1), F.greatest(F.lit(0), F.least(room, F.size("shared")))), "tail")
    own = F.col("n_first") - F.size("shared")
    return written(slim.select("key", "fp", "size", "sketch", (n - own).alias("open"), prefix.alias("prefix")).where("size(prefix) > 0"), "open-nodes")


def whole_buckets(fn, names: tuple[str, ...]):
    """Lift a function on arrays of whole buckets, sorted by bucket, to what ``mapInArrow`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch[n].to_numpy(zero_copy_only=False) for n in names]
            held = [np.concatenate(pair) for pair in zip(held, new, strict=True)] if held else new
            cut = int(np.searchsorted(held[0], held[0][-1], "left")) if held[0].size else 0  # the last bucket may go on
            if cut:
                yield from fn(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held and held[0].size:
            yield from fn(*held)

    return run


def _alike(size_a: np.ndarray, size_b: np.ndarray, open_a: np.ndarray, open_b: np.ndarray) -> np.ndarray:
    """Whether two sets can be near: what both may hold is at most the lesser open part."""
    return 9 * np.minimum(open_a, open_b) >= 4 * (size_a + size_b)


def _counted(u: list[np.ndarray], v: list[np.ndarray], w: list[np.ndarray]) -> pa.RecordBatch:
    a, b, n = (np.concatenate([np.empty(0, np.int64), *x]) for x in (u, v, w))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    total = np.add.reduceat(n[order], starts) if len(starts) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(total)], names=["u", "v", "n"])


def _open_pairs(buckets: np.ndarray, keys: np.ndarray, sizes: np.ndarray, opens: np.ndarray, roots: np.ndarray, weights: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket that may be near and are not of one component, with the weight of the buckets they share."""
    sizes, opens, near = sizes.astype(np.int64), opens.astype(np.int64), Sketches(sketches)

    def kept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        pick = np.flatnonzero((roots[i] != roots[j]) & _alike(sizes[i], sizes[j], opens[i], opens[j]))
        return pick[9 * near.least_apart(i[pick], j[pick]) <= sizes[i[pick]] + sizes[j[pick]]]

    low, high = np.searchsorted(buckets, buckets, "left"), np.searchsorted(buckets, buckets, "right")
    u, v, w, held = [], [], [], 0
    small = high - low <= SMALL
    step, at = 1, np.flatnonzero(small & (high - np.arange(len(buckets)) > 1))
    while at.size:
        pick = at[kept(at, at + step)]
        u.append(keys[pick])
        v.append(keys[pick + step])
        w.append(weights[pick])
        step += 1
        at = at[high[at] - at > step]
    yield _counted(u, v, w)
    u, v, w = [], [], []
    for a in np.unique(low[~small]).tolist():
        b = int(high[a])
        own, weight = keys[a:b], weights[a]
        names, place, members = np.unique(roots[a:b], return_inverse=True, return_counts=True)
        most = place == members.argmax()
        # A member outside the largest component meets that component and the members after it.
        for i in np.flatnonzero(~most).tolist():
            meets = most.copy()
            meets[i + 1 :] = True
            others = np.flatnonzero(meets)
            pick = others[kept(np.full(len(others), a + i), a + others)]
            if pick.size:
                u.append(np.full(pick.size, own[i]))
                v.append(own[pick])
                w.append(np.full(pick.size, weight))
                held += pick.size
            if held > PAIRS:
                yield _counted(u, v, w)
                u, v, w, held = [], [], [], 0
    if u:
        yield _counted(u, v, w)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of at least 0.8."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right, near = batch["a"], batch["b"], []
        for i in range(batch.num_rows):
            x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(5 * both >= 4 * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    bounded_batches(pairs.sparkSession)
    held = pairs.join(sets.select(F.col("key").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("hashes").alias("b")), "v")
    return written(held.select("u", "v", "a", "b").mapInArrow(by_batch(run), "u long, v long"), "near-pairs")


def sets_of(keys: DataFrame, marked: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and hashes of the nodes in ``keys``, from one row of each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["key"], _lists([shingle_set(t) for t in text_bytes(batch["text"])])], names=["key", "hashes"])

    bounded_batches(df.sparkSession)
    rows = marked.join(keys, "key", "left_semi").groupBy("key").agg(F.min("rid").alias("rid"))
    texts = df.select(wide_row_key(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    found = texts.join(rows, "rid").dropDuplicates(["key"]).select("key", "text")
    return written(found.mapInArrow(by_batch(run), "key long, hashes array<long>"), "sets")


def near_links(nodes: DataFrame, marked: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v) between node keys that keep all components of near copies."""
    spark = df.sparkSession
    nodes = open_nodes(nodes)
    members = written(nodes.select("key", F.explode("prefix").alias("bucket")), "members")
    # Buckets with the same members (a common passage makes many) are one, of their number's weight.
    marks = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"mark_{i}") for i in (1, 2)]
    alike = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")
    buckets = written(alike.groupBy("n", "mark_1", "mark_2").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("same")).select("bucket", "n", "same"), "buckets")
    sized = written(members.join(buckets, "bucket"), "sized")
    # How much of a set its buckets hold, each as often as it has members: of texts made from one, that one has most.
    weights = sized.groupBy("key").agg(F.sum(F.col("n") * F.col("same")).alias("met")).join(nodes.select("key", "size", "open"), "key").select("key", "size", "open", (F.col("met") / F.col("size")).alias("weight"))
    shared = written(sized.join(weights, "key"), "shared")

    # Close fingerprints: equal ones with the least key that has them, others by their blocks.
    faces = written(nodes.groupBy("fp").agg(F.min("key").alias("face")), "faces")
    equal = nodes.join(faces, "fp").where("key <> face").select(F.col("key").alias("u"), F.col("face").alias("v"))
    close = links(faces.select("fp"))
    for side in ("u", "v"):
        close = close.join(faces.select(F.col("fp").alias(side), F.col("face").alias(f"{side}_key")), side)
    candidates = _led(shared).unionByName(equal).unionByName(close.select(F.col("u_key").alias("u"), F.col("v_key").alias("v")))
    found = _verified(candidates, marked, df, id_col, text_col)
    roots = components(found).withColumnRenamed("node", "key")
    rooted = written(shared.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")

    open_ = written(rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "open-buckets")
    # A member of a large bucket goes to every pair of chunks that has its own.
    chunks = F.ceil(2 * F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("key"), chunks)
    places = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.xxhash64("bucket", F.least(own, j.cast("long")), F.greatest(own, j.cast("long"))))
    dealt = rooted.join(open_, "bucket").select(F.explode(F.when(F.col("n") <= CHUNK, F.array("bucket")).otherwise(places)).alias("place"), "same", "key", "size", "open", "root")
    dealt = dealt.join(nodes.select("key", "sketch"), "key")
    bounded_batches(spark, 20_000)
    pairs = dealt.repartition("place").sortWithinPartitions("place", "key").mapInArrow(whole_buckets(_open_pairs, ("place", "key", "size", "open", "root", "same", "sketch")), "u long, v long, n long")
    # Beyond its prefix a set of n shingles has ceil(0.8 n) - 1 more, and that is all that can be common besides.
    pairs = pairs.groupBy("u", "v").agg(F.sum("n").alias("n"))
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("key").alias(side), F.col("size").cast("long").alias(f"size_{side}")), side)
    # (and no more than the lesser open part, which the tasks have seen to)
    most = F.col("n") + F.ceil(4 * F.greatest("size_u", "size_v") / 5) - 1
    pairs = written(pairs.where(9 * most >= 4 * (F.col("size_u") + F.col("size_v"))).select("u", "v"), "open")
    return found.unionByName(verified(pairs, sets_of(_ends(pairs), marked, df, id_col, text_col)))


def _led(shared: DataFrame) -> DataFrame:
    """(u, v): each node with the bucket leader (the node of most weight) that it meets most often."""
    leaders = written(shared.groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("top")).select("bucket", F.col("top.key").alias("leader")), "leaders")
    counted = shared.select("bucket", "key", "same").join(leaders, "bucket").where("key <> leader").groupBy("key", "leader").agg(F.sum("same").alias("n"))
    return counted.groupBy("key").agg(F.max_by("leader", F.struct("n", "leader")).alias("v")).select(F.col("key").alias("u"), "v")


def _verified(candidates: DataFrame, marked: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    pairs = written(candidates.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    return verified(pairs, sets_of(_ends(pairs), marked, df, id_col, text_col))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("key")).distinct().unionByName(pairs.select(F.col("v").alias("key")).distinct()).distinct()


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component of near copies the one with the least id."""
    bounded_batches(df.sparkSession)
    df = df.drop("__tf_rid")
    marked = written(marked_rows(df, id_col, text_col), "shingles")
    nodes = marked.select("key", "fp", "size", "sketch", "first", "tail").dropDuplicates(["key"])
    found = components(near_links(nodes, marked.select("key", "rid"), df, id_col, text_col)).withColumnRenamed("node", "key")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    best = marked.groupBy("key").agg(first.alias("best")).join(found, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best"))
    keep = best.select(F.col("best.rid").alias("__tf_rid"))
    keyed = df.withColumn("__tf_rid", wide_row_key(F.col(id_col), F.col(text_col)))
    return keyed.join(keep, "__tf_rid", "left_semi").dropDuplicates(["__tf_rid"]).drop("__tf_rid")
