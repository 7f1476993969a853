"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations are rebuilt (see ``rebuilt``), and each distinct sequence of first turns
is a node. A node is known by its depth and the running XOR of two 64-bit hashes of
(place, role, text), so prefixes need no text; running values are taken in chunks of
turns and then over the chunks, so that one long conversation is shared by many tasks.
The least member and the depth name a node too: a conversation owns the nodes of its
path from some depth on.

Sums over subtrees follow the parent-edge forest by centroid decomposition:

* The root is split off; the subtrees of first turns are the components.
* A component of more than ``LARGE`` nodes is split at its centroid, the smallest
  subtree of at least half the nodes, with joins: the conversations through the centroid
  tell which nodes lie below it and under which child. The totals of the components below
  are added to the nodes on the path from the centroid to the component's top, and all
  parts, each at most half as large, go on to the next round.
* Components that are small enough are dealt by their names and split on inside tasks in
  the same way.

Defined cases: rows without conv_id are left out; null role or text is empty; turns with
the same number follow (role, text); repeated rows are turns of their own; for negative
ids c - c % 5 is the next multiple towards zero; an empty table has no nodes; other
columns are ignored. Rows that agree in all four columns are ordered by one task, as
nothing tells them apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm._common import written

#: Turns shared at most, and how far apart the conversations are that share them.
SHARED, STEP = 9, 5
#: Bits of the turns of a chunk, and of the ids whose ends are joined before they are hashed.
CHUNK_BITS, END_BITS = 10, 16
#: Nodes from which on a component is split by joins.
LARGE = 50_000
#: Nodes of components that a task splits together.
TOGETHER = 20_000

NODE = ("conv", "depth")
SUMS = ("leaves", "saved")


def _hashes(*of) -> tuple[Column, Column]:
    return F.xxhash64(*of), F.xxhash64(F.lit(0x9E3779B9), *of)


def ordered_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, id, pid, h1, h2, bytes), and where each part of a conversation begins (conv, pid, first, before, len). Written.

    Rows are sorted over all tasks by ranges of (conversation, turn, role, text), so one
    conversation may span tasks; ``id`` grows by one from row to row inside a part.
    """
    turns = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    h1, h2 = _hashes("role", "text")
    laid = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("pid"), h1.alias("h1"), h2.alias("h2"), F.octet_length("text").cast("long").alias("bytes")
    )
    laid = written(laid, "turns")
    parts = laid.groupBy("conv", "pid").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv")  # a row for each part
    before = F.coalesce(F.sum("n").over(own.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return laid, written(parts.select("conv", "pid", "first", before.cast("long").alias("before"), F.sum("n").over(own).alias("len")), "parts")


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, depth, last, h1, h2, bytes), and all conversations (conv, length).

    Conversation c has the first h turns of c - c % 5, with h = crc32(c) % 9, and then its
    own turns after its first h.
    """
    turns, parts = ordered_turns(df)
    place = (F.col("id") - F.col("first") + F.col("before") + 1).alias("place")
    convs = parts.groupBy("conv").agg(F.max("len").alias("len"))
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).alias("h")
    own = convs.select("conv", "len", shared, (F.col("conv") - F.col("conv") % STEP).alias("source"))
    source = convs.select(F.col("conv").alias("source"), F.col("len").alias("source_len"))
    kept = F.least("h", F.coalesce("source_len", F.lit(0)))
    plans = own.join(source, "source", "left").select("conv", "source", "h", kept.alias("kept"), (kept + F.greatest(F.lit(0), F.col("len") - F.col("h"))).alias("length"))
    plans = written(plans, "plans")

    heads = turns.join(parts.where(F.col("before") < SHARED), ["conv", "pid"]).select(F.col("conv").alias("source"), place, "h1", "h2", "bytes").where(F.col("place") < SHARED)
    taken = plans.where("kept > 0").join(heads, "source").where("place <= kept").select("conv", F.col("place").alias("depth"), "length", "h1", "h2", "bytes")
    places = parts.join(plans, "conv").select("conv", "pid", "first", "before", "h", "kept", "length")
    rest = turns.join(places, ["conv", "pid"]).select("conv", place, "h", "kept", "length", "h1", "h2", "bytes").where("place > h").select("conv", (F.col("kept") + F.col("place") - F.col("h")).alias("depth"), "length", "h1", "h2", "bytes")
    every = taken.unionByName(rest)
    return every.select("conv", "depth", (F.col("depth") == F.col("length")).alias("last"), "h1", "h2", "bytes"), plans.select("conv", "length")


def paths(turns: DataFrame) -> DataFrame:
    """``turns`` with the hashes of the prefix that ends here (x1, x2) and of the one before (y1, y2). Written."""
    z1, z2 = _hashes("depth", "h1", "h2")
    chunk = F.shiftright(F.col("depth") - 1, CHUNK_BITS).alias("chunk")
    each = turns.select("conv", "depth", "last", "bytes", chunk, z1.alias("z1"), z2.alias("z2"))
    inside = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = each.withColumns({f"r{k}": F.bit_xor(f"z{k}").over(inside) for k in (1, 2)})
    chunks = each.groupBy("conv", "chunk").agg(F.bit_xor("z1").alias("c1"), F.bit_xor("z2").alias("c2"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("conv", "chunk", *[F.coalesce(F.bit_xor(f"c{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    found = running.join(before, ["conv", "chunk"])
    x = [F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)]
    return written(found.select("conv", "depth", "last", "bytes", x[0].alias("x1"), x[1].alias("x2"), x[0].bitwiseXOR(F.col("z1")).alias("y1"), x[1].bitwiseXOR(F.col("z2")).alias("y2")), "paths")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (depth, x1, x2, part) to the hash of each node's parts, comma-joined; holds one part."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in key] + [pa.array([state.hexdigest()])], names=["depth", "x1", "x2", "ends_sha256"])

    for batch in batches:
        done: list[tuple] = []
        for *new, ids in zip(*(batch[c].to_pylist() for c in ("depth", "x1", "x2", "ids")), strict=True):
            if new == key:
                state.update(f",{ids}".encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = new, hashlib.sha256(ids.encode())
        if done:
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=["depth", "x1", "x2", "ends_sha256"])
    if key:
        yield row()


def ends(walked: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of nodes where conversations end. Ids are joined in parts before they are dealt by node."""
    zero = F.lit(0).cast("long")
    every = walked.where("last").select("conv", "depth", "x1", "x2").unionByName(convs.where("length = 0").select("conv", zero.alias("depth"), zero.alias("x1"), zero.alias("x2")))
    # a part holds at most 2 ** END_BITS ids
    parts = every.groupBy("depth", "x1", "x2", F.shiftright("conv", END_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    laid = parts.repartition("depth", "x1", "x2").sortWithinPartitions("depth", "x1", "x2", "part")
    return laid.mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(walked: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes below the root: conv, depth, parent, n_convs, n_children, leaf, saved (own), ends_sha256, x1, x2. Written."""
    nodes = walked.groupBy("depth", "x1", "x2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("y1").alias("y1"), F.min("y2").alias("y2"))
    nodes = written(nodes.join(ends(walked, convs), ["depth", "x1", "x2"], "left"), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv").alias("parent"))
    # the root has no row above, so its children, which may be many, have no partner
    placed = nodes.where("depth > 1").join(above, ["depth", "y1", "y2"]).select(*nodes.columns, "parent").unionByName(nodes.where("depth = 1").withColumn("parent", F.lit(None).cast("long")))
    placed = written(placed, "placed")
    children = placed.where("depth > 1").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    none = F.coalesce("n_children", F.lit(0).cast("long"))
    return written(
        placed.join(children, list(NODE), "left").select(
            *NODE, "parent", "n_convs", none.alias("n_children"), (none == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "x1", "x2",
        ),
        "trie",
    )


# Centroid decomposition


def centroid_sums(parent: Sequence[int], weights: np.ndarray) -> np.ndarray:
    """Sums over subtrees of a forest, parents before children; -1 above tops.

    Splits each component at its centroid, adds the centroid's weight and the totals of
    the components below it along the path to the top, and goes on with all parts.
    """
    n = len(parent)
    out, own = [[0] * weights.shape[1] for _ in range(n)], weights.tolist()
    label, size = [0] * n, [0] * n
    parts: dict[int, list[int]] = {}
    for v in range(n):
        label[v] = label[parent[v]] if parent[v] >= 0 else v
        parts.setdefault(label[v], []).append(v)
    todo = list(parts.items())
    fresh = n  # labels from here on are new
    while todo:
        name, inside = todo.pop()
        for v in inside:
            size[v] = 1
        for v in reversed(inside):
            if v != inside[0]:
                size[parent[v]] += size[v]
        centre = inside[0]
        for v in inside:
            if 2 * size[v] >= len(inside) and size[v] <= size[centre]:
                centre = v
        below: dict[int, list[int]] = {}
        total = list(own[centre])
        label[centre] = -1
        for v in inside:
            p = parent[v]
            if v == centre or v == inside[0]:
                continue
            if p == centre:
                label[v], fresh = fresh, fresh + 1
            elif label[p] != name:
                label[v] = label[p]
            if label[v] != name:
                below.setdefault(label[v], []).append(v)
                for k, x in enumerate(own[v]):
                    total[k] += x
        v = centre
        while True:
            for k, x in enumerate(total):
                out[v][k] += x
            if v == inside[0]:
                break
            v = parent[v]
        todo += below.items()
        upper = [v for v in inside if label[v] == name]
        if upper:
            todo.append((name, upper))
    return np.array(out, np.int64).reshape(n, weights.shape[1])


def _split_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (top_conv, top_depth, depth) with their sums inside their components, a few components at a time."""

    def rolled(table: pa.Table) -> pa.RecordBatch:
        key = list(zip(table["conv"].to_pylist(), table["depth"].to_pylist(), strict=True))
        number = {k: i for i, k in enumerate(key)}
        tops = zip(table["top_conv"].to_pylist(), table["top_depth"].to_pylist(), strict=True)
        parent = [-1 if k == top else number[above, k[1] - 1] for k, top, above in zip(key, tops, table["parent"].to_pylist(), strict=True)]
        sums = centroid_sums(parent, np.stack([table[c].to_numpy() for c in SUMS], axis=1))
        for k, c in enumerate(SUMS):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(sums[:, k]))
        return table.combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        tops = np.stack([batch["top_conv"].to_numpy(), batch["top_depth"].to_numpy()], axis=1)
        new = np.flatnonzero((tops[1:] != tops[:-1]).any(axis=1)) + 1
        same = held and (held[-1]["top_conv"][-1].as_py(), held[-1]["top_depth"][-1].as_py()) == tuple(tops[0].tolist())
        cut = 0 if held and not same else int(new[-1]) if len(new) else None
        if cut is not None and sum(b.num_rows for b in held) + cut >= TOGETHER:
            held += [batch.slice(0, cut)] if cut else []
            yield rolled(pa.Table.from_batches(held))
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield rolled(pa.Table.from_batches(held))


def _sizes(large: DataFrame, steps: DataFrame) -> DataFrame:
    """``large`` with the number of nodes below each node, itself included.

    A conversation that passes a node has all nodes it owns below it, but for the owner
    of the node, whose earlier ones are above.
    """
    chains = large.groupBy("conv").agg(F.count(F.lit(1)).alias("own"), F.min("depth").alias("begin"))
    through = steps.join(chains.select("conv", "own"), "conv").groupBy(F.col("node").alias("conv"), "depth").agg(F.sum("own").alias("own"))
    return large.join(through, list(NODE)).join(chains.select("conv", "begin"), "conv").withColumn("size", F.col("own") - F.col("depth") + F.col("begin")).drop("own", "begin")


def _round(state: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One split of each component: the parts, and what is added to the nodes from centroids to tops. Both written."""
    top = ["top_conv", "top_depth"]
    totals = state.where("conv = top_conv AND depth = top_depth").select(*top, F.col("size").alias("total"))
    least = F.min_by(F.struct("conv", "depth", "size"), F.struct("size", -F.col("depth"), "conv"))
    centres = written(state.join(totals, top).where("2 * size >= total").groupBy(*top).agg(least.alias("c")).select(*top, F.col("c.conv").alias("centre"), F.col("c.depth").alias("at"), F.col("c.size").alias("cut")), "centres")
    on = centres.select(*top, F.col("centre").alias("node"), F.col("at").alias("depth"))
    passing = steps.join(on, ["node", "depth"]).select("conv", *top, F.col("depth").alias("at"))
    child = steps.select("conv", (F.col("depth") - 1).alias("at"), F.col("node").alias("child"))
    passing = passing.join(child, ["conv", "at"], "left")
    marked = written(state.join(passing, ["conv", *top], "left"), "marked")
    below = F.coalesce(F.col("depth") >= F.col("at"), F.lit(False))
    amounts = marked.where(below).groupBy(*top).agg(*[F.sum(c).alias(c) for c in SUMS])
    path = steps.join(centres.withColumnRenamed("centre", "conv"), "conv").where("depth >= top_depth AND depth <= at").select(F.col("node").alias("conv"), "depth", *top, "cut")
    added = written(path.join(amounts, top).select(*NODE, *SUMS, "cut"), "added")
    moved = [F.when(below, F.col("child")).otherwise(F.col("top_conv")).alias("top_conv"), F.when(below, F.col("at") + 1).otherwise(F.col("top_depth")).alias("top_depth")]
    rest = marked.where(~(below & (F.col("depth") == F.col("at"))))  # all but the centroids
    size = (F.col("size") - F.coalesce("cut", F.lit(0))).alias("size")
    parts = rest.join(added.select(*NODE, "cut"), list(NODE), "left").select(*[c for c in state.columns if c not in (*top, "size")], *moved, size)
    return written(parts, "parts"), added.select(*NODE, *SUMS)


def rolled_up(nodes: DataFrame, walked: DataFrame, large: int = LARGE) -> DataFrame:
    """``nodes`` with ``leaves`` and ``saved`` summed over subtrees."""
    firsts = nodes.where("depth = 1").select("x1", "x2", F.col("conv").alias("top_conv"))
    tops = walked.where("depth = 1").join(firsts, ["x1", "x2"]).select("conv", "top_conv", F.lit(1).cast("long").alias("top_depth"))
    placed = written(nodes.join(tops, "conv"), "components")
    top = ["top_conv", "top_depth"]
    sizes = placed.groupBy(*top).agg(F.count(F.lit(1)).alias("component"))
    over = written(sizes.where(F.col("component") > large).select(*top), "large")
    whole, adds = placed, None
    if not over.isEmpty():
        whole = placed.join(over, top, "left_anti")
        members = walked.join(tops.join(over, top).select("conv"), "conv").select("conv", "depth", "x1", "x2")
        steps = written(members.join(nodes.select("depth", "x1", "x2", F.col("conv").alias("node")), ["depth", "x1", "x2"]).select("conv", "depth", "node"), "steps")
        state = written(_sizes(placed.join(over, top), steps), "sized")
        while not state.isEmpty():
            parts, added = _round(state, steps)
            adds = added if adds is None else adds.unionByName(added)
            totals = parts.where("conv = top_conv AND depth = top_depth").where(F.col("size") > large).select(*top)
            whole = whole.unionByName(parts.drop("size").join(totals, top, "left_anti"))
            state = written(parts.join(totals, top), "state")
    laid = whole.select(*placed.columns).repartition(*top).sortWithinPartitions(*top, "depth")
    rolled = laid.mapInArrow(_split_in_task, laid.schema).drop(*top)
    if adds is None:
        return rolled
    # a centroid is in no part, so its sums are only what was added
    own = nodes.drop(*SUMS).join(rolled.select(*NODE, *SUMS).unionByName(adds).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in SUMS]), list(NODE))
    return own.select(*nodes.columns)


def prefix_trie(df: DataFrame, large: int = LARGE) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (conv_id, turn, role, text), the root included."""
    spark = df.sparkSession
    turns, convs = rebuilt(df)
    walked = paths(turns)
    nodes = trie(walked, convs)
    rolled = written(rolled_up(nodes, walked, large), "rolled")
    names = {"conv": "conv_id", "leaves": "n_leaves", "saved": "saved_tokens"}
    count, least = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    columns = [F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children", *[F.col(c).alias(names[c]) for c in SUMS], "ends_sha256"]
    below = rolled.select(*columns)
    if not count:
        return below
    first = rolled.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in SUMS])
    ending = ends(walked.limit(0), convs).where("depth = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    root = first.crossJoin(ending).select(  # one row each
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).cast("long").alias("n_convs"), "n_children",
        F.greatest(F.col("leaves"), F.lit(1).cast("long")).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    return below.unionByName(root)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


CRC = """xor(list_reduce(flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""

OP13_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
  lens AS (SELECT c, count(*) AS len FROM own GROUP BY 1),
  plan AS (SELECT l.c, l.len, l.c - l.c % 5 AS p, {CRC.format("l.c")} % 9 AS h FROM lens l),
  kept AS (SELECT plan.*, least(h, coalesce(s.len, 0)) AS k FROM plan LEFT JOIN lens s ON s.c = p),
  turns AS (SELECT q.c, o.pos AS d, role, txt FROM kept q JOIN own o ON o.c = q.p AND o.pos <= q.k
    UNION ALL SELECT q.c, q.k + o.pos - q.h, role, txt FROM kept q JOIN own o ON o.c = q.c AND o.pos > q.h),
  keyed AS (SELECT c, d, strlen(txt) AS bytes, string_agg(sha256(role) || sha256(txt), '') OVER (PARTITION BY c ORDER BY d) AS key FROM turns),
  node AS (SELECT d, key, min(c) AS conv, count(*) AS n, any_value(bytes) AS bytes FROM keyed GROUP BY 1, 2),
  path AS (SELECT k.c, k.d, n.conv FROM keyed k JOIN node n ON n.d = k.d AND n.key = k.key),
  root AS (SELECT min(c) AS conv, count(*) AS n FROM lens),
  placed AS (SELECT n.conv, n.d, n.n, (n.n - 1) * n.bytes AS saved, coalesce(p.conv, root.conv) AS parent FROM node n CROSS JOIN root LEFT JOIN path p ON p.c = n.conv AND p.d = n.d - 1),
  kids AS (SELECT parent, d - 1 AS d, count(*) AS n FROM placed GROUP BY 1, 2),
  every AS (SELECT p.*, coalesce(k.n, 0) AS n_children FROM placed p LEFT JOIN kids k ON k.parent = p.conv AND k.d = p.d),
  sums AS (SELECT a.conv, a.d, count(*) FILTER (WHERE e.n_children = 0) AS leaves, sum(e.saved) AS saved FROM every e JOIN path a ON a.c = e.conv AND a.d <= e.d GROUP BY 1, 2),
  ends AS (SELECT p.conv, p.d, sha256(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c)) AS h FROM path p JOIN (SELECT c, max(d) AS d FROM turns GROUP BY 1) l ON l.c = p.c AND l.d = p.d GROUP BY 1, 2)
SELECT e.conv AS conv_id, e.d AS depth, e.parent AS parent_conv_id, e.n AS n_convs, e.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
  FROM every e JOIN sums s ON s.conv = e.conv AND s.d = e.d LEFT JOIN ends h ON h.conv = e.conv AND h.d = e.d
UNION ALL SELECT root.conv, 0, NULL, root.n, (SELECT count(*) FROM every WHERE d = 1), greatest(1, (SELECT count(*) FROM every WHERE n_children = 0)), CAST(coalesce((SELECT sum(saved) FROM every), 0) AS BIGINT),
  sha256(coalesce((SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM lens WHERE c NOT IN (SELECT c FROM turns)), '')) FROM root WHERE root.n > 0
"""
