"""Approximate nearest neighbours by learned partitions.

* On a sample of about ``SAMPLE`` rows (all, if there are fewer) tasks compute the graph
  of each row's ``DEGREE`` nearest rows. The graph is cut into parts of equal size with
  few edges between them: bisection along the slowest direction of diffusion, then moves
  that lower the cut while sizes stay within ``SLACK``.
* A small network learns from the sample in which parts a vector's neighbours lie. It
  gives each row of the table its part; a query goes to its most probable parts.
* How many, is measured: about ``TRIALS`` sampled rows are searched exhaustively, and the
  least number of parts that finds ``TARGET`` of their neighbours is taken.
* Parts are dealt in tiles of rows and tiles of queries, so that no task depends on a
  part's size. A tile scores all its pairs in double precision and returns each query's
  best. The k-th best score in ``BOUND`` sampled rows bounds what is worth returning.
* A query that finds fewer than k rows this way is searched in all parts, without bound.

Parts grow with the square root of the rows, as long as the sample can teach them.

Defined cases: vectors that are null, zero or hold null or non-finite components take no
part, nor do rows without id, nor vectors of another length than the most frequent one
(the shortest of several); a query has no row of its own id among its candidates;
repeated rows are candidates one by one, and of query rows with one id the least vector
asks; fewer than k candidates are all returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm._common import written

K, EVERY = 20, 20
SAMPLE, DEGREE, TRIALS, BOUND = 16_384, 10, 200, 4096
TARGET = 0.95
SLACK = 1.05
#: Sampled rows for each part, at least.
PART_ROWS = 32
HIDDEN, EPOCHS, BATCH, RATE = 128, 12, 256, 0.005
#: Rows of a tile at least and at most, and queries of one.
TILE_ROWS, MOST_TILE_ROWS, TILE_QUERIES = 256, 8192, 4096
SCORED = 256
SEED = 11


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows with an id and a finite vector that is not zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sampled(rows: DataFrame, n: int, about: int, seed: int) -> pa.Table:
    return (rows if n <= about else rows.sample(False, about / n, seed)).toArrow()


# Fitting


def neighbour_graph(spark: SparkSession, vectors: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each sampled vector the numbers of its nearest ones; tasks take stretches of rows."""
    n, degree = len(vectors), min(degree, len(vectors) - 1)
    shared = spark.sparkContext.broadcast(vectors)  # about SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        for batch in batches:
            own = batch["id"].to_numpy()
            for s in range(0, len(own), SCORED):
                part = own[s : s + SCORED]
                near = every[part] @ every.T
                near[np.arange(len(part)), part] = -np.inf
                found = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["id", "near"])

    found = spark.range(0, n, 1, max(1, min(32, n // 512))).mapInArrow(run, "id long, near array<long>").toArrow().sort_by("id")
    return np.array(found["near"].to_pylist()).reshape(n, degree)


def balanced_parts(near: np.ndarray, parts: int, rounds: int = 40, passes: int = 12) -> np.ndarray:
    """The part of each node of a graph; ``parts`` is a power of two, parts have equal sizes within SLACK."""
    n, degree = near.shape
    tail, head = np.repeat(np.arange(n), degree), near.ravel()
    pick, part = np.random.default_rng(SEED), np.zeros(n, np.int64)
    count = 1
    while count < parts:
        inside = part[tail] == part[head]
        a, b = tail[inside], head[inside]
        sizes = np.bincount(part, minlength=count)
        weight = np.maximum(1, np.bincount(a, minlength=n) + np.bincount(b, minlength=n))
        x = pick.standard_normal(n)
        for _ in range(rounds):
            x = 0.5 * x + 0.5 * (np.bincount(a, x[b], n) + np.bincount(b, x[a], n)) / weight
            x -= (np.bincount(part, x, count) / sizes)[part]
            x /= np.sqrt(np.bincount(part, x * x, count) / sizes)[part] + 1e-12
        order = np.lexsort((x, part))
        place = np.arange(n) - np.concatenate([[0], np.cumsum(sizes)[:-1]])[part[order]]
        part[order] = 2 * part[order] + (2 * place >= sizes[part[order]])
        count *= 2
    most = int(np.ceil(SLACK * n / parts))
    for _ in range(passes):
        links = (np.bincount(tail * parts + part[head], minlength=n * parts) + np.bincount(head * parts + part[tail], minlength=n * parts)).reshape(n, parts)
        best = links.argmax(axis=1)
        gain = links[np.arange(n), best] - links[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < most and pick.random() < 0.7:  # neighbours that swap at once would undo each other
                sizes[best[v]] += 1
                sizes[part[v]] -= 1
                part[v], moved = best[v], moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer: the log-probability of each part for a vector."""

    scale: float
    layers: list[np.ndarray]

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        w, b, u, c = self.layers
        return np.maximum(vectors * self.scale @ w + b, 0) @ u + c


def fit_router(vectors: np.ndarray, targets: np.ndarray) -> Router:
    """Learn each vector's distribution over parts; Adam on the cross entropy."""
    pick = np.random.default_rng(SEED)
    n, dim = vectors.shape
    scale = float(np.sqrt(dim) / max(np.sqrt((vectors**2).sum(axis=1).mean()), 1e-300))
    x = vectors * scale
    layers = [pick.standard_normal((dim, HIDDEN)) / np.sqrt(dim), np.zeros(HIDDEN), pick.standard_normal((HIDDEN, targets.shape[1])) / np.sqrt(HIDDEN), np.zeros(targets.shape[1])]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        order = pick.permutation(n)
        for s in range(0, n, BATCH):
            rows = order[s : s + BATCH]
            hidden = np.maximum(x[rows] @ layers[0] + layers[1], 0)
            out = hidden @ layers[2] + layers[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = (out / out.sum(axis=1, keepdims=True) - targets[rows]) / len(rows)
            back = (error @ layers[2].T) * (hidden > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(scale, layers)


def number_of_parts(n: int, sample: int) -> int:
    """A power of two near a quarter of the square root of the rows, with PART_ROWS sampled rows for each part."""
    most = max(1, min(np.sqrt(n) / 4, sample / PART_ROWS))
    return 1 << max(0, round(float(np.log2(most))))


def fit(spark: SparkSession, vectors: np.ndarray, n: int) -> Router:
    """Partition the sample's graph for a table of ``n`` rows, and learn to route."""
    parts = number_of_parts(n, len(vectors))
    if parts == 1:
        return fit_router(vectors, np.ones((len(vectors), 1)))
    near = neighbour_graph(spark, vectors)
    part = balanced_parts(near, parts)
    targets = np.bincount((np.arange(len(part))[:, None] * parts + part[near]).ravel(), minlength=len(part) * parts).reshape(-1, parts).astype(float)
    targets[np.arange(len(part)), part] += near.shape[1] / 2
    return fit_router(vectors, targets / targets.sum(axis=1, keepdims=True))


# Searching


def best_in(query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, rows' places, scores) of each query's k best rows that reach its bound, ties to smaller ids."""
    # of equal vectors only the k + 1 least ids can be among the k best, one of which may be the query's own
    order = np.argsort(ids, kind="stable")
    same = np.unique(np.ascontiguousarray(vectors[order]).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)[1]
    by_class = np.argsort(same, kind="stable")
    begin = np.searchsorted(same[by_class], same[by_class])
    keep = np.sort(order[by_class[np.arange(len(ids)) - begin <= k]])
    ids, vectors = ids[keep], vectors[keep]
    longest = np.sqrt((vectors**2).sum(axis=1).max())
    for s in range(0, len(queries), SCORED):
        near = queries[s : s + SCORED] @ vectors.T
        for i, row in enumerate(near):
            q = queries[s + i]
            room = 1e-12 * longest * np.sqrt(q @ q)  # more than products and sums of another order differ by
            row[ids == query_ids[s + i]] = -np.inf
            found = np.flatnonzero(row >= max(bounds[s + i] - room, np.finfo(float).min))
            if len(found) > k:
                found = found[row[found] >= np.partition(row[found], -k)[-k] - room]
            exact = (vectors[found] * q).sum(axis=1)  # the same for equal vectors, whatever stands beside them
            best = np.lexsort((ids[found], -exact))[:k]
            yield s + i, keep[found[best]], exact[best]


def _part_of(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.scores(matrix(batch["vector"])).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    return run


def indexed(rows: DataFrame, router: Router) -> DataFrame:
    """Every row with its part and a number of its own. Written."""
    kind = rows.schema["vector"].dataType.simpleString()
    return written(rows.mapInArrow(_part_of(router), f"id long, vector {kind}, part int").withColumn("row", F.monotonically_increasing_id()), "index")


def parts_needed(index: DataFrame, router: Router, trials: pa.Table, k: int, target: float = TARGET) -> int:
    """The least number of most probable parts that hold ``target`` of the trials' k nearest rows, found by exhaustive search."""
    ids, queries = trials["id"].to_numpy(), matrix(trials["vector"])
    bounds = np.full(len(ids), -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part, rows = batch["part"].to_numpy(), batch["id"].to_numpy()
                out = [(i, float(score), int(rows[at]), int(part[at])) for i, places, scores in best_in(ids, queries, bounds, rows, matrix(batch["vector"]), k) for at, score in zip(places, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.float64(), pa.int64(), pa.int32()), strict=True)], names=["trial", "score", "id", "part"])

    near = index.select("id", "vector", "part").mapInArrow(run, "trial long, score double, id long, part int")
    best = Window.partitionBy("trial").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("trial", "part").toArrow()  # about TRIALS times k rows
    if not near.num_rows:
        return 1
    order = np.argsort(-router.scores(queries), axis=1)
    rank = np.argsort(order, axis=1)[near["trial"].to_numpy(), near["part"].to_numpy()]
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(target * len(rank))) - 1)]) + 1


def routed(queries: DataFrame, router: Router, parts: int, bound_ids: np.ndarray, bound_vectors: np.ndarray, k: int) -> DataFrame:
    """(query_id, vector, bound, parts): each query's most probable parts, and its k-th best score in the sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, SCORED):
                part = batch.slice(s, SCORED)
                ids, vectors = part["query_id"].to_numpy(), matrix(part["vector"])
                order = np.argsort(-router.scores(vectors), axis=1)[:, :parts].astype(np.int32)
                bound = np.full(len(ids), -np.inf)
                if len(bound_ids) > k:
                    near = vectors @ bound_vectors.T
                    near[ids[:, None] == bound_ids[None, :]] = -np.inf
                    bound = np.partition(near, -k, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays([part["query_id"], part["vector"], pa.array(bound), pa.array(order.tolist(), pa.list_(pa.int32()))], names=["query_id", "vector", "bound", "parts"])

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.mapInArrow(run, f"query_id long, vector {kind}, bound double, parts array<int>")


def _search_tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, scores, found = [], [], []
        if left.num_rows and right.num_rows:
            query_ids, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
            for i, places, exact in best_in(query_ids, matrix(left["vector"]), left["bound"].to_numpy(), ids, matrix(right["vector"]), k):
                asked.append(np.full(len(places), query_ids[i]))
                scores.append(exact)
                found.append(ids[places])
        columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((asked, np.int64), (found, np.int64), (scores, np.float64))]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def tiles(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")


def searched(index: DataFrame, asked: DataFrame, k: int, tile_rows: int) -> DataFrame:
    """Best rows of each query in the parts it goes to, tile by tile."""
    each = written(asked.select("query_id", "vector", "bound", F.explode("parts").alias("part")), "asked")
    of_rows = index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", tiles(F.col("n"), tile_rows).alias("row_tiles"))
    of_queries = each.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", tiles(F.col("n"), TILE_QUERIES).alias("query_tiles"))
    grid = written(of_rows.join(of_queries, "part"), "grid")  # a row for each part

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own.removesuffix("s"))
        return df.join(F.broadcast(grid), "part").select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other.removesuffix("s")))

    queries = dealt(each, "query_id", "query_tiles", "row_tiles").groupBy("part", "row_tile", "query_tile")
    rows = dealt(index, "row", "row_tiles", "query_tiles").groupBy("part", "row_tile", "query_tile")
    return queries.cogroup(rows).applyInArrow(_search_tile(k), "query_id long, vec_id long, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found of each row of ``queries``, which has the columns of ``df``."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    alike, n = F.size("vector") == lengths["length"], lengths["count"]
    rows = rows.where(alike)
    sample = sampled(rows, n, SAMPLE, SEED)
    vectors = matrix(sample["vector"])
    router = fit(spark, vectors, n)
    parts = router.layers[3].size
    index = indexed(rows, router)
    needed = parts_needed(index, router, sampled(rows, n, TRIALS, SEED + 1), k, target)
    bound_ids, bound_vectors = sample["id"].to_numpy()[:BOUND], vectors[:BOUND]
    tile_rows = min(MOST_TILE_ROWS, max(TILE_ROWS, n // parts))

    asking = written(usable(queries, id_col, vector_col).where(alike).groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector")), "queries")
    found = written(searched(index, routed(asking, router, needed, bound_ids, bound_vectors, k), k, tile_rows), "found")
    candidates = F.lit(min(k, n - 1))
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= candidates)
    rest = written(asking.join(enough, "query_id", "left_anti"), "rest")
    if not rest.isEmpty():
        again = searched(index, routed(rest, router, parts, bound_ids[:0], bound_vectors[:0], k), k, tile_rows)
        found = found.join(rest.select("query_id"), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
