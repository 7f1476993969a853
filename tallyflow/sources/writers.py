"""Keyed, replayable writes to Parquet tables laid out by time bucket.

Parquet has no transactions, so every write can be repeated: a batch that is
delivered again finds its keys stored and adds nothing, or rewrites the same
buckets with the same rows. A table's checkpoint row is written last. Buckets
that a batch does not touch are neither listed, read nor written. Where the key does
not tell the bucket, an index does (see ``key_index``).

Where a batch brings many buckets of few rows, those of a month share one folder, named by
the month: files then grow with the rows and not with the hours. The name of a bucket begins
with that of its month, so two names are of one time if one begins with the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import time_bucket
from tallyflow.operators.keyed import absent, first_by_key, last_by_key
from tallyflow.schemas import TABLES
from tallyflow.session import scratch_path
from tallyflow.sources.key_index import KeyIndex


#: Rows of a bucket that go to one file.
FILE_ROWS = 1_000_000
#: A batch of more than FEW buckets shares folders in months whose buckets have fewer than THIN rows on average.
FEW, THIN = 256, 10_000
#: Rows of a shared folder that go to one file: few, so that all tasks have their part.
SHARED_ROWS = 100_000
#: Characters of a month in a bucket's name.
MONTH = len("2024-01")


def bucket_of(time: Column, unit: str) -> Column:
    """Name of a row's bucket: the start of its time unit as text."""
    return time_bucket(time, unit).cast("timestamp_ntz").cast("string")


def with_bucket(df: DataFrame, table: str, unit: str | None = None) -> DataFrame:
    return df.withColumn("bucket", bucket_of(F.col("timestamp"), unit or TABLES[table].bucket))


def shared_months(spark: SparkSession, path: str, table: str, rows: dict[str, int]) -> set[str]:
    """Months whose buckets share a folder: those that have one and, if ``rows`` (of each bucket of a
    batch) are many thin buckets, those that the batch is the first to store. What a month begins with, it keeps."""
    if not TABLES[table].shares:
        return set()
    have = folders(spark, path)
    shared = {name for name in have if len(name) == MONTH}
    if len(rows) > FEW:
        thin: dict[str, list[int]] = {}
        for name, n in rows.items():
            if name:
                thin.setdefault(name[:MONTH], []).append(n)
        stored = {name[:MONTH] for name in have}
        shared |= {month for month, each in thin.items() if month not in stored and sum(each) < THIN * len(each)}
    return shared


def in_folders(df: DataFrame, months: set[str]) -> DataFrame:
    """Rows with the name of their folder as ``bucket``."""
    month = F.substring("bucket", 1, MONTH)
    return df.withColumn("bucket", F.when(month.isin(sorted(months)), month).otherwise(F.col("bucket"))) if months else df


def folder_rows(rows: dict[str, int], months: set[str]) -> dict[str, int]:
    """Rows of each folder from those of each bucket."""
    out: dict[str, int] = {}
    for name, n in rows.items():
        folder = name[:MONTH] if name and name[:MONTH] in months else name
        out[folder] = out.get(folder, 0) + n
    return out


def overlapping(have: Iterable[str], names: Iterable[str]) -> set[str]:
    """Of the folders in ``have`` those that may hold rows of the named buckets or folders."""
    names = set(names)
    inside = {n[:MONTH] for n in names if n}
    months = {n for n in names if n and len(n) == MONTH}
    return {h for h in have if h in names or (len(h) == MONTH and h in inside) or h[:MONTH] in months}


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has any bucket."""
    files, where = _path(spark, f"{path}/*=*")
    return bool(files.globStatus(where))


def folders(spark: SparkSession, path: str, column: str = "bucket") -> dict[str, str]:
    """The partitions of a table by name, with their folders."""
    files, where = _path(spark, path)
    if not files.exists(where):
        return {}
    # all paths in one text, as each call to the JVM takes its time and a table may have tens of thousands of folders
    listed = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(files.listStatus(where))
    paths = spark.sparkContext._gateway.new_array(spark._jvm.Object, len(listed))
    spark._jvm.System.arraycopy(listed, 0, paths, 0, len(listed))
    found = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", spark._jvm.java.util.Arrays.asList(paths)).split("\n")
    start = f"{column}="
    return {unquote(name[len(start) :]): full for full in found if (name := full.rpartition("/")[2]).startswith(start)}


def read_folders(spark: SparkSession, path: str, column: str = "bucket", names: Sequence[str] | None = None, schema=None) -> DataFrame | None:
    """Rows of some partitions (default: all) of a table; None if it has none of them.

    A folder that buckets share is read whole, and ``bucket`` is its name. Other partitions are not read, nor listed unless they are few beside many."""
    have = folders(spark, path, column)
    wanted = set(have) if names is None else overlapping(have, names) if column == "bucket" else set(names) & have.keys()
    chosen = [have[n] for n in have if n in wanted]
    if not chosen:
        return None
    if schema is None:
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(chosen[0]).schema] + [f"`{column}` string"])
    reader, others = spark.read.schema(schema), sorted(have.keys() - wanted)
    with _listing(spark):
        if len(others) * 4 > len(chosen):
            return reader.option("basePath", path).parquet(*chosen)
        whole = reader.parquet(path)
    return whole.where(~F.col(column).isin(others)) if others else whole


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks for each core, not by one task for each folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_folder(spark: SparkSession, path: str, column: str, name: str) -> None:
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
    files, where = _path(spark, f"{path}/{column}={escaped}")
    files.delete(where, True)


def bucket_rows(batch: DataFrame) -> dict[str, int]:
    """Rows of each bucket in a batch: as many entries as buckets."""
    return {r["bucket"]: r["n"] for r in batch.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def _dealt(df: DataFrame, rows: dict[str, int], shared_rows: int) -> DataFrame:
    """Rows by bucket to as many tasks as there are; a bucket of more than FILE_ROWS rows goes to several, a shared folder of more than ``shared_rows`` too."""
    most = {name: shared_rows if name and len(name) == MONTH else FILE_ROWS for name in rows}
    large = {name: -(-n // most[name]) for name, n in rows.items() if n > most[name]}
    tasks = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(rows) + sum(large.values()))
    if not large:
        return df.repartition(max(1, tasks), "bucket")
    over = F.coalesce(F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[F.col("bucket")], F.lit(1))
    return df.withColumn("__file", F.pmod(F.xxhash64(*[c for c in df.columns if c != "bucket"]), over)).repartition(max(1, tasks), "bucket", "__file").drop("__file")


def write_buckets(df: DataFrame, path: str, table: str, mode: str, rows: dict[str, int] | None = None, shared_rows: int | None = None) -> None:
    """Lay rows out by bucket, sorted inside files.

    With the ``rows`` of each bucket many small buckets are written side by side; without
    them the shuffle measures, joins small ones and splits large ones.
    """
    spec = TABLES[table]
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in spec.sort if c.lstrip("-") in df.columns]
    laid = df.hint("rebalance", "bucket") if rows is None else _dealt(df, rows, shared_rows or SHARED_ROWS)
    out = laid.sortWithinPartitions("bucket", *order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
    if looked_up := [c for c in spec.looked_up if c in df.columns]:
        # filters from 1 KB to 1 MB, as small as the values of a file allow
        out = out.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number", "10")
        for column in looked_up:
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
    out.parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator:
    """A function that writes a frame to the shared scratch folder and reads it back, so that its
    source may be overwritten. What was written is deleted when the block ends."""
    root = scratch_path(spark, "staging")
    number = iter(range(1000))

    def staged(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield staged
    finally:
        files, where = _path(spark, root.removesuffix("/staging"))
        files.delete(where, True)


def insert_if_absent(batch: DataFrame, root: str, table: str, order: str = "seq", key: Sequence[str] | None = None, index: KeyIndex | None = None, entries: Sequence[KeyIndex] = ()) -> int:
    """Add rows whose key is not stored; of rows in the batch with one key the first by ``order``.

    A key without the timestamp takes an ``index`` that knows where rows with the key may
    be. The indexes in ``entries`` get entries of the new rows. Returns the number of rows
    added.
    """
    spark, path = batch.sparkSession, f"{root}/{table}"
    key = key or TABLES[table].key
    with staging(spark) as staged:
        rows = staged(with_bucket(first_by_key(batch, key, order).drop(order), table))
        counts = bucket_rows(rows)
        # The bucket follows from a key with the timestamp.
        stored = read_folders(spark, path, names=index.buckets_of(rows) if index else list(counts), schema=rows.schema)
        if stored is not None:
            rows = staged(absent(rows, stored, key))
            counts = bucket_rows(rows)
        if counts:
            months = shared_months(spark, path, table, counts)
            rows, counts = in_folders(rows, months), folder_rows(counts, months)
            for each in entries:
                each.add(rows)
            write_buckets(rows, path, table, "append", counts)
    return sum(counts.values())


def upsert_last(batch: DataFrame, root: str, table: str, order: str = "seq") -> int:
    """Store the last row by ``order`` of each key over what is there; rewrites touched buckets only."""
    spark, spec = batch.sparkSession, TABLES[table]
    path = f"{root}/{table}"
    with staging(spark) as staged:
        plain = staged(with_bucket(last_by_key(batch, spec.key, order).drop(order), table))
        counts = bucket_rows(plain)
        old = read_folders(spark, path, names=list(counts), schema=plain.schema)
        months = shared_months(spark, path, table, counts)
        plain, counts = in_folders(plain, months), folder_rows(counts, months)
        whole = plain if old is None else staged(plain.unionByName(absent(old, plain, spec.key)))
        if counts:
            write_buckets(whole, path, table, "overwrite", counts if old is None else bucket_rows(whole))
    return sum(counts.values())


def write_clustered(df: DataFrame, root: str, table: str, unit: str | None = None) -> None:
    """Append ``df`` by bucket (of another time unit, if given), sorted inside files by the table's sort columns."""
    write_buckets(with_bucket(df, table, unit), f"{root}/{table}", table, "append")


def compact(spark: SparkSession, root: str, table: str, buckets: Sequence[str]) -> None:
    """Rewrite the files of some buckets as few sorted ones."""
    path = f"{root}/{table}"
    with staging(spark) as staged:
        found = read_folders(spark, path, names=[str(b) for b in buckets])
        if found is not None:
            rows = staged(found)
            # few files, also of a shared folder, or the layout job would pick it again
            write_buckets(rows, path, table, "overwrite", bucket_rows(rows), FILE_ROWS)


def prune(spark: SparkSession, root: str, table: str, cutoff) -> int:
    """Delete rows strictly older than ``cutoff``: old buckets whole, the boundary bucket by a rewrite."""
    path, unit = f"{root}/{table}", TABLES[table].bucket
    have = folders(spark, path)
    edge = spark.range(1).select(bucket_of(F.lit(cutoff).cast("timestamp"), unit)).first()[0]
    # Names of buckets sort like their times, a month before its own. Both may hold the boundary.
    edges = overlapping(have, [edge])
    stored = read_folders(spark, path, names=[n for n in have if n <= edge])
    if stored is None:
        return 0
    limit = F.lit(cutoff).cast(stored.schema["timestamp"].dataType)
    counts = {r.bucket: r.n for r in stored.where(F.col("timestamp") < limit).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    with staging(spark) as staged:
        cut = edges & counts.keys()
        if cut:
            rest = staged(stored.where(F.col("bucket").isin(sorted(cut)) & (F.col("timestamp") >= limit)))
            left = bucket_rows(rest)
            if left:
                write_buckets(rest, path, table, "overwrite")
            for name in cut - left.keys():
                drop_folder(spark, path, "bucket", name)
        for name in counts.keys() - edges:
            drop_folder(spark, path, "bucket", name)
    return sum(counts.values())


def with_target(rows: DataFrame, table: str) -> DataFrame:
    """Stored rows with the bucket of their ``to_time`` as ``to_bucket``, null without one; ``move_rows`` takes a copy of this."""
    return rows.withColumn("to_bucket", bucket_of(F.col("to_time"), TABLES[table].bucket))


def move_rows(rows: DataFrame, root: str, table: str, indexes: Sequence[KeyIndex] = ()) -> None:
    """Give stored rows the time in ``to_time``, in the bucket of that time.

    ``rows`` are a copy of all rows of some folders, with their ``bucket`` and ``to_bucket``; those that
    stay have no ``to_time``. So what a folder holds afterwards follows from the copy alone. New rows are added
    before old ones go, so it can be repeated after a failure at any place. A folder with
    rows that get another time inside it is written once, with these replaced.
    """
    spark, spec, path = rows.sparkSession, TABLES[table], f"{root}/{table}"
    columns = [c for c in rows.columns if c not in ("to_time", "to_bucket", "bucket")]
    moves = F.col("to_time").isNotNull()
    plan = rows.where(moves).withColumns({"from_time": F.col("timestamp"), "from_bucket": F.col("bucket"), "timestamp": F.col("to_time"), "bucket": F.col("to_bucket")})
    counts = bucket_rows(plan)
    months = shared_months(spark, path, table, counts)
    plan, counts = in_folders(plan, months), folder_rows(counts, months)
    inside = F.col("from_bucket") == F.col("bucket")
    found = plan.groupBy("from_bucket").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("leave")).collect()
    changed, left = {r["from_bucket"] for r in found if r["inside"]}, {r["from_bucket"]: r["leave"] for r in found if r["leave"]}
    staying, leaving = rows.where(~moves).select(*columns, "bucket"), plan.where(~inside).select(*[F.col("from_time" if c == "timestamp" else c).alias(c) for c in columns], F.col("from_bucket").alias("bucket"))
    kept = bucket_rows(staying)
    fresh = plan.select(*columns, "bucket")

    def only(df: DataFrame, names: Iterable[str]) -> DataFrame:
        # as many short rows as folders, of which Spark does not know the size
        return df.join(F.broadcast(spark.createDataFrame([(n,) for n in sorted(names)], "bucket string")), "bucket", "left_semi").select(*columns, "bucket")

    with staging(spark) as staged:
        there = read_folders(spark, path, names=list(counts), schema=fresh.schema)
        if there is not None and _meet(fresh, there, spec.key):
            fresh = staged(absent(fresh, there, spec.key))
            counts = bucket_rows(fresh)
        if counts:
            for each in indexes:
                each.add(fresh)
        if changed:
            whole = staying.unionByName(leaving).unionByName(fresh)
            write_buckets(only(whole, changed), path, table, "overwrite", {n: kept.get(n, 0) + left.get(n, 0) + counts.get(n, 0) for n in changed})
        added = {n: rows for n, rows in counts.items() if n not in changed}
        if added:
            write_buckets(only(fresh, added) if changed else fresh, path, table, "append", added)
        rest = {n: kept.get(n, 0) + counts.get(n, 0) for n in left}
        if any(rest.values()):
            write_buckets(only(staying.unionByName(fresh), left), path, table, "overwrite", {n: rows for n, rows in rest.items() if rows})
        for name in sorted(n for n, rows in rest.items() if not rows):
            drop_folder(spark, path, "bucket", name)


def _meet(rows: DataFrame, stored: DataFrame, key: Sequence[str]) -> bool:
    """Whether keys may be in both, by their hashes. If not, as when no write has failed, rows need not be compared."""
    hashed = F.xxhash64(*key).alias("hash")
    return not rows.select(hashed).join(stored.select(hashed), "hash", "left_semi").isEmpty()


def write_checkpoint(progress: DataFrame, root: str, stream: str, reason: str = "size") -> None:
    """Replace the stream's row with the progress of the batch just stored.

    ``progress`` is the one row of ``batch_progress``; a batch without events leaves the row as it is.
    """
    row = progress.where("max_observed_at IS NOT NULL").select(
        F.lit(stream).alias("stream_name"), F.col("max_slot").alias("last_processed_slot"), F.col("max_observed_at").alias("last_observed_at"), F.lit(f"flush_reason={reason}").alias("notes")
    )
    found = row.collect()  # at most one
    if found:
        row.sparkSession.createDataFrame(found, row.schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream_name").parquet(f"{root}/ingestion_checkpoints")
