"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches. A run is a Parquet table of (h, n_docs, max_id), one
row for each line hash, each file sorted by hash. A new batch is reduced to such a
table (map-side combined, so a line that a third of all documents hold sends one
row a task) and merge-anti-joined with the runs so far: a line that a run already
knows to be in ``min_docs`` documents, and in one with an id at least as large, is
settled and adds nothing. What is left becomes a run of level 0. When a level has
``FAN_OUT`` runs they are compacted into one run of the next level, which adds
counts and settles more lines. Nothing is rewritten more often than there are
levels. Batches come in descending ranges of ids, so a line's largest id is in its
first batch and repeats in later ones settle; any other order gives the same
result. With a path the runs are kept: ``LineRuns.open`` finds them again, and a
later call adds its documents as further batches.

A line's key is the line without ASCII blanks at both ends and with A-Z in
lower case. Keys of at least ``min_chars`` code points in at least ``min_docs``
documents lose all their lines but those of the largest id that holds them.

Defined cases: null or empty text is one empty line; a null id is the smallest
id; repeated rows are documents of their own, and those that share the largest
id all keep the line; a text whose lines all go becomes empty; an empty table
gives an empty result. Added columns start with ``__tf_``; columns of ``df`` with
these names are replaced.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm._common import bounded_batches, by_batch, documents, new_path, row_key, schema_with, text_bytes, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN_OUT = 2
BLANKS = b" \t\n\x0b\x0c\r"
LEAST = -(2**63)

_KEYS = "rid long, id long, h binary, at array<int>"
_RUN = "h binary, n_docs long, max_id long"


def line_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """128-bit hash of each long enough key of a text, with its line numbers."""
    found: dict[bytes, list[int]] = {}
    for number, line in enumerate(text.lower().split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(BLANKS)
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                found.setdefault(xxhash.xxh3_128_digest(key), []).append(number)
    return found


def _emit_keys(min_chars: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rids, ids, hashes, at = [], [], [], []
        for rid, doc, text in zip(batch["rid"].to_pylist(), batch["id"].to_pylist(), text_bytes(batch["text"]), strict=True):
            for h, numbers in line_keys(text, min_chars).items() if text else ():
                rids.append(rid)
                ids.append(doc)
                hashes.append(h)
                at.append(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array(rids, pa.int64()), pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(at, pa.list_(pa.int32()))], names=["rid", "id", "h", "at"]
        )

    return by_batch(run)


class LineRuns:
    """Levelled sorted runs of (h, n_docs, max_id); kept under ``path`` if there is one.

    Each state of the runs is a small table of (level, run) names, numbered; a state
    is written after its runs, so a call that fails leaves the one before it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_out: int = FAN_OUT, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.fan_out, self.min_docs, self.state = spark, (path or new_path(spark, "line-runs")).rstrip("/"), fan_out, min_docs, 0
        self.levels: list[list[str]] = [[]]

    @staticmethod
    def open(spark: SparkSession, path: str, fan_out: int = FAN_OUT, min_docs: int = MIN_DOCS) -> LineRuns:
        """The runs kept under a path, none if nothing is there yet."""
        runs = LineRuns(spark, path, fan_out, min_docs)
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{runs.path}/states/*/_SUCCESS")
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
        runs.state = max((int(f.getPath().getParent().getName()) for f in found), default=0)
        if runs.state:
            for r in sorted(spark.read.parquet(f"{runs.path}/states/{runs.state}").collect(), key=lambda r: (r.level, r.place)):
                while len(runs.levels) <= r.level:
                    runs.levels.append([])
                runs.levels[r.level].append(r.run)
        return runs

    def save(self) -> None:
        rows = [(level, place, run) for level, own in enumerate(self.levels) for place, run in enumerate(own)]
        self.state += 1
        self.spark.createDataFrame(rows, "level int, place int, run string").coalesce(1).write.parquet(f"{self.path}/states/{self.state}")

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(f"{self.path}/{run}")

    def _sorted_run(self, df: DataFrame) -> str:
        """Adding up deals by hash; each file of a run is sorted by h."""
        name = f"run-{uuid.uuid4().hex}"
        merged = df.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))
        merged.sortWithinPartitions("h").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def runs(self) -> list[DataFrame]:
        return [self._read(run) for level in self.levels for run in level]

    def merged(self) -> DataFrame:
        """All runs as one table with one row for each hash."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], _RUN)
        return runs[0] if len(runs) == 1 else self._read(self._sorted_run(_union(runs)))

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch (h, n_docs, max_id) that can still change a line's fate: a merge-anti-join with each run."""
        for run in self.runs():
            known = run.where(F.col("n_docs") >= self.min_docs).select(F.col("h").alias("known"), F.col("max_id").alias("known_id")).hint("merge")
            batch = batch.join(known, (F.col("h") == F.col("known")) & (F.col("known_id") >= F.col("max_id")), "left_anti")
        return batch

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (h, id), one row for each document and line hash."""
        counted = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("max_id"))
        self.levels[0].append(self._sorted_run(self.unsettled(counted)))
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._sorted_run(_union([self._read(r) for r in self.levels[level]])))
            self.levels[level] = []
            level += 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _drop_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, n_lines, n_dropped, digests = [], [], [], []
    for text, drop in zip(text_bytes(batch["__tf_text"]), batch["__tf_drop"].to_pylist(), strict=True):
        lines = (text or b"").split(b"\n")
        gone = set(drop or ())
        kept = (text or b"") if not gone else b"\n".join(line for i, line in enumerate(lines) if i not in gone)
        texts.append(text if not gone else kept)
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        digests.append(hashlib.sha256(kept).hexdigest())
    names = [n for n in batch.schema.names if n not in ("__tf_text", "__tf_drop")]
    arrays = [batch[n] for n in names] + [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests)]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "__tf_kept", "__tf_n_lines", "__tf_n_dropped", "__tf_sha256"])


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT, runs: LineRuns | None = None
) -> DataFrame:
    """``df`` with __tf_kept (the text left), __tf_n_lines, __tf_n_dropped and __tf_sha256.

    With kept ``runs`` the documents of earlier calls count too, and these documents are added for later ones.
    """
    bounded_batches(df.sparkSession)
    df = df.drop(*(c for c in df.columns if c.startswith("__tf_") and c not in (id_col, text_col)))
    rid = row_key(F.col(id_col), F.col(text_col))
    slim = df.select(rid.alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), F.col(text_col).alias("text"))
    keys = written(slim.mapInArrow(_emit_keys(min_chars), _KEYS), "line-keys")

    kept = runs is not None
    runs = runs if kept else LineRuns(df.sparkSession, None, fan_out, min_docs)
    bounds = sorted(set(keys.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)), reverse=True) if batches > 1 else []
    for high, low in zip([None, *bounds], [*bounds, None], strict=True):
        own = keys if high is None else keys.where(F.col("id") <= int(high))
        runs.add((own if low is None else own.where(F.col("id") > int(low))).select("h", "id"))
    frequent = runs.merged().where(F.col("n_docs") >= min_docs).select("h", "max_id")
    if kept:
        runs.save()

    # Rows that repeat in id and text have the same lines; one of them speaks for all.
    lost = keys.join(frequent, "h").where("id <> max_id").select("rid", "id", F.explode("at").alias("line"))
    drops = lost.groupBy("rid", "id").agg(F.collect_set("line").alias("__tf_drop")).withColumnRenamed("rid", "__tf_rid").withColumnRenamed("id", "__tf_id")
    whole = df.withColumn("__tf_rid", rid).withColumn("__tf_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)))
    joined = whole.join(drops, ["__tf_rid", "__tf_id"], "left").drop("__tf_rid", "__tf_id").withColumnRenamed(text_col, "__tf_text")
    out = schema_with(joined.drop("__tf_text", "__tf_drop"), "__tf_kept string, __tf_n_lines long, __tf_n_dropped long, __tf_sha256 string")
    return joined.mapInArrow(by_batch(_drop_lines), out)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__tf_n_lines").alias("n_lines"), F.col("__tf_n_dropped").alias("n_dropped"), F.col("__tf_sha256").alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
frequent AS (
  SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT keyed.doc_id, i, line, coalesce(keyed.doc_id <> last_id, false) AS gone
  FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
