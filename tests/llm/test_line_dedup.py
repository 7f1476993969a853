from tallyflow.llm.line_dedup import OP7_SQL, LineRuns, line_dedup, op7_line_dedup
from pyspark.sql import functions as F

LONG = "This very line is repeated in many of the documents here"


def test_query_equals_sql(spark, sf, same_as_sql):
    same_as_sql(op7_line_dedup(spark, sf), OP7_SQL)


def test_largest_id_keeps_the_line(spark):
    rows = [(i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\n{LONG}") for i in range(6)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["__tf_kept"] for i in range(5)] == [f"own {i}" for i in range(5)]
    assert got[5]["__tf_kept"] == rows[5][1]
    assert got[0]["__tf_n_lines"] == 3 and got[0]["__tf_n_dropped"] == 2


def test_code_points_count_not_bytes(spark):
    short, enough = "é" * 39, "é" * 40
    df = spark.createDataFrame([(i, f"{short}\n{enough}") for i in range(5)], "doc_id long, text string")
    assert {r["__tf_n_dropped"] for r in line_dedup(df).where("doc_id < 4").collect()} == {1}


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(None, LONG), (None, LONG), (1, LONG), (1, LONG), (2, LONG), (3, None), (4, ""), (9, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS h", "3 AS at", "4 AS line")
    got = sorted((r.doc_id or -1, r["__tf_n_lines"], r["__tf_n_dropped"], r.rid) for r in line_dedup(df).collect())
    assert got == [(-1, 1, 1, 1), (-1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 0, 1), (3, 1, 0, 1), (4, 1, 0, 1), (9, 3, 0, 1)]
    assert line_dedup(df.limit(0)).collect() == []


def test_columns_with_clashing_names_are_replaced(spark):
    df = spark.createDataFrame([(i, LONG) for i in range(5)], "doc_id long, text string").selectExpr("*", "1 AS __tf_text", "2 AS __tf_kept", "3 AS __tf_rid")
    assert {r["__tf_kept"] for r in line_dedup(df).collect()} == {"", LONG}


def batch_of(spark, low, high, doc):
    return spark.range(low, high).select(F.col("id").cast("string").cast("binary").alias("h"), F.lit(doc).cast("long").alias("id"))


def test_runs_are_compacted_and_settled_lines_add_nothing(spark):
    runs = LineRuns(spark, fan_out=2, min_docs=2)
    for number in range(5):
        runs.add(batch_of(spark, number * 10, number * 10 + 20, 9 - number))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    merged = {bytes(r.h).decode(): (r.n_docs, r.max_id) for r in runs.merged().collect()}
    assert len(merged) == 60 and merged["15"] == (2, 9) and merged["5"] == (1, 9) and merged["59"] == (1, 5)
    later = batch_of(spark, 0, 60, 1).groupBy("h").agg(F.count("id").alias("n_docs"), F.max("id").alias("max_id"))
    left = runs.unsettled(later)
    assert {int(bytes(r.h)) for r in left.collect()} == {*range(10), *range(40, 60)}, "the newest run alone settles nothing"
    assert "SortMergeJoin" in (plan := left._jdf.queryExecution().toString()) and "LeftAnti" in plan
    assert runs.unsettled(later.withColumn("max_id", F.lit(10).cast("long"))).count() == 60, "a larger id still counts"


def test_runs_reopen_and_take_another_batch(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rows = [(i, f"own {i}\n{LONG}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = line_dedup(df.where("doc_id >= 3"), runs=LineRuns.open(spark, path)).collect()
    assert all(r["__tf_n_dropped"] == 0 for r in first)
    for _ in range(2):
        again = LineRuns.open(spark, path)
        assert again.merged().count() == 1
    got = {r.doc_id: r["__tf_kept"] for r in line_dedup(df.where("doc_id < 3"), runs=LineRuns.open(spark, path)).collect()}
    assert got == {i: f"own {i}" for i in range(3)}
    assert [(r.n_docs, r.max_id) for r in LineRuns.open(spark, path).merged().collect()] == [(6, 5)]


def test_batches_in_any_number_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = [{r.doc_id: r["__tf_sha256"] for r in line_dedup(docs, batches=n, fan_out=f).collect()} for n, f in ((1, 2), (7, 3))]
    assert found[0] == found[1]
