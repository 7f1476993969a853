from tallyflow.llm.exact_dedup import OP8_SQL, exact_dedup, op8_exact_dedup


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_query_equals_sql(spark, sf, same_as_sql):
    same_as_sql(op8_exact_dedup(spark, sf), OP8_SQL)


def test_hot_texts_are_salted_and_joined_again(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    hot = docs.where("doc_id < 150").selectExpr("doc_id + 1000 AS doc_id", "if(doc_id % 2 = 0, 'one  text', 'one\ttext') AS text")
    both = docs.unionByName(hot)
    salted, plain = exact_dedup(both, hot_parts=1000), exact_dedup(both, hot_parts=1)
    assert rows_of(salted) == rows_of(plain)
    assert {(r.keep_id, r.group_size) for r in salted.where("doc_id >= 1000").collect()} == {(1000, 150)}
    assert salted.where("kept AND doc_id >= 1000").count() == 1


def test_plan_has_no_python(spark, sf):
    plan = op8_exact_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_nulls_repeats_blanks_extra_columns_and_empty(spark):
    rows = [(5, None), (4, ""), (None, ""), (7, "a \n b"), (7, "a b"), (8, "a b "), (None, "only"), (9, "x" * 300000), (10, "x" * 300000 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS norm", "3 AS salt", "4 AS digest")
    got = exact_dedup(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    sizes = sorted(len(v) for v in by.values())
    assert sizes == [1, 1, 1, 1, 2, 3]
    for own in by.values():
        assert {r.group_size for r in own} == {len(own)} and sum(r.kept for r in own) == 1
    assert {r.keep_id for r in got if r.doc_id in (4, 5)} == {4}
    assert exact_dedup(df.limit(0)).collect() == []
