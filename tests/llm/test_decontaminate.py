import random
import re

import pytest
from tallyflow.llm.decontaminate import OP5_SQL, decontaminate, op5_decontamination


def plain(docs, items, window=10):
    """Every window of every item against every place of every document."""

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(window, len(b))
            for k in range(max(1, len(b) - window + 1) if b else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[k : k + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def test_query_equals_sql(spark, sf, same_as_sql):
    same_as_sql(op5_decontamination(spark, sf), OP5_SQL)


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_equals_brute_force_in_one_block_and_in_many(spark, block_words):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "Ä", "É1", "x-y"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 10, 12, 15))))) for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(20)] + [(100 + i, f"p q {items[i][1].upper()} r, {items[i][1]}") for i in range(12)] + [(200, None), (201, ""), (202, "!?")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert {r.doc_id: (r["__tf_n_words"], r["__tf_n_hit"], r["__tf_items"]) for r in got} == plain(docs, items)


def test_nulls_repeats_extra_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "three one two"), (3, "z " * 100000)], "doc_id long, text string").selectExpr("*", "5 AS item_id", "6 AS words")
    items = spark.createDataFrame([(None, "one two"), (7, "one two"), (7, "one two"), (8, None), (9, "")], "item_id long, text string")
    got = decontaminate(docs, items).collect()
    assert sorted((r.doc_id or 0, r["__tf_n_hit"], tuple(r["__tf_items"])) for r in got) == [(0, 2, ("7",)), (1, 2, ("7",)), (1, 2, ("7",)), (3, 0, ())]
    assert {r["__tf_n_hit"] for r in decontaminate(docs, items.limit(0)).collect()} == {0}
    assert decontaminate(docs.limit(0), items).collect() == []


def test_columns_of_an_earlier_result_give_way(spark):
    docs = spark.createDataFrame([(1, "one two three", 9, "x")], "doc_id long, text string, __tf_n_words int, __tf_items string")
    items = spark.createDataFrame([(7, "one two")], "item_id long, text string")
    (row,) = decontaminate(docs, items).collect()
    assert (row["__tf_n_words"], row["__tf_items"]) == (3, ["7"])
