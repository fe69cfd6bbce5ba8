"""Keyword search by segments against the scores of all documents."""

import random

import pytest
from pyspark.sql import functions as F

from codexmill.operators import search

WORDS = ["apple", "pear", "fig", "plum", "kiwi", "date", "Écru", "x1"]
ASKED = [("q1", "apple fig"), ("q2", "kiwi kiwi date-plum"), ("q3", "nothing"), ("q4", "pear-fig-apple écru"), ("q5", None), ("q6", "plum")]


def documents(spark, n=60):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 14))) for _ in range(n // 2)]
    rows = [(f"d{i}", texts[i % len(texts)] if i % 11 else None, rnd.random() < 0.7) for i in range(n)]
    return spark.createDataFrame(rows, "id string, text string, live boolean")


@pytest.mark.parametrize(("limit", "most"), [(3, 100), (1000, 100), (3, 2)])
def test_the_best_of_segments_are_the_best_of_all(spark, limit, most):
    docs, queries = documents(spark), spark.createDataFrame(ASKED, "query_id string, text string")
    scores = search.bm25(docs.select("id", "text"), queries).join(docs.filter("live").select("id"), "id", "left_semi")
    want = search.best(scores, limit).select("query_id", "rank", "id", "score").collect()
    got = search.ranked(docs, queries, limit, segment=7, batch=2, most=most).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sorted(map(tuple, search.keyword_search(docs, docs.filter("live").select("id"), queries, limit).collect())) == sorted(map(tuple, want))


def test_only_the_best_of_a_segment_leave_it(spark):
    docs = spark.range(0, 4000, 1, 2).select(F.col("id").cast("string").alias("id"), F.lit("common").alias("text"))
    queries = spark.range(50).select(F.col("id").cast("string").alias("query_id"), F.lit("common").alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = search.keyword_search(docs, docs.select("id"), queries, 2)
        plan = found._jdf.queryExecution().executedPlan()
        assert {r["id"] for r in found.collect()} == {"0", "1"}
        widest = max(int(m.value()) for m in metrics(plan, "numOutputRows"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert widest < 50 * 100  # not 50 queries x 4,000 documents


def metrics(plan, name):
    out, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        if node.metrics().contains(name):
            out.append(node.metrics().apply(name))
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return out


def test_nothing_asked_and_nothing_there(spark):
    docs, queries = documents(spark), spark.createDataFrame(ASKED, "query_id string, text string")
    assert search.ranked(docs.limit(0), queries, 5).collect() == [] and search.ranked(docs, queries.limit(0), 5).collect() == []
