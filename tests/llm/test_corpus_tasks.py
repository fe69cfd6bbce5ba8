"""Rounds over small tables take few tasks, however wide the shuffle is."""

import pytest
from pyspark.sql import functions as F

from codexmill.llm import components, url_filters


@pytest.fixture
def wide(spark, monkeypatch):
    """Shuffles of 24 partitions, and the numbers of partitions of the tables that are written."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    seen = []
    for module in (components, url_filters):
        def counted(df, plain=module.cut):
            out = plain(df)
            seen.append(out.rdd.getNumPartitions())
            return out

        monkeypatch.setattr(module, "cut", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield seen
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_scores_of_few_hosts_are_few_tasks(spark, wide):
    edges = spark.createDataFrame([("trust", f"h{i}", f"h{i + 1}", 1.0) for i in range(12)] + [("distrust", f"h{i + 1}", f"h{i}", 1.0) for i in range(12)], "kind string, src string, dst string, w double")
    seeds = spark.createDataFrame([("trust", "h0", 1.0), ("distrust", "h12", 1.0)], "kind string, host string, share double")
    got = {(r["kind"], r["host"]): r["score"] for r in url_filters.propagate(edges, seeds).collect()}
    assert got["trust", "h3"] == pytest.approx(0.15 * 0.85**3)
    assert wide[1:] and max(wide[1:]) == 1


def test_components_of_few_edges_are_few_tasks(spark, wide):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], "u string, v string")
    got = {r["node"]: r["root"] for r in components.components(chain).collect()}
    assert got == {f"n{i:02d}": "n00" for i in range(21)} | {"x": "x", "y": "x"}
    assert wide[1:] and max(wide[1:]) == 1


def test_plans_of_components_stay_small(spark, monkeypatch):
    plans, plain = [], components.cut

    def told(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString().count("Aggregate"))
        return plain(df)

    monkeypatch.setattr(components, "cut", told)
    monkeypatch.setattr(components, "TASK_EDGES", 100)
    n = 1500
    chain = spark.range(n).select(F.format_string("n%05d", F.col("id")).alias("u"), F.format_string("n%05d", F.pmod(F.col("id") * 7 + 1, F.lit(n)).alias("v")).alias("v")).repartition(7)
    got = {r["node"]: r["root"] for r in components.components(chain).collect()}
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(n):
        x, y = find(a), find((a * 7 + 1) % n)
        root[max(x, y)] = min(x, y)
    alone = {i for i in range(n) if (i * 7 + 1) % n == i}
    assert got == {f"n{i:05d}": f"n{find(i):05d}" for i in range(n) if i not in alone}
    assert max(plans) < 20
