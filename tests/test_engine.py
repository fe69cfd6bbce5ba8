"""Sequential and stateful operators against small restatements, and invariants."""

import pytest
from pyspark.sql import functions as F

from codexmill import ports
from codexmill.operators import cluster, graph, hybrid, jobs, knn, revise, search, store
from codexmill.schema import EDGES, NODES, conform
from codexmill.settings import Settings, clamp_limit


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_conform(spark):
    out = conform(frame(spark, [("a", 1)], "id string, extra int"), NODES)
    assert out.columns == [f.name for f in NODES.fields] and out.first()["claims"] == []


def test_upsert_keeps_the_first_creation(spark):
    old = frame(spark, [("a", "t0", "x"), ("b", "t0", "y")], "id string, created_at string, title string")
    new = frame(spark, [("a", "t1", "z", 5), ("a", "t2", "w", 6)], "id string, created_at string, title string, seq long")
    rows = {r["id"]: r for r in store.upsert_nodes(old, new, "seq").collect()}
    assert rows["a"]["title"] == "w" and rows["a"]["created_at"] == "t0" and rows["b"]["title"] == "y"


def test_bm25_prefers_rare_terms_and_short_texts(spark):
    docs = frame(spark, [("1", "common rare"), ("2", "common filler words here and more"), ("3", "common other"), ("4", "nothing"), ("5", "x"), ("6", "y z")], "id string, text string")
    got = search.keyword_search(docs, docs.select("id"), frame(spark, [("q", "rare common")], "query_id string, text string"), 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["1", "3"]


def test_bm25_phrases_are_words_that_follow_each_other(spark):
    docs = frame(spark, [("a", "the left hand of it"), ("b", "hand left of left it"), ("c", "Left-hand, left hand"), ("d", None), ("e", "other")], "id string, text string")
    asked = frame(spark, [("q", 'left-hand "--"'), ("none", "--"), ("empty", None), ("two", "other left_of")], "query_id string, text string")
    got = {(r["query_id"], r["id"]) for r in search.bm25(docs, asked).collect()}
    assert got == {("q", "a"), ("q", "c"), ("two", "e"), ("two", "b")}


def test_knn_over_several_segments(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    v = frame(spark, [(str(i), x.tolist()) for i, x in enumerate(m)] + [("null", None)], "id string, v array<double>")
    got = knn.knn(v.filter("id < '2'").withColumnRenamed("id", "query_id"), v, 4, segment=7, batch=3).collect()
    for r in got:
        d = np.sqrt(((m - m[int(r["query_id"])]) ** 2).sum(1))
        assert int(r["id"]) == np.argsort(d, kind="stable")[r["rank"] - 1] and r["distance"] == pytest.approx(np.sort(d)[r["rank"] - 1], abs=1e-6)


HIT = "query_id string, pool int, rank int, weight double, node_id string, field string, item_id string, text string, start_char int"


def test_evidence_caps(spark):
    rows = [("q", 0, 1, 1.0, "n", "small_chunk", "a", "t1", 0), ("q", 1, 1, 1.0, "n", "big_chunk", "b", "t2", 100), ("q", 1, 2, 1.0, "n", "title", "c", "t3", None), ("q", 2, 3, 1.0, "n", "small_chunk", "d", "t4", 900), ("q", 3, 4, 1.0, "n", "claim", "e", "t5", None)]
    kept = hybrid.capped(frame(spark, rows, HIT)).orderBy("rank", "pool").collect()
    assert [r["item_id"] for r in kept] == ["a", "c", "d"]


def slow_mmr(sets, rel, lam):
    left, order = list(range(len(sets))), []
    sim = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    while left:
        best = max(left, key=lambda i: (lam * rel[i] - (1 - lam) * max((sim(sets[i], sets[j]) for j in order), default=0.0), -i))
        order.append(best)
        left.remove(best)
    return order


def test_mmr_is_the_greedy_order():
    import random

    r = random.Random(3)
    for _ in range(30):
        sets = [set(r.sample("abcdefgh", r.randint(0, 5))) for _ in range(9)]
        rel = [r.random() for _ in sets]
        assert hybrid.mmr_order(sets, rel, 0.75) == slow_mmr(sets, rel, 0.75)


def test_health_of_one_node_and_of_nothing(spark):
    n = frame(spark, [("a", "active", "endogenous"), ("b", "deleted", "exogenous")], "id string, status string, type string")
    e = conform(frame(spark, [("1", "a", "a")], "id string, source_node_id string, target_node_id string"), EDGES)
    row = graph.health(n, e, "a").first()
    assert (row["total_nodes"], row["isolated_nodes"], row["avg_degree"], row["density"]) == (1, 0, 1.0, 0.0)
    assert graph.health(n.limit(0), e.limit(0)).first()["avg_degree"] == 0.0


def test_follow_link_rejects_unknown_directions(spark):
    with pytest.raises(ValueError):
        graph.follow_link(None, None, None, direction="sideways")


def test_communities_beat_singletons(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 1.0)]
    w = frame(spark, edges, "a string, b string, weight double")
    n = frame(spark, [(x,) for x in "abcdefg"], "id string")
    labels = cluster.communities(n, w)
    assert labels.count() == 7 and cluster.modularity(labels, w).first()["modularity"] > 0.2
    assert sorted(labels.collect()) == sorted(cluster.communities(n, w).collect())


def test_revising_a_document_with_itself_changes_nothing(spark):
    d = frame(spark, [("doc", 1, "1", "alpha beta", "h1"), ("doc", 2, "2", "gamma", "h2")], "document string, ord long, id string, body string, hash string")
    new = d.withColumn("id", F.concat("id", F.lit("n")))
    assert {r["action"] for r in revise.actions(d, new).collect()} == {"unchanged"}


def test_equal_pages_are_matched_before_alike_ones(spark):
    """A new page that is like two old ones takes the one that no equal page takes."""
    ddl = "document string, ord long, id string, body string, hash string"
    words = " ".join(f"w{i}" for i in range(40))
    old = frame(spark, [("d", 1, "o1", words, "H"), ("d", 2, "o2", words + " more", "h2"), ("d", 3, "o3", "quite another page", "h3")], ddl)
    new = frame(spark, [("d", 1, "n1", words + " and some", "h4"), ("d", 2, "n2", words, "H"), ("d", 3, "n3", "nothing alike", "h5")], ddl)
    assert {r["id"]: r["action"] for r in revise.actions(old, new).collect()} == {"n1": "superseded", "n2": "unchanged", "n3": "new", "o3": "stale"}
    same = frame(spark, [("d", 1, "n1", words.upper() + " more", "h9")], ddl)
    assert {r["id"]: r["action"] for r in revise.actions(old, same).collect()}["n1"] == "remapped"


def test_greedy_matches_use_each_old_page_once(spark):
    pairs = frame(spark, [("d", "o1", 1, "n1", 1, 0.9), ("d", "o1", 1, "n2", 2, 0.95), ("d", "o2", 2, "n2", 2, 0.5)], "document string, old_id string, old_ord long, new_id string, new_ord long, score double")
    assert sorted((r["new_id"], r["old_id"]) for r in revise.greedy_matches(pairs).collect()) == [("n1", "o1"), ("n2", "o2")]


def test_cluster_names(spark):
    names = frame(spark, [("図書館",), ("English only",), ("あ" * 61,), ("",)], "name string")
    assert [r[0] for r in names.select(cluster.valid_name(F.col("name"))).collect()] == [True, False, False, False]
    known = frame(spark, [("A",), ("B",)], "cluster string")
    plan = frame(spark, [("A", "B"), ("B", "新"), ("C", "x")], "original string, new string")
    assert {r["cluster"]: r["name"] for r in cluster.renamed(known, plan).collect()} == {"A": "A", "B": "新"}


def test_task_states(spark):
    m = frame(spark, [("a", "processing", 1), ("a", "completed", 2)], "task_id string, state string, seq int")
    t = frame(spark, [("a", False, False), ("b", True, False), ("c", False, True), ("d", False, False)], "task_id string, has_output boolean, alive boolean")
    assert {r["task_id"]: r["state"] for r in jobs.task_states(m, t).collect()} == {"a": "completed", "b": "completed", "c": "processing", "d": "failed"}


def test_settings():
    s = Settings.from_env({"CODEXMILL_RRF_K": "-3", "CODEXMILL_MMR_LAMBDA": "x", "CODEXMILL_LLM_API_KEY": "k"})
    assert s.rrf_k == 0 and s.mmr_lambda == 0.75 and s.patched({"llm_api_key": " "}).llm_api_key == "k" and s.redacted()["llm_api_key"] == ""
    assert clamp_limit(0) == 1 and clamp_limit(999) == 200


def test_ports(spark):
    rows = ports.embedded(frame(spark, [("a b",), (None,)], "t string"), "t", ports.HashedTokens(8)).collect()
    assert len(rows[0]["embedding"]) == 8 and sum(x * x for x in rows[0]["embedding"]) == pytest.approx(1)
