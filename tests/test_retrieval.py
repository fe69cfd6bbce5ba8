"""Evidence caps, the order of diversity and the collapse of same nodes against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from codexmill.operators import graph, hybrid

HIT = "query_id string, pool int, rank int, weight double, node_id string, field string, item_id string, text string, start_char int"


def some_hits(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    out = []
    for rank in range(1, 90):
        item = rnd.choice([None, "", f"i{rnd.randint(0, 30)}"])
        text = rnd.choice(["", "  ", *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(6)]])
        out.append((f"q{rnd.randint(0, 2)}", rnd.randint(0, 4), rank, rnd.choice([0.75, 1.0, 1.35]), f"n{rnd.randint(0, 5)}", rnd.choice(["title", "small_chunk", "big_chunk", "claim"]), item, text, rnd.choice([None, 0, 150, 300, 900])))
    return out


def plain_caps(hits):
    """Best contribution first; at most three of a node, two of a field, no item or text twice, chunks apart."""
    out = []
    for key in sorted({(h[0], h[4]) for h in hits}):
        kept = []
        own = sorted((h for h in hits if (h[0], h[4]) == key), key=lambda h: (-round(h[3] / (60 + h[2]), 9), h[1], h[2]))
        for h in own:
            name = lambda x: x[6] or x[7][:80]
            chunk = lambda x: x[5] in ("small_chunk", "big_chunk") and x[8] is not None
            if len(kept) < 3 and h[7].strip() and all(name(k) != name(h) for k in kept) and sum(k[5] == h[5] for k in kept) < 2 and not any(chunk(h) and chunk(k) and abs(k[8] - h[8]) < 200 for k in kept):
                kept.append(h)
        out += kept
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_caps_as_a_walk(spark, seed):
    hits = some_hits(seed)
    got = hybrid.capped(spark.createDataFrame(hits, HIT)).select("query_id", "pool", "rank", "weight", "node_id", "field", "item_id", "text", "start_char").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain_caps(hits)))


def plain_order(sets, rel, lam):
    left, chosen = list(range(len(sets))), []
    near = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    while left:
        best = max(left, key=lambda j: (lam * rel[j] - (1 - lam) * max([near(sets[j], sets[k]) for k in chosen], default=0.0), -j))
        chosen.append(best)
        left.remove(best)
    return chosen


def test_diversity_as_a_walk(spark):
    capped = hybrid.capped(spark.createDataFrame(some_hits(3), HIT))
    pool = hybrid.relevance(capped, cap=20)
    rows, got = pool.collect(), {(r["query_id"], r["position"]): r["mmr"] for r in hybrid.diversified(pool).collect()}
    for q in {r["query_id"] for r in rows}:
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["position"])
        score = [r["weight"] / (60 + r["rank"]) for r in own]
        low, high = min(score), max(score)
        assert [r["rel"] for r in own] == pytest.approx([1.0 if high - low < 1e-9 else (s - low) / (high - low) for s in score])
        order = plain_order([set(r["text"].split()) for r in own], [r["rel"] for r in own], hybrid.LAMBDA)
        assert [got[q, own[j]["position"]] for j in order] == list(range(len(own)))


def test_same_nodes_collapse_as_a_walk(spark):
    rnd = random.Random(4)
    lists = [(f"q{q}", p, f"n{n}") for q in range(4) for p, n in enumerate(rnd.sample(range(20), 14))]
    ties = [(f"n{rnd.randint(0, 19)}", f"n{rnd.randint(0, 19)}", rnd.choice(["same-as", "same-as", "related"])) for _ in range(16)]
    same = {(a, b) for a, b, label in ties if label == "same-as"} | {(b, a) for a, b, label in ties if label == "same-as"}
    want = []
    for q in range(4):
        kept = []
        for _, p, n in sorted(x for x in lists if x[0] == f"q{q}"):
            if not any((k, n) in same for _, k in kept):
                kept.append((p, n))
        want += [(f"q{q}", p, n) for p, n in kept]
    ordered = spark.createDataFrame(lists, "query_id string, position int, id string")
    edges = spark.createDataFrame(ties, "source_node_id string, target_node_id string, label string")
    assert sorted(tuple(r) for r in graph.collapse_same_as(ordered, edges).collect()) == sorted(want)


def test_pools_of_nodes_without_text_show_the_snippet(spark):
    nodes = spark.createDataFrame([("n1", "active", "said", "T"), ("n2", "stale", "x", "y")], "id string, status string, summary string, title string")
    hits = spark.createDataFrame([("q", 0, 1, 0.9, "n1", "node_bm25", None, "", None), ("q", 0, 2, 0.9, "n2", "node_bm25", None, "", None)], HIT)
    rows = hybrid.active_hits(hits, nodes).collect()
    assert len(rows) == 1 and "said" in rows[0]["text"]
    assert hybrid.hybrid(hits, nodes).select(F.size("evidence")).first()[0] == 1
