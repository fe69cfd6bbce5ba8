"""Levels of communities, similarity joins, change sets, stored tables, the index kept by differences, queues, segments."""

import os
import random
import time
from dataclasses import fields

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill import ports, schema
from codexmill.functions import segments
from codexmill.operators import changes, cluster, keyword_index, louvain, revise, search, store, views
from codexmill.plans import sql, writes
from codexmill.sources import bucketed
from codexmill.streaming import jobqueue

NOW = "2025-01-01T00:00:00"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# communities


def plain_modularity(edges, label):
    m = sum(w for _, _, w in edges)
    inside, total = {}, {}
    for a, b, w in edges:
        inside[label[a]] = inside.get(label[a], 0) + (w if label[a] == label[b] else 0)
        for x in (a, b):
            total[label[x]] = total.get(label[x], 0) + w
    return sum(inside.get(c, 0) / m - (t / (2 * m)) ** 2 for c, t in total.items())


def plain_louvain(edges):
    """Node by node, level by level."""
    weight = {}
    for a, b, w in edges:
        weight[tuple(sorted((a, b)))] = weight.get(tuple(sorted((a, b))), 0) + w
    names = {x: x for pair in weight for x in pair}
    while True:
        near, degree = {}, {}
        for (a, b), w in weight.items():
            degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
            if a != b:
                near.setdefault(a, {})[b] = w
                near.setdefault(b, {})[a] = w
        twice, label, total, moved = sum(degree.values()), {x: x for x in degree}, dict(degree), True
        any_move = False
        while moved:
            moved = False
            for x in sorted(degree):
                mine, into = label[x], {}
                total[mine] -= degree[x]
                for y, w in near.get(x, {}).items():
                    into[label[y]] = into.get(label[y], 0) + w
                value = lambda c: into.get(c, 0) - degree[x] * total[c] / twice  # noqa: B023, E731
                best = max(sorted(into), key=value, default=mine)
                to = best if into and value(best) > value(mine) + 1e-12 else mine
                total[to] += degree[x]
                label[x] = to
                moved |= to != mine
                any_move |= to != mine
        names = {k: label.get(v, v) for k, v in names.items()}
        if not any_move:
            return names
        again = {}
        for (a, b), w in weight.items():
            pair = tuple(sorted((label[a], label[b])))
            again[pair] = again.get(pair, 0) + w
        weight = again


def test_rounds_shuffle_numbers_in_the_order_of_the_ids(spark):
    names = louvain.numbered(frame(spark, [(f"{i * 7919 % 97:x}é",) for i in range(97)], "id string"))
    rows = sorted((r["id"], r["name"]) for r in names.collect())
    assert len(rows) == 97 and [n for _, n in rows] == sorted(n for _, n in rows)
    for turn in (0, 61, 62, 200):
        first = turn // louvain.DRAWS * louvain.DRAWS
        met = names.join(louvain.draws(names, first), "id").select(F.col("draws").bitwiseAND(F.lit(1 << turn - first).cast("long")) != 0, F.pmod(F.xxhash64("name", F.lit(turn)), F.lit(2)) == 0)
        assert all(a == b for a, b in met.collect())
    near, state = frame(spark, [(1, 2, 1.0, 1.0), (2, 1, 1.0, 1.0)], "id long, other long, weight double, k double"), frame(spark, [(1, 1.0, 0.0, 0, 1), (2, 1.0, 0.0, 0, 2)], "id long, k double, inside double, draws long, community long")
    assert "string" not in {t for _, t in louvain.best_moves(near, state, 2.0, 1.0).dtypes}


def test_levels_reach_the_modularity_of_plain_louvain(spark):
    rnd = random.Random(5)
    edges = {}
    for a in range(60):
        for b in range(a):
            if rnd.random() < (0.45 if a // 10 == b // 10 else 0.09 if a // 20 == b // 20 else 0.01):
                edges[f"n{a:02}", f"n{b:02}"] = float(rnd.randint(1, 3))
    rows = [(a, b, w) for (a, b), w in edges.items()]
    nodes = frame(spark, [(f"n{a:02}",) for a in range(62)], "id string")
    got = {r["id"]: r["community"] for r in louvain.louvain(nodes, frame(spark, rows, "a string, b string, weight double")).collect()}
    assert len(got) == 62 and got["n61"] == "n61" and len(set(got.values())) < 20
    assert plain_modularity(rows, got) >= plain_modularity(rows, plain_louvain(rows)) - 0.02
    assert all(got[c] == c == min(x for x, y in got.items() if y == c) for c in set(got.values()))


def test_a_level_of_separate_cliques_is_contracted(spark):
    """A ring of cliques: the second level joins none that would cost modularity; loops count twice in degrees."""
    rows = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcdef" for i in range(4) for j in range(i)] + [(f"{x}0", f"{y}1", 1.0) for x, y in zip("abcdef", "bcdefa", strict=True)]
    w = frame(spark, rows, "a string, b string, weight double")
    got = louvain.louvain(w.select(F.col("a").alias("id")).unionByName(w.select(F.col("b").alias("id"))), w)
    assert sorted(r["n"] for r in got.groupBy("community").agg(F.count("*").alias("n")).collect()) == [4] * 6
    loops = louvain.louvain(frame(spark, [("x",), ("y",)], "id string"), frame(spark, [("x", "x", 2.0), ("y", "y", 1.0)], "a string, b string, weight double"))
    assert {r["id"]: r["community"] for r in loops.collect()} == {"x": "x", "y": "y"}


def test_labels_that_change_are_told(spark):
    nodes = frame(spark, [("a", "old"), ("b", "new"), ("c", None), ("d", "kept")], "id string, cluster string")
    all_nodes, changed = louvain.relabelled(nodes, frame(spark, [("a", "new"), ("b", "new"), ("c", "new"), ("d", "")], "id string, label string"))
    assert {r["id"]: r["cluster"] for r in all_nodes.collect()} == {"a": "new", "b": "new", "c": "new", "d": "kept"}
    assert {r["id"] for r in changed.collect()} == {"a", "c"}


def test_the_digest_of_a_set(spark):
    ids = [f"id{i}" for i in range(700)]
    one = cluster.set_digest(frame(spark, [(x,) for x in ids], "id string").repartition(7), 16)
    two = cluster.set_digest(frame(spark, [(x,) for x in reversed(ids + ids[:50])], "id string").coalesce(1), 16)
    other = cluster.set_digest(frame(spark, [(x,) for x in [*ids[:-1], "id700"]], "id string"), 16)
    assert one == two and one[0] != other[0] and cluster.set_digest(frame(spark, [], "id string"))[1] == 0


@pytest.mark.parametrize("n", [3, 300, 5000])
def test_the_digest_of_a_set_is_that_of_its_sql(spark, n):
    """Leaves of one id about, so that 5,000 ids have a prefix of four characters."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t AS SELECT 'id' || i AS id FROM range({n}) r(i)")
    want = con.execute(f"WITH {sql.set_digest('t', 'a').replace('256.0', '1.0')} SELECT ad, an FROM a_root").fetchone()
    assert cluster.set_digest(spark.range(n).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("id")), 1) == want


# revisions


PAGE = "document string, ord long, id string, body string, claims array<string>, keywords array<string>, entity string, hash string"


def some_pages(rnd, side, n):
    word = lambda: rnd.choice(["the", "a", *[f"w{i}" for i in range(14)]])
    out = []
    for i in range(n):
        claims = None if rnd.random() < 0.2 else [f"{word()} {word()}" for _ in range(rnd.randint(0, 4))]
        out.append((rnd.choice("xy"), i, f"{side}{i}", " ".join(word() for _ in range(rnd.randint(0, 9))), claims, [word() for _ in range(rnd.randint(0, 4))], rnd.choice([None, "", "The One", "the one", "w1"]), f"{side}{i}"))
    return out


def plain_score(a, b):
    tokens = lambda t: set((t or "").lower().split())
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    claims = [{" ".join(c.lower().split()) for c in p[4] or []} - {""} for p in (a, b)]
    bonus = 0.2 if a[6] and b[6] and a[6].lower() == b[6].lower() else 0.0
    return min(1.0, max(jac(*claims), 0.8 * jac(set(a[5]), set(b[5])), 0.65 * jac(tokens(a[3]), tokens(b[3]))) + bonus)


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.45, 0.7])
def test_the_similarity_join_finds_all_pairs(spark, threshold):
    rnd = random.Random(int(100 * threshold))
    old, new = some_pages(rnd, "o", 40), some_pages(rnd, "n", 40)
    got = revise.scored_pairs(frame(spark, old, PAGE), frame(spark, new, PAGE), threshold=threshold)
    want = {(a[2], b[2]): plain_score(a, b) for a in old for b in new if a[0] == b[0] and plain_score(a, b) >= threshold}
    found = {(r["old_id"], r["new_id"]): r["score"] for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want) and want


def test_pages_of_one_common_word_meet_few(spark):
    """Of pages that share the most common word and nothing else no pair is made."""
    old = [("d", i, f"o{i}", f"the only{i} word{i} here{i} is{i} mine{i}", None, [], None, str(i)) for i in range(60)]
    new = [("d", i, f"n{i}", f"the else{i} text{i} there{i} was{i} yours{i}", None, [], None, str(i)) for i in range(60)]
    a, b = (revise.compared(frame(spark, x, PAGE), "document") for x in (old, new))
    assert revise.likely_pairs(a, b, "document", 0.45).count() == 0
    with pytest.raises(ValueError, match="all pairs"):
        revise.likely_pairs(a, b, "document", 0.0)


def test_blocks_find_what_one_block_does_and_copies_make_no_square(spark):
    """Pages over several blocks give the same pairs; of a family of copies each new page takes one pair a block along."""
    rnd = random.Random(5)
    old, new = (frame(spark, some_pages(rnd, side, 40), PAGE) for side in "on")
    shown = lambda df: sorted((r["old_id"], r["new_id"], r["score"]) for r in df.collect())
    assert shown(revise.scored_pairs(old, new, block=100)) == shown(revise.scored_pairs(old, new))
    ranked = lambda df: sorted((r["new_id"], r["old_id"], r["score"]) for r in revise.best_match(df).collect())
    assert ranked(revise.scored_pairs(old, new, best=True, block=100)) == ranked(revise.scored_pairs(old, new))
    copies = [[("d", i, f"{side}{i}", "one text of many words", None, [], None, "h") for i in range(50)] for side in "on"]
    pairs = revise.scored_pairs(*[frame(spark, c, PAGE) for c in copies], best=True)
    assert pairs.count() == 50 and {r["old_id"] for r in pairs.collect()} == {"o0"}


def test_rounds_match_as_one_walk_does(spark):
    rnd = random.Random(8)
    pairs = [(d, f"{d}o{o}", o, f"{d}n{n}", n // 2, rnd.choice([0.5, 0.6, 0.7, 0.9])) for d in "xyz" for o in range(12) for n in range(12) if rnd.random() < 0.35]
    want = []
    for d in "xyz":
        used = set()
        for n in sorted({(p[4], p[3]) for p in pairs if p[0] == d}):
            free = sorted((-p[5], p[2], p[1]) for p in pairs if p[0] == d and p[3] == n[1] and p[1] not in used)
            if free:
                used.add(free[0][2])
                want.append((n[1], free[0][2]))
    got = revise.greedy_matches(frame(spark, pairs, "document string, old_id string, old_ord long, new_id string, new_ord long, score double"))
    assert sorted((r["new_id"], r["old_id"]) for r in got.collect()) == sorted(want)


def test_successors_as_the_graph_leads(spark):
    nodes = frame(spark, [("s", "superseded"), ("a", "active"), ("b", "active"), ("t", "stale"), ("u", "superseded"), ("r", "superseded")], "id string, status string")
    edges = frame(spark, [("s", "a", "2024-01"), ("s", "b", "2024-02"), ("t", "a", "2024-01"), ("u", "t", "2024-03"), ("u", "a", "2024-02"), ("r", "a", "2024-01")], "source_node_id string, target_node_id string, created_at string").withColumn("label", F.lit("superseded_by"))
    got = {r["id"]: r["successor"] for r in views.successors(nodes.select("id"), edges, nodes, frame(spark, [("r", "t"), ("b", "s")], "old string, new string")).collect()}
    assert got == {"s": "b", "a": "a", "b": "b", "u": "a"}  # b gives way to s, which is superseded by b; r to t, which is stale


# change sets


def tables(spark, nodes=(), edges=(), items=(), sources=()):
    make = lambda rows, ddl: frame(spark, list(rows), ddl)
    return changes.Tables(
        make(nodes, "id string, type string, status string, original_document_name string, body string, created_at string"), make(edges, "id string, source_node_id string, target_node_id string, label string, created_at string"),
        make(items, "id string, node_id string"), make(sources, "document_name string, source_hash string"),
    ).conformed()


def shown(t):
    return {f.name: sorted(map(repr, getattr(t, f.name).collect())) for f in fields(t)}


def twice(t, made):
    once = changes.applied(t, made)
    assert shown(changes.applied(once, made)) == shown(once)
    return once


def test_puts_patches_and_deletes_fold_in_order(spark):
    t = tables(spark, nodes=[("a", "x", "active", "d", "one", "2020"), ("b", "x", "active", "d", "two", "2020"), ("c", "x", "active", "d", "three", "2020")])
    put = lambda i, body, seq: changes.change(frame(spark, [(i, body, "2030", "active")], "id string, body string, created_at string, status string"), "nodes", "put", seq)
    ids = lambda *x: frame(spark, [(i,) for i in x], "id string")
    made = changes.together([put("a", "again", 3), changes.status(ids("a", "b", "lost"), "stale", NOW, 4), changes.change(ids("c"), "nodes", "delete", 2), put("c", "new c", 5), put("e", "e", 1), changes.change(ids("e"), "nodes", "delete", 6)])
    got = {r["id"]: (r["body"], r["status"], r["created_at"]) for r in twice(t, made).nodes.collect()}
    assert got == {"a": ("again", "stale", "2020"), "b": ("two", "stale", "2020"), "c": ("new c", "active", "2030")}


GRAPH = {
    "nodes": [("p", "endogenous", "active", "d", "page", "2020"), ("q", "endogenous", "active", "d", "other", "2020"), ("n1", "exogenous", "active", None, "note", "2020"), ("n2", "exogenous", "active", None, "note of a note", "2020"), ("n3", "exogenous", "stale", None, "stale note", "2020")],
    "edges": [("e1", "p", "n1", "supports", "2020"), ("e2", "n1", "n2", "supports", "2020"), ("e3", "p", "n3", "supports", "2020"), ("e4", "p", "q", "follows", "2020"), ("e5", "n1", "p", "reference", "2020")],
    "items": [("i1", "p"), ("i2", "q")],
    "sources": [("d", "v0")],
}


def test_deleting_a_node_lets_notes_react_first(spark):
    t = tables(spark, **GRAPH)
    after = twice(t, changes.deleted(frame(spark, [("p",)], "id string"), t, NOW, 1))
    assert {r["id"]: r["status"] for r in after.nodes.collect()} == {"q": "active", "n1": "stale", "n2": "stale", "n3": "stale"}
    assert {r["id"] for r in after.edges.collect()} == {"e2"} and {r["id"] for r in after.items.collect()} == {"i2"}


def test_updating_a_node_moves_edges_and_tells_notes(spark):
    t = tables(spark, **GRAPH)
    after = twice(t, changes.updated(frame(spark, [("p", "page edited"), ("nobody", "x")], "id string, body string"), t, NOW, 1))
    status = {r["id"]: r["status"] for r in after.nodes.collect()}
    new = next(i for i in status if i not in {n[0] for n in GRAPH["nodes"]})
    assert status == {"p": "superseded", new: "active", "q": "active", "n1": "stale", "n2": "stale", "n3": "stale"}
    ties = {(r["source_node_id"], r["target_node_id"], r["label"]) for r in after.edges.collect()}
    assert ties == {(new, "n1", "supports"), ("n1", "n2", "supports"), (new, "n3", "supports"), (new, "q", "follows"), ("n1", new, "reference"), ("p", new, "superseded_by"), (new, "p", "supersedes")}
    assert {r["id"] for r in after.items.collect()} == {"i2"}


def test_all_notes_of_an_edited_node_go_stale(spark):
    nodes = [("p", "endogenous", "active", "d", "page", "2020")] + [(f"n{i:03}", "exogenous", "active", None, f"note {i}", "2020") for i in range(130)]
    edges = [(f"e{i}", "p", f"n{i:03}", "supports", "2020") for i in range(130)]
    t = tables(spark, nodes=nodes, edges=edges)
    after = twice(t, changes.updated(frame(spark, [("p", "page edited")], "id string, body string"), t, NOW, 1))
    assert after.nodes.filter((F.col("type") == "exogenous") & (F.col("status") == "stale")).count() == 130


def test_notes_edited_to_one_body_become_one_node(spark):
    """All of its columns are those of the last note by id, whatever the order of rows."""
    nodes = [(f"n{i}", "exogenous", "active", f"d{i}", f"note {i}", "2020") for i in range(9)]
    t = tables(spark, nodes=nodes[4:] + nodes[:4])
    after = twice(t, changes.updated(frame(spark, [(n[0], "one body") for n in nodes[4:] + nodes[:4]], "id string, body string"), t, NOW, 1))
    got = [(r["status"], r["original_document_name"]) for r in after.nodes.filter(F.col("body") == "one body").collect()]
    assert got == [("active", "d8")]
    assert {r["id"] for r in after.nodes.filter(F.col("status") == "superseded").collect()} == {n[0] for n in nodes}


def test_notes_are_written_anew_where_they_can_be(spark):
    t = tables(spark, **GRAPH)

    def anew(hit, supports):
        row = F.struct(F.lit("n9").alias("id"), F.lit("exogenous").alias("type"), F.lit("active").alias("status"), F.lit("fresh").alias("body"), F.lit("2025").alias("created_at"))
        return supports.filter(F.col("note") == "n2").select(F.col("note").alias("old"), row.alias("r")).distinct().select("old", "r.*")

    after = twice(t, changes.deleted(frame(spark, [("p",)], "id string"), t, NOW, 1, anew))
    assert {r["id"]: r["status"] for r in after.nodes.collect()} == {"q": "active", "n1": "stale", "n2": "superseded", "n9": "active", "n3": "stale"}
    assert ("n1", "n9", "supports") in {(r["source_node_id"], r["target_node_id"], r["label"]) for r in after.edges.collect()}


def pages_of(spark, rows):
    ddl = "original_document_name string, ord long, id string, body string, source_version string"
    made = schema.conform(frame(spark, rows, ddl), schema.NODES).withColumns({"type": F.lit("endogenous"), "status": F.lit("active"), "source_material_hash": F.sha2("body", 256), "created_at": F.lit(NOW)})
    return made.join(frame(spark, [(r[2], r[1]) for r in rows], "_i string, ord long"), F.col("id") == F.col("_i")).drop("_i")


def test_ingesting_revises_what_is_known(spark):
    words = " ".join(f"w{i}" for i in range(30))
    t = tables(spark, nodes=[("same", "endogenous", "active", "d", "alike", "2020"), ("was", "endogenous", "active", "d", words, "2020"), ("left", "endogenous", "active", "d", "gone now", "2020"), ("n1", "exogenous", "active", None, "note", "2020"), ("n2", "exogenous", "active", None, "note", "2020"), ("had", "endogenous", "active", "f", "complete", "2020")],
               edges=[("e1", "was", "n1", "supports", "2020"), ("e2", "same", "n2", "supports", "2020"), ("e3", "same", "was", "follows", "2020")], items=[("i1", "was")], sources=[("d", "v0")])
    pages = pages_of(spark, [("d", 1, "copy", "alike", "v1"), ("d", 2, "now", words + " and more", "v1"), ("d", 3, "fresh", "not seen before", "v1"), ("f", 1, "had", "complete", "v1"), ("f", 2, "two", "second", "v1")])
    ties = changes.edges_of(frame(spark, [("now", "fresh"), ("copy", "now"), ("had", "two")], "a string, b string"), "follows", "", NOW)
    made, actions = changes.ingested(pages, ties, frame(spark, [("had",)], "id string"), t, NOW, 1)
    assert {(r["id"], r["action"]) for r in actions.collect()} == {("copy", "unchanged"), ("now", "superseded"), ("fresh", "new"), ("left", "stale"), ("two", "ingested")}
    after = twice(t, made)
    assert {r["id"]: r["status"] for r in after.nodes.collect()} == {"same": "active", "was": "superseded", "now": "active", "fresh": "active", "left": "stale", "n1": "stale", "n2": "active", "had": "active", "two": "active"}
    follows = {(r["source_node_id"], r["target_node_id"]) for r in after.edges.collect() if r["label"] == "follows"}
    assert follows == {("now", "fresh"), ("had", "two")}  # same -> was is gone, copy was never put
    assert {r["document_name"]: r["source_hash"] for r in after.sources.collect()} == {"d": "v1", "f": "v1"} and after.items.count() == 0


def test_ingesting_a_family_of_pages_takes_no_round_for_each(spark):
    """All new pages of a document are as like to all old ones, so that they take them in order."""
    words = " ".join(f"w{i}" for i in range(30))
    t = tables(spark, nodes=[(f"o{i:02}", "endogenous", "active", "d", f"{words} old{i:02}", "2020") for i in range(30)], sources=[("d", "v0")])
    pages = pages_of(spark, [("d", i, f"p{i:02}", f"{words} new{i:02}", "v1") for i in range(34)])
    spark.sparkContext.setJobGroup("ingest", "")
    _, actions = changes.ingested(pages, changes.edges_of(frame(spark, [], "a string, b string"), "follows", "", NOW), frame(spark, [], "id string"), t, NOW, 1)
    got = {(r["id"], r["action"], r["old_id"]) for r in actions.collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(f"p{i:02}", "superseded", f"o{i:02}") for i in range(30)} | {(f"p{i:02}", "new", None) for i in range(30, 34)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ingest")) < 90


def test_creating_a_document(spark):
    words = " ".join(f"w{i}" for i in range(30))
    t = tables(spark, nodes=[("was", "endogenous", "active", "d", words, "2020"), ("left", "endogenous", "active", "d", "quite other", "2020"), ("kept", "endogenous", "active", "e", "the same", "2020"), ("n1", "exogenous", "active", None, "note", "2020")], edges=[("e1", "left", "n1", "supports", "2020")])
    given = frame(spark, [("d", words + " more", "", None, None, None), ("e", "the same", "", None, None, None), ("g", "brand new", "T", None, None, None)], "document_name string, body string, title string, claims array<string>, keywords array<string>, entity string")
    made, actions = changes.created_document(given, t, NOW, 1)
    after = twice(t, made)
    status = {r["id"]: r["status"] for r in after.nodes.collect()}
    assert {k: status[k] for k in ("was", "left", "kept", "n1")} == {"was": "superseded", "left": "stale", "kept": "active", "n1": "stale"} and len(status) == 6
    assert sorted(r["action"] for r in actions.collect()) == ["stale", "superseded", "unchanged"] and after.sources.count() == 3


# stored tables and the index


def test_a_stored_table_keeps_the_first_write_of_an_id(spark, tmp_path):
    """Document 13 isn't in the table that the merge finds, so 16, of the same text, must not be either."""
    frame(spark, [(i, "same" if i in (13, 16) else f"text {i}", "en", "s") for i in range(24)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r["title"]: (r["created_at"], r["updated_at"]) for r in writes.upsert_stored(spark, str(tmp_path)).collect()}
    assert len(rows) == 23 and rows["same"] == ("2024-01-01T00:00:13", "2024-01-01T00:00:16")


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = frame(spark, [(f"k{i}", i) for i in range(200)], "id string, v long")
    bucketed.create(rows, path, "id", 8)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    new = frame(spark, [("k3", -3), ("new", 1)], "id string, v long")
    touched = bucketed.merge(spark, path, "id", 8, new, lambda old, c: old.join(c.select("id"), "id", "left_anti").unionByName(c))
    after = files()
    assert len(touched) <= 2 and {k for k in before if k in after} == {k for k in before if not any(f"{bucketed.BUCKET}={b}{os.sep}" in k for b in touched)}
    want = {f"k{i}": i for i in range(200)} | {"k3": -3, "new": 1}
    assert {r["id"]: r["v"] for r in bucketed.read(spark, path).collect()} == want
    bucketed.merge(spark, path, "id", 8, bucketed.read(spark, path).select("id", "v"), lambda old, c: old.filter(F.col("id") == "k3"))
    assert [tuple(r) for r in bucketed.read(spark, path).select("id", "v").collect()] == [("k3", -3)]
    assert bucketed.merge(spark, path, "id", 8, new.limit(0), lambda old, c: old) == []


def test_the_index_by_differences_is_the_index_built_anew(spark):
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice(["apple", "pear", "fig", "plum", "kiwi", "date"]) for _ in range(rnd.randint(0, 12)))
    docs = {f"d{i}": text() for i in range(40)}
    queries = frame(spark, [("q1", "apple fig"), ("q2", "kiwi kiwi date"), ("q3", "nothing")], "query_id string, text string")
    index = keyword_index.built(frame(spark, list(docs.items()), "id string, text string"))
    for turn in range(4):
        put = {rnd.choice([*docs, f"new{turn}"]): text() for _ in range(6)}
        gone = [] if turn == 2 else rnd.sample(sorted(docs), 3)
        docs = {k: v for k, v in docs.items() if k not in gone} | put
        index = keyword_index.changed(index, frame(spark, list(put.items()), "id string, text string"), frame(spark, [(g,) for g in gone], "id string"))
        index = keyword_index.compacted(index) if turn == 1 else index
        want = search.bm25(frame(spark, list(docs.items()), "id string, text string"), queries)
        assert sorted(map(tuple, keyword_index.search(index, queries).collect())) == sorted(map(tuple, want.collect()))
        assert index.n == len(docs)


def test_a_change_of_the_index_writes_the_changed_documents_alone(spark, monkeypatch):
    """Neither the rows that are taken off nor those of earlier changes are written again, until there are many tables of them."""
    rows, plain = [], keyword_index.written

    def counted(df):
        out = plain(df)
        rows.append(out.count() if "terms" in df.columns else 0)
        return out

    monkeypatch.setattr(keyword_index, "written", counted)
    monkeypatch.setattr(keyword_index, "MANY", 2)
    docs = {f"d{i}": f"fig plum{i % 3}" for i in range(20)}
    index = keyword_index.built(frame(spark, list(docs.items()), "id string, text string"))
    queries = frame(spark, [("q1", "fig plum1"), ("q2", "new")], "query_id string, text string")
    wrote = []
    for turn in range(4):
        monkeypatch.setattr(keyword_index, "MOST_GONE", 0 if turn == 2 else 100)
        put = {f"d{turn}": "new fig", "d9": f"plum1 turn{turn}"}
        docs = {k: v for k, v in docs.items() if k != f"d{turn + 10}"} | put
        rows.clear()
        index = keyword_index.changed(index, frame(spark, list(put.items()), "id string, text string"), frame(spark, [(f"d{turn + 10}",)], "id string"))
        wrote.append(sum(rows))
        want = search.bm25(frame(spark, list(docs.items()), "id string, text string"), queries)
        assert sorted(map(tuple, keyword_index.search(index, queries).collect())) == sorted(map(tuple, want.collect()))
    assert wrote == [2, 2, 2 + 4, 2] and index.n == len(docs) and index.total == sum(len(t.split()) for t in docs.values())


def test_index_has_one_row_for_each_document(spark):
    docs = frame(spark, [("a", "fig fig plum"), ("b", None), ("c", "fig")], "id string, text string")
    index = keyword_index.built(docs)
    assert sorted((r["id"], r["length"], sorted(zip(r["terms"], r["tf"], strict=True))) for r in index.base.collect()) == [("a", 3, [("fig", 2), ("plum", 1)]), ("b", 0, []), ("c", 1, [("fig", 1)])]
    queries = frame(spark, [("q", "fig plum"), ("r", "fig")], "query_id string, text string")
    few, many = (sorted(map(tuple, keyword_index.search(index, queries, most=m).collect())) for m in (9, 0))
    assert few == many and len(few) == 4


# streams


def plain_queue(commands, capacity):
    waiting, running, out = [], None, []
    for seq, job, command in commands:
        told = None
        if command == "enqueue":
            told = (job, "queued") if len(waiting) < capacity else (job, "failed")
            if told[1] == "queued":
                waiting.append(job)
        elif command == "cancel" and job in waiting:
            waiting[waiting.index(job)] = None
            told = (job, "cancelled")
        elif command == "take" and running is None:
            while waiting and running is None:
                running = waiting.pop(0)
            told = (running, "running") if running else None
        elif command in ("finish", "fail") and running:
            told, running = (running, {"finish": "done", "fail": "failed"}[command]), None
        if told:
            out.append((seq, *told, len(waiting)))
    return out


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobqueue.STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_the_bounded_queue(rocks, tmp_path):
    rnd, source, commands = random.Random(2), str(tmp_path / "in"), {"a": [], "b": []}
    for seq in range(120):
        own = commands[rnd.choice("ab")]
        command = rnd.choice(["enqueue"] * 5 + ["take", "take", "finish", "fail", "cancel", "cancel"])
        own.append((seq, rnd.choice(own[-6:])[1] if own and command == "cancel" else f"j{seq}", command))
    rows = sorted((s, k, j, c) for k, v in commands.items() for s, j, c in v)
    for part in (rows[:50], rows[50:]):
        frame(rocks, [(k, s, j, c) for s, k, j, c in part], "queue string, seq long, job_id string, command string").coalesce(1).write.mode("append").parquet(source)
        stream = rocks.readStream.schema("queue string, seq long, job_id string, command string").parquet(source)
        jobqueue.queue_states(stream, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in rocks.read.parquet(str(tmp_path / "out")).orderBy("seq").select("queue", "seq", "job_id", "status", "depth", "error").collect()]
    for k, v in commands.items():
        assert [(s, j, st, d) for q, s, j, st, d, _ in got if q == k] == plain_queue(v, 4)
    assert {e for *_, st, _, e in got if e} == {jobqueue.FULL} and {"cancelled", "done", "failed", "running"} <= {r[3] for r in got}


def test_a_job_that_fails_stops_no_other(rocks, tmp_path):
    def judge(job_id, payload):
        if payload == "bad":
            raise ValueError(job_id)

    source = str(tmp_path / "in")
    frame(rocks, [("w", i, f"j{i}", "bad" if i == 1 else "good") for i in range(4)], "worker string, seq long, job_id string, payload string").coalesce(1).write.parquet(source)
    stream = rocks.readStream.schema("worker string, seq long, job_id string, payload string").parquet(source)
    query = jobqueue.enriched(stream, judge, 0.2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    got, until = [], time.time() + 60
    while len(got) < 4 and time.time() < until and query.isActive:
        time.sleep(1)
        if os.path.isdir(tmp_path / "out" / "_spark_metadata"):
            got = rocks.read.schema("job_id string, status string, error string, at long").parquet(str(tmp_path / "out")).orderBy("at").collect()
    query.stop()
    assert [(r["job_id"], r["status"]) for r in got] == [("j0", "done"), ("j1", "failed"), ("j2", "done"), ("j3", "done")]
    assert "ValueError: j1" in got[1]["error"] and all(b["at"] - a["at"] >= 200 for a, b in zip(got, got[1:], strict=False))


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(u, f"2024-01-{1 + rnd.randint(0, 5):02} {rnd.randint(0, 23):02}:{rnd.randint(0, 59):02}:00") for u in range(4) for _ in range(30)]
    events = frame(spark, rows, "u long, t string").select("u", F.to_timestamp("t").alias("t"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    last = frame(spark, [(9, "2024-03-01 00:00:00")], "u long, t string").select("u", F.to_timestamp("t").alias("t"))
    want = sorted(map(tuple, jobqueue.sessions(events, "u", "t", "3 hours").collect()))
    stream = spark.readStream.schema("u long, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: jobqueue.sessions(stream, "u", "t", "3 hours", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


# markdown and ports


def test_segments_are_lossless(spark):
    rnd = random.Random(7)
    bits = ["<image-unit>", "</image-unit>", "<IMAGE-UNIT id=1>", "<image-media><img src='a.png' alt=\"b\"></image-media>", "<image-description> said </image-description>", "text\n", "<img src=x>", " ", "é"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(80)] + ["", None]
    df = frame(spark, list(enumerate(texts)), "k int, t string")
    rows = segments.segments(df, "k", "t")
    assert {r["k"]: r["text"] for r in segments.joined(rows, "k").collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert {r["kind"] for r in rows.collect()} == {"markdown", "image"}


def test_units_come_back_as_they_were_told(spark):
    parts = frame(spark, [(1, "a b.png", 'x "y" & <z>', "it's", "line\nand < more"), (2, "c.png", "", "", ""), (3, "", "only alt", "", "said")], "k int, src string, alt string, title string, description string")
    told = parts.select("k", F.concat(F.lit("before "), segments.unit(F.col("src"), F.col("alt"), F.col("title"), F.col("description"))).alias("t"))
    rows = {r["k"]: r for r in segments.segments(told, "k", "t").collect() if r["kind"] == "image"}
    assert rows[1]["src"] == "a b.png" and rows[1]["alt"] == "x &quot;y&quot; &amp; &lt;z&gt;" and rows[1]["description"] == "line\nand < more"
    assert {r["k"]: r["problem"] for r in segments.problems(segments.segments(told, "k", "t"), "k").collect()} == {2: segments.UNDESCRIBED}
    assert (rows[3]["src"], rows[3]["title"], rows[3]["description"]) == ("", "", "said")


def test_texts_that_a_port_refuses_are_averaged_over_parts(spark):
    class Picky:
        """Refuses texts of more than two words, and more than three texts at once."""

        def embed(self, texts):
            if len(texts) > 3 or any(len(t.split()) > 2 for t in texts):
                raise RuntimeError("this model's maximum context length is 2")
            return np.array([[float(len(t.split())), 1.0] for t in texts], dtype=np.float32)

    assert ports.in_parts(Picky().embed, "a b\nc").tolist() == [1.5, 1.0]
    assert ports.in_parts(Picky().embed, "a b\nc d\ne").tolist() == pytest.approx([5 / 3, 1.0])
    for text in ("a b c", ""):
        with pytest.raises((ValueError, RuntimeError)):
            ports.in_parts(Picky().embed, text)
    rows = ports.embedded(frame(spark, [("a",), ("a b\nc",), ("b",), ("",), ("c d",)], "t string"), "t", Picky()).collect()
    assert [r["embedding"][0] for r in rows] == [1.0, 1.5, 1.0, 0.0, 2.0]


def test_the_graph_of_change_sets_is_made_once(spark):
    t = writes.tables(spark, "/root/testdata/sf0.001")
    assert not [f for f in t.edges.inputFiles() + t.nodes.inputFiles() if "testdata" in f]
