"""URL filters, source mixing and exact top-k against restatements."""

import re

import numpy as np
import pytest

from codexmill.llm import mixing, topk, url_filters

PAGES = [
    (1, "http://www.Example.com/en/a?x=1", '<a href="/en/b">s</a>'), (2, "https://example.com/en/b", None), (3, "http://spam.net/es/x", '<A HREF=http://farm.org/>f</A>'), (4, "http://farm.org/links", '<a href="http://spam.net/fr/1">x</a>'),
    (5, "no scheme", "<a href='http://spam.net/'>"), (6, None, None), (7, "http://good.org/p#f", '<a class="k" href="//example.com/">e</a>'), (7, "http://good.org/p#f", ""), (None, "ftp://a.com", ""), (9, "http://notcom/", "x" * 50_000), (10, "http://example.com", "")]


def judged(spark, rows):
    return url_filters.judge_urls(spark.createDataFrame([(*r, "v", 1.0) for r in rows], "page_id long, url string, html string, verdict string, trust double"))


def test_rules_and_hosts(spark):
    got = {r["page_id"]: r for r in judged(spark, PAGES).collect()}
    want = {1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("example.com", "/en/b", "example.com/en/", "block"), 3: ("spam.net", "/es/x", "net/es/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), None: ("a.com", "", None, "allow"), 9: ("notcom", "/", None, "allow"), 10: ("example.com", "", None, None)}
    for k, (host, path, rule, verdict) in want.items():
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
    assert got[4]["verdict"] == "block" and got[4]["distrust"] > got[4]["trust"]  # it links to the blocked host
    assert judged(spark, PAGES).count() == len(PAGES) and judged(spark, PAGES[:1]).limit(0).count() == 0


def test_propagation_is_personalised_pagerank(spark):
    rng = np.random.default_rng(2)
    w = rng.random((6, 6)) * (rng.random((6, 6)) < 0.5)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
    edges = spark.createDataFrame([("t", str(i), str(j), float(w[i, j])) for i in range(6) for j in range(6) if w[i, j]], "kind string, src string, dst string, w double")
    seed = np.array([0.5, 0.5, 0, 0, 0, 0])
    rank = 0.15 * seed  # scores grow from nothing
    for _ in range(4):
        rank = 0.85 * rank @ w + 0.15 * seed
    seeds = spark.createDataFrame([("t", "0", 0.5), ("t", "1", 0.5)], "kind string, host string, share double")
    got = {r["host"]: r["score"] for r in url_filters.propagate(edges, seeds, rounds=5).collect()}
    for i in range(6):
        assert got.get(str(i), 0.0) == pytest.approx(rank[i], abs=1e-12)


def test_a_row_of_hosts_is_parted_in_the_middle(spark):
    n, edges = 12, []
    ties = [(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    for kind in ("trust", "distrust"):
        edges += [(kind, str(i), str(j), 1.0 / sum(a == i for a, _ in ties)) for i, j in ties]
    seeds = [("trust", "0", 1.0), ("distrust", str(n - 1), 1.0)]
    got = url_filters.propagate(spark.createDataFrame(edges, "kind string, src string, dst string, w double"), spark.createDataFrame(seeds, "kind string, host string, share double")).collect()
    score = {(r["kind"], r["host"]): r["score"] for r in got}
    w = np.zeros((n, n))
    for _, i, j, x in edges[: len(ties)]:
        w[int(i), int(j)] = x
    want = {k: 0.15 * np.linalg.solve(np.eye(n) - 0.85 * w.T, np.eye(n)[at]) for k, at in (("trust", 0), ("distrust", n - 1))}
    for i in range(n):
        trust, distrust = (score.get((k, str(i)), 0.0) for k in ("trust", "distrust"))
        assert (distrust > trust) == (want["distrust"][i] > want["trust"][i]) == (i >= n // 2)
        assert trust <= want["trust"][i] + 1e-12 and distrust <= want["distrust"][i] + 1e-12  # scores grow towards the limit


def limits(links, trust, distrust):
    """Exact scores: links (src, dst) to weights, seeds to shares; distrust goes against the links."""
    hosts = sorted({x for pair in links for x in pair} | set(trust) | set(distrust))
    at = {h: i for i, h in enumerate(hosts)}
    out = {}
    for kind, seeds in (("trust", trust), ("distrust", distrust)):
        w = np.zeros((len(hosts), len(hosts)))
        for (a, b), x in links.items():
            w[(at[a], at[b]) if kind == "trust" else (at[b], at[a])] += x
        w /= np.maximum(w.sum(1, keepdims=True), 1e-300)
        share = np.array([seeds.get(h, 0.0) for h in hosts])
        out[kind] = np.linalg.solve(np.eye(len(hosts)) - url_filters.DAMPING * w.T, (1 - url_filters.DAMPING) * share)
    return {h: (out["trust"][i], out["distrust"][i]) for h, i in at.items()}


def propagated(spark, links, trust, distrust):
    edges = []
    for kind in ("trust", "distrust"):
        ways = [((a, b) if kind == "trust" else (b, a), x) for (a, b), x in links.items()]
        out = {}
        for (a, _), x in ways:
            out[a] = out.get(a, 0) + x
        edges += [(kind, a, b, x / out[a]) for (a, b), x in ways]
    seeds = [(k, h, x) for k, given in (("trust", trust), ("distrust", distrust)) for h, x in given.items()]
    rank = url_filters.propagate(spark.createDataFrame(edges, "kind string, src string, dst string, w double"), spark.createDataFrame(seeds, "kind string, host string, share double"))
    scores = {(r["kind"], r["host"]): r["score"] for r in rank.collect()}
    return {h: tuple(scores.get((k, h), 0.0) for k in ("trust", "distrust")) for h in {x for pair in links for x in pair}}


def test_distrust_passes_hosts_that_trust_has_settled(spark):
    """A front of distrust goes through thirty hosts that are trusted for good, and blocks the one beyond."""
    links = {(f"c{i + 1}", f"c{i}"): 1000.0 for i in range(1, 30)} | {("c1", "B"): 1000.0, ("X", "c30"): 1.0, ("A2", "X"): 1.0}
    links |= {("A", f"c{i}"): 1.0 for i in range(1, 31)}
    trust, distrust = {"A": 1 - 1e-6, "A2": 1e-6}, {"B": 0.01, "elsewhere": 0.99}
    want, got = limits(links, trust, distrust), propagated(spark, links, trust, distrust)
    assert want["X"][1] > 30 * want["X"][0] and got["X"][1] > got["X"][0]
    assert all((got[h][1] > got[h][0]) == (want[h][1] > want[h][0]) for h in got)


def test_verdicts_of_random_graphs(spark):
    """Two hundred graphs at once, side by side, with chains that settle one after the other."""
    r = np.random.default_rng(12)
    links, trust, distrust = {}, {}, {}
    for g in range(200):
        n = int(r.integers(3, 9))
        for _ in range(int(r.integers(2, 3 * n))):
            a, b = r.integers(0, n, 2)
            if a != b:
                links[f"{g}.{a}", f"{g}.{b}"] = float(r.integers(1, 4))
        for k in range(int(r.integers(0, 14))):
            links[f"{g}.{n + k}", f"{g}.{n + k - 1}"] = float(r.integers(1, 500))
            if r.random() < 0.5:
                links[f"{g}.0", f"{g}.{n + k}"] = 1.0
        for seeds in (trust, distrust):
            seeds[f"{g}.{int(r.integers(0, n))}"] = float(r.random()) + 1e-4
    trust, distrust = ({h: x / sum(seeds.values()) for h, x in seeds.items()} for seeds in (trust, distrust))
    want, got = limits(links, trust, distrust), propagated(spark, links, trust, distrust)
    open_ = [h for h in got if abs(want[h][1] - want[h][0]) > 1e-9 * sum(want[h])]
    assert len(open_) > 1000 and all((got[h][1] > got[h][0]) == (want[h][1] > want[h][0]) for h in open_)


def level_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def test_mixing(spark):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))), ["b", "a", "c", None, "É"][i % 5 if i % 3 else 0]) for i in range(600)]
    rows += [(700, None, "a"), (701, "", "only empty"), (702, "q " * 50_000, "b"), (None, "no id", "a"), (5, "w w", "a"), (5, "w w", "a")]
    docs = spark.createDataFrame([(*x, 1, 2.0, "z") for x in rows], "doc_id long, text string, source string, size int, target double, copies string")
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = level_targets(sizes)
    source = {(i, size(t)): s for i, t, s in rows}
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for x in got:
        s = source[(x["doc_id"], x["size"])]
        taken[s] += x["taken"]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(want[s]) and x["taken"] <= 3 * x["size"]
    for s in sizes:
        near = 25_000 if s == "b" else max(2, 0.01 * want[s])  # half of b's longest document
        assert abs(taken[s] - want[s]) <= near, s
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted((str(x["doc_id"]), x["size"], x["taken"]) for x in again) == sorted((str(x["doc_id"]), x["size"], x["taken"]) for x in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x["copies"] for x in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def inclusion(sizes, want):
    """p = min(1, r * size) with the rate that makes the words expected the words wanted."""
    sizes, low, high = np.array(sizes, dtype=float), 0.0, 10.0
    for _ in range(200):
        r = (low + high) / 2
        low, high = (r, high) if (sizes * np.minimum(1, r * sizes)).sum() < want else (low, r)
    return np.minimum(1, r * sizes)


def test_documents_are_drawn_by_their_words(spark):
    """Among many documents of one size, the share drawn is the probability, computed anew here."""
    sizes = {"a": [1, 2, 3, 5, 8, 40] * 400, "b": [4] * 300 + [20] * 300 + [2000], "c": [6, 7] * 4000}
    rows = [(100_000 * k + i, " ".join(["w"] * n), s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = level_targets({s: sum(ns) for s, ns in sizes.items()})
    got = {x["doc_id"]: x for x in mixing.mix_sources(docs).collect()}
    for k, (s, ns) in enumerate(sizes.items()):
        whole = int(want[s] // sum(ns))
        p = inclusion(ns, want[s] - whole * sum(ns)) if want[s] - whole * sum(ns) > 1e-9 else np.zeros(len(ns))
        for n in set(ns):
            some = [i for i in range(len(ns)) if ns[i] == n]
            assert all(got[100_000 * k + i]["p"] == pytest.approx(p[i], abs=1e-9) for i in some)
            share = np.mean([got[100_000 * k + i]["copies"] - whole for i in some])
            assert share == pytest.approx(p[some[0]], abs=0.01 + 4 * np.sqrt(p[some[0]] * (1 - p[some[0]]) / len(some))), (s, n)


@pytest.mark.parametrize("segment", [16, 4096])
def test_exact_topk(spark, segment):
    r = np.random.default_rng(6)
    m = r.normal(size=(120, 8))
    m[50:60] = m[3]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(200, None), (201, [1.0, None] + [0.0] * 6), (202, [float("nan")] * 8), (203, [float("inf")] * 8)]
    rows += [(None, [9.0] * 8), (100, [0.5] * 3), (250, [])]  # no id; an id twice, shorter; nothing but zeros
    v = spark.createDataFrame([(*x, 1, "s", 2) for x in rows], "vec_id long, embedding array<double>, score int, part string, home int")
    got = {}
    for x in topk.exact_topk(v, segment=segment, block=8, pivots=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    e = np.floor(np.vstack([m, [0.5] * 3 + [0] * 5, [0] * 8]) * 256).astype(int)
    ids = [*range(120), 100, 250]
    want = {}
    for q in (0, 50, 100, 120, 121):
        best = sorted((-int(e[q] @ e[i]), ids[i]) for i in range(122) if i != q)[:5]
        want.setdefault(ids[q], []).extend((k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    assert topk.exact_topk(v.limit(0)).count() == 0


def test_scores_beyond_a_long_are_an_error(spark):
    v = spark.createDataFrame([(0, [1e8] * 700), (1, [1e8] * 700)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="range of a long"):
        topk.exact_topk(v).collect()


def test_bounds_prune_where_vectors_lie_in_groups():
    """Most blocks are never scored on grouped vectors; the results stay those of brute force."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    m = np.floor(256 * (centres[np.repeat(np.arange(40), 32)] + r.normal(size=(1280, 16)) * 0.02)).astype(np.int64)
    ids = np.arange(1280)
    q, row, score, pruned = topk.best_of(m, ids, ids, m[::50], ids[::50], np.full(26, -np.inf), 5, 32)
    for n, i in enumerate(ids[::50]):
        best = sorted((-int(m[i] @ m[j]), j) for j in ids if j != i)[:5]
        assert [(-s, j) for s, j in zip(score[q == n], row[q == n])] == best
    assert pruned > 0.8


def test_verdicts_of_a_long_chain_are_those_of_the_limit(spark):
    """Sixty hosts between an allowed and a blocked one, and sixty that alone lead to a blocked one."""
    chain = [f"h{i}.zz" for i in range(60)]
    alone = [f"k{i}.zz" for i in range(60)]
    hosts = ["good.com", *chain, "bad.net", *alone, "worse.net"]
    path = lambda h: "/es/" if h.endswith(".net") else "/"
    follows = {h: hosts[i + 1] for i, h in enumerate(hosts[:-1]) if h != "bad.net"}
    rows = [(i, f"http://{h}{path(h)}", f'<a href="http://{follows[h]}/">x</a>' if h in follows else "") for i, h in enumerate(hosts)]
    n = len(hosts)
    link = np.zeros((n, n))
    for h, to in follows.items():
        link[hosts.index(h), hosts.index(to)] = 1.0

    def limit(w, seeds):
        share = np.array([float(h in seeds) / len(seeds) for h in hosts])
        return np.linalg.solve(np.eye(n) - url_filters.DAMPING * w.T, (1 - url_filters.DAMPING) * share)

    trust, distrust = limit(link, ["good.com"]), limit(link.T, ["bad.net", "worse.net"])
    got = {r["host"]: r for r in judged(spark, rows).collect()}
    for i, h in enumerate(hosts):
        assert got[h]["trust"] == pytest.approx(trust[i], rel=1e-4, abs=1e-300) and got[h]["distrust"] == pytest.approx(distrust[i], rel=1e-4, abs=1e-300)
        if h in chain or h in alone:
            assert got[h]["verdict"] == ("block" if distrust[i] > trust[i] else "allow"), h
    assert {got[h]["verdict"] for h in chain} == {"allow", "block"} and {got[h]["verdict"] for h in alone} == {"block"}
