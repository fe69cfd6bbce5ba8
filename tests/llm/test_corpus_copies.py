"""Exact and near copies against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from codexmill.llm import exact_dedup, jaccard_join

DDL = "doc_id long, text string, kept int, group_size string, class_id string, _tag int, _key string, text_hash string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "g", "c", 5, "k", "h") for r in rows], DDL)


@pytest.mark.parametrize("heavy", [2, 256])
def test_exact_dedup(spark, heavy):
    rows = [(i, "many") for i in range(40)] + [(50, None), (51, ""), (52, "one"), (53, "One"), (54, "x" * 100_000), (55, "x" * 100_000), (60, "twice"), (60, "twice"), (None, "lost"), (None, "lost"), (None, "many")]
    got = exact_dedup.exact_dedup(frame(spark, rows), heavy=heavy).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    for digest, _ in groups.items():
        assert sum(r["kept"] for r in got if r["text_sha256"] == digest) == 1


def test_distinct_documents_keep_their_columns(spark):
    docs = frame(spark, [(1, "a"), (2, "a"), (3, None), (3, None)])
    out = exact_dedup.distinct_documents(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]


def grams(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """links and classes over different texts"""
    texts = sorted({t or "" for _, t in rows})
    sets = {t: grams(t) for t in texts}
    linked = {(a, b) for a in texts for b in texts if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = {t: t for t in texts}
    find = lambda t: t if root[t] == t else find(root[t])
    for a, b in linked:
        root[find(a)] = find(b)
    return {t: sum(x == t for x, _ in linked) for t in texts}, {t: find(t) for t in texts}


@pytest.fixture(scope="module")
def near():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 7)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, rows[0][1].upper()), (i + 2, None), (i + 3, ""), (i + 4, "three short words"), (i + 5, "Three short  words"), (None, rows[3][1])]
    return rows


@pytest.mark.parametrize("block", [3, 128])
def test_jaccard_join(spark, near, block):
    links, classes = brute(near)
    got = jaccard_join.jaccard_join(frame(spark, near), block=block).collect()
    assert len(got) == len(near)
    text_of = {i: t or "" for i, t in near if i is not None}
    members = defaultdict(list)
    for i, t in near:
        members[classes[t or ""]].append(i)
    for r in got:
        t = text_of[r["doc_id"]] if r["doc_id"] is not None else near[3][1]
        own = members[classes[t]]
        assert (r["n_links"], r["class_size"], r["class_id"]) == (links[t], len(own), min(i for i in own if i is not None)), r
    assert sum(r["kept"] for r in got) == len(members)


def test_banding_reaches_its_recall():
    bands, rows = jaccard_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= jaccard_join.MOST_HASHES
    for low in (0.01, 0.05, 0.3, 0.9999):
        bands, rows = jaccard_join.banding(low)
        assert 1 - (1 - low**rows) ** bands >= 0.998


@pytest.mark.parametrize("block", [4, 256])
def test_a_large_family_of_near_copies(spark, block):
    """Near ones that are only counted, and far ones in blocks, of one family; null doc_ids among them."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 3, 9])):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        rows.append((i if i % 7 else None, " ".join(copy)))
    links, classes = brute(rows)
    got = jaccard_join.jaccard_join(frame(spark, rows), block=block).collect()
    want = sorted((-1 if i is None else i, links[t], sum(classes[x] == classes[t] for _, x in rows)) for i, t in rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_links"], x["class_size"]) for x in got) == want
    assert len(set(links.values())) > 3 and sum(x["kept"] for x in got) == len(set(classes.values()))


def test_rows_that_differ_in_other_columns_only(spark):
    rows = [(1, "a b", k, "g", "c", 5, "k", "h") for k in range(6)]
    kept = {exact_dedup.distinct_documents(spark.createDataFrame(some, DDL)).collect()[0]["kept"] for some in (rows, rows[::-1])}
    assert len(kept) == 1


def test_no_rows(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0 and jaccard_join.jaccard_join(none).count() == 0
