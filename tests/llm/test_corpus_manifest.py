"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest

from codexmill.llm import merkle

DDL = "doc_id long, source string, lang string, n_chars long, text string, seq int, leaf string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def joined(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    values = (row["doc_id"], row["source"], row["lang"], n_chars, row["text"])
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def beside(tree, index, fanout):
    out = []
    for level in tree[:-1]:
        begin = index - index % fanout
        out.append((level[begin:index], level[index + 1 : begin + fanout]))
        index //= fanout
    return out


def plain(rows, fanout):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for own in by_lang.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"])))
    trees = {k: levels([leaf(r, r["n_chars"]) for r in by_lang[k]], fanout) for k in langs}
    over = levels([trees[k][-1][0] for k in langs], fanout)
    out = []
    for j, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            path, n = beside(trees[lang], i, fanout) + beside(over, j, fanout), row["n_chars"]
            if None not in (row["doc_id"], n) and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
                n += 1
            fold = leaf(row, n)
            for left, right in path:
                fold = joined([*left, fold, *right])
            out.append((row["doc_id"], trees[lang][0][i], trees[lang][-1][0], over[-1][0], joined(x for left, right in path for x in left + right), fold, fold == over[-1][0]))
    return out


def text_key(row):
    return tuple(map(str, row))


@pytest.mark.parametrize(("n", "fanout"), [(0, 2), (1, 2), (2, 3), (41, 2), (150, 3), (150, 5)])
def test_as_plain_trees(spark, monkeypatch, n, fanout):
    """Tiny ranges and blocks, so that trees span many of both; nulls, repeated doc_ids and rows, clashing names."""
    monkeypatch.setattr(merkle.Forest.__init__, "__defaults__", (2, 8, 7))
    rnd = random.Random(n + fanout)
    rows = [(rnd.choice([None, *range(n)]), rnd.choice([None, "", "é"]), rnd.choice([None, "a", "é"]), rnd.choice([None, 3]), "t" * rnd.randint(0, 3), 9, "x") for _ in range(n)]
    docs = spark.createDataFrame(rows, DDL)
    got = merkle.merkle(docs, fanout).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=text_key) == sorted(plain(docs.collect(), fanout), key=text_key)


def test_records_are_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle.Forest.__init__, "__defaults__", (2, 8, 7))
    docs = spark.createDataFrame([(i, "s", "a" if i % 4 else "b", 1, "t", 0, "") for i in range(90)], DDL)
    records, over = merkle.manifest(docs)
    rows = docs.collect()
    wanted = []
    for lang in "ab":
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["doc_id"])
        wanted += [("1" + lang, k, i, d) for k, level in enumerate(levels([leaf(r, 1) for r in own], 2)) for i, d in enumerate(level)]
    assert sorted(tuple(r) for r in records.collect()) == sorted(wanted)
    assert over.count() == 3


def test_a_long_text_and_a_lone_leaf(spark):
    text = "ü" * 200_000
    got = merkle.merkle(spark.createDataFrame([(5, None, None, 1, text, 0, "")], DDL)).collect()
    assert len(got) == 1 and got[0]["leaf"] == got[0]["subroot"] == got[0]["root"] and got[0]["proof_sha256"] == joined([])
    with pytest.raises(ValueError, match="two children"):
        merkle.merkle(spark.createDataFrame([], DDL), 1)
