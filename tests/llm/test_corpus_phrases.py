"""Collocations against plain counting, fingerprints against the similarity that they estimate."""

import hashlib
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest

from codexmill.llm import collocations, weighted_sampling

DDL = "doc_id long, text string, lang string, phrase string, n int, term string, _at int"


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, "x", 1, "y", 2) for i, text, lang in rows], DDL)


def plain(rows, support, top):
    """The contract word by word."""
    counts, out = {}, []
    for _, text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {k: v for k, v in f.items() if len(k) > 1 and v >= support}
        best = []
        for words, a in found.items():
            m = len(words)
            if any(len(o) > m and any(o[i : i + m] == words for i in range(len(o) - m + 1)) and 100 * b >= 100 * a for o, b in found.items()):
                continue
            score, k = min((1000 * a * n // (f[words[:k]] * f[words[k:]]), k) for k in range(1, m))
            best.append((-score, -a, " ".join(words).encode(), f[words[:k]], f[words[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def some_rows(seed):
    rnd = random.Random(seed)
    words = ["the", "The", "old", "red", "fox", "über", "ÜBER", "日本", "a b", "x\x1cy", "1"]
    glue = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "? "]
    texts = ["".join(rnd.choice(words) + rnd.choice(glue) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \t ", "the old red fox jumps " * 40, "the old red fox jumps " * 40, "z " * 9000]
    return [(i, t, rnd.choice([None, "en", "und", "dé"])) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("support", "top"), [(5, 2000), (30, 4)])
def test_collocations_as_plain(spark, support, top):
    rows = some_rows(support)
    got = collocations.collocations(table(spark, rows), support, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in got) == plain(rows, support, top)


def test_small_chunks_buckets_and_marks_change_nothing(spark, monkeypatch):
    """Bitmaps so small that most bits are set by others only let more phrases be counted."""
    rows = some_rows(1)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 50)
    monkeypatch.setattr(collocations, "LEAST_BUCKETS", 1 << 16)
    monkeypatch.setattr(collocations, "MOST_BUCKETS", 1 << 16)
    monkeypatch.setattr(collocations, "MARKS", 1 << 15)
    got = collocations.collocations(table(spark, rows).repartition(3), 8).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 8, 2000)


def test_no_phrases(spark):
    for rows in ([], [(1, None, None), (2, "", "en")], [(1, "one two three", "en")]):
        assert collocations.collocations(table(spark, rows)).count() == 0


def test_products_over_64_bits(spark):
    rows = [(i, "a b " * 50_000, "en") for i in range(60)]
    row = collocations.collocations(table(spark, rows)).filter("phrase = 'a b a b a'").first()
    want = plain(rows, 100, 2000)
    assert (row["a"], row["n"], row["score"]) == next((r[3], r[6], r[7]) for r in want if r[2] == "a b a b a")
    assert 1000 * row["a"] * row["n"] > 2**53


def test_bucket_bits():
    bits = np.packbits(np.arange(64) % 3 == 0, bitorder="little")
    assert collocations.bit(bits, np.arange(128, dtype=np.uint64)).tolist() == [(k % 64) % 3 == 0 for k in range(128)]


def weighted_jaccard(a, b):
    a, b = (Counter(x.lower().split()) for x in (a, b))
    return sum(min(a[w], b[w]) for w in {*a, *b}) / max(1, sum(max(a[w], b[w]) for w in {*a, *b}))


@pytest.fixture(scope="module")
def fingerprinted(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 6)
    texts = [" ".join(word() for _ in range(rnd.randint(1, 200))) for _ in range(150)]
    rows = [(i * 3, t, "en") for i, t in enumerate(texts)] + [(1, "", "en"), (2, None, "en"), (4, texts[0], "en"), (500, "ü" * 30_001 + " end", None), (None, "lost", "en")]
    return rows, weighted_sampling.edited_fingerprints(table(spark, rows)).collect()


def test_edited_texts_and_likeness(fingerprinted):
    rows, got = fingerprinted
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    found, errors = {r["doc_id"]: r for r in got}, []
    assert len(got) == len(rows)
    for k, (doc_id, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        q = len(text) // 4
        edited, row = text[: len(text) - q] + after[:q], found[doc_id]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if text.split() and edited.split() and after.split():
            errors += [row["near_edited"] - weighted_jaccard(text, edited), row["near_next"] - weighted_jaccard(text, after)]
    assert abs(statistics.mean(errors)) < 0.02 and statistics.pstdev(errors) < 0.08


def test_equal_texts_have_equal_fingerprints(spark, fingerprinted):
    rows, got = fingerprinted
    found = {r["doc_id"]: r["fingerprint"] for r in got}
    assert found[0] == found[4] and found[1] == found[2] == "0" * 256 and found[0] != found[3]
    alone = {r["doc_id"]: r["fingerprint"] for r in weighted_sampling.fingerprints(table(spark, rows)).collect()}
    assert alone == found


def test_repeated_rows_follow_each_other(spark):
    got = weighted_sampling.edited_fingerprints(table(spark, [(1, "aaaa bbbb", "x")] * 3 + [(2, "cccc dddd", "y")])).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r["edited_sha256"] for r in got if r["doc_id"] == 1) == sorted([sha("aaaa bbaa"), sha("aaaa bbaa"), sha("aaaa bbcc")])
    one = weighted_sampling.edited_fingerprints(table(spark, [(1, "aaaa bbbb", "x")])).collect()
    assert [r["edited_sha256"] for r in one] == [sha("aaaa bbaa")] and one[0]["near_next"] == 1.0
    assert weighted_sampling.edited_fingerprints(table(spark, [])).count() == 0
