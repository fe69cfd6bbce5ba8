"""Personal data against the patterns; toxicity and quality on rows held out from learning."""

import hashlib
import itertools
import math
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.llm import pii, quality, toxicity

DATA = "/root/testdata/sf0.01"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), rank, m.end(), kind) for rank, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if passes(kind, m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


TRICKY = [
    "a.b@c.de, x@y.z.w. and @no q@r", "a@b@c.de.fg a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 9999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111114111111111111111", "+1 (555) 010-9999 +49 30 1234 +1234567890123456 ++12345678901", "😀 mail é@x.de ü.a@b.co 12.3", "4111 1111 1111 1111@x.com +4111 1111 1111 111", "", None, "1" * 5000 + "@a.b", "a@b." + "c" * 3000, "+" * 40 + "1 2345678901", "1.1.1.1@2.2.2.2", "x" * 200 + " 10.0.0.1 ",
]


def test_base_spans_are_those_of_the_patterns(spark):
    docs = spark.createDataFrame([(i, t, "s", "b", 3) for i, t in enumerate(TRICKY)], "doc_id long, text string, spans string, base string, tag int")
    for r in pii.digests(docs).collect():
        want = base(TRICKY[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), TRICKY[r["doc_id"]]
        assert set(want.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in BASE] == [want.count(k + ":") for k in BASE]
    assert pii.digests(docs.limit(0)).count() == 0


def test_terms_that_give_a_value_away(spark):
    rows = [(i, f"Ask Quorbix at q@corp.io about item {i}") for i in range(3)] + [(10 + i, f"Ask anyone about item {i} and at noon") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(docs).collect()}
    assert "term:4:11" in got[0].split(",") and "term:" not in got[10]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Quorbix" not in clean[0] and "q@corp.io" not in clean[0] and clean[10] == rows[3][1]


def test_terms_disclose_at_any_distance(spark):
    """Against all pairs of a value and a word of its document, counted by hand."""
    fill = " ".join(f"word{i % 40}" for i in range(400))
    rows = [(i, f"Quorbix {fill} q@corp.io {fill} code 77120045 {fill} Quorbix") for i in range(2)] + [(2, f"q@corp.io {fill} quorbix")]
    rows += [(10 + i, f"{fill} code {fill}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    values = {i: set(re.findall(BASE["email"].replace("(", "(?:"), t)) for i, t in rows}
    words = {i: set(re.findall(r"[^\W_]{3,}", re.sub(r"\S+@\S+", " ", t.lower()))) for i, t in rows}
    n, want = len(rows), set()
    for v in set().union(*values.values()):
        for w in set().union(*words.values()):
            n_v, n_w, both = (sum(x) for x in zip(*[(v in values[i], w in words[i], v in values[i] and w in words[i]) for i in values]))
            if both >= 2 and np.log(n * both / (n_v * n_w)) / np.log(n / n_v) >= pii.GENERALISE:
                want |= {(v, w)}
    assert {w for _, w in want} == {"quorbix", "77120045"}
    for r in pii.digests(docs).collect():
        text = dict(rows)[r["doc_id"]]
        told = {w for v, w in want if v in values[r["doc_id"]]}
        places = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in told}
        assert {s for s in r["spans"].split(",") if s.startswith("term:")} == places


def test_many_matches_and_overlaps(spark):
    """Thousands of spans in one text in well under quadratic time, and a text rebuilt around overlapping spans."""
    many = " ".join(f"é u{i}@x{i}.org 10.0.{i % 300}.{i % 250} wort{i % 50}" for i in range(4_000))
    rows = [(1, many), (2, many + " tail"), (3, "1.1.1.1@2.2.2.2 then +4111 1111 1111 1111 end 😀"), (4, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digests(docs).collect()}
    assert time.time() - began < 60
    for i, t in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(base(t).encode()).hexdigest()
    done = {r["doc_id"]: (r["text"], r["spans"]) for r in pii.sanitise(docs.filter("doc_id > 2")).collect()}
    assert done[4][0] == "nothing"
    text, at, out = rows[2][1], 0, ""
    for s in sorted(done[3][1], key=lambda s: (s["start"], s["rank"])):
        out += text[at : max(at, s["start"])] + (f"[{s['kind'].upper()}]" if s["start"] >= at else "")
        at = max(at, s["end"])
    assert done[3][0] == out + text[at:]


def auc(rows):
    ranked = sorted(rows)
    up = sum(label for _, label in ranked)
    ranks = sum(i + 1 for i, (_, label) in enumerate(ranked) if label)
    return (ranks - up * (up + 1) / 2) / (up * (len(rows) - up))


def held_out(spark, scored, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select(F.col("doc_id").alias("_d"), F.col(label).alias("label"))
    return [(r["score"], r["label"]) for r in scored.filter("held_out").join(labels, F.col("doc_id") == F.col("_d")).filter("label is not null").collect()]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_rows_are_told_apart(spark, name):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = (toxicity.toxicity if name == "toxic" else quality.quality)(docs, labels)
    rows = held_out(spark, scored, name)
    assert len(rows) > 50 and auc(rows) > 0.85, auc(rows)


ODD = [(1, None), (1, None), (2, ""), (None, "words of no one"), (3, "w " * 60_000), (4, "5 " + "@" * 50)]


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_odd_rows_and_no_labels(spark, name):
    f = toxicity.toxicity if name == "toxic" else quality.quality
    docs = spark.createDataFrame([(*r, "z", 1, "t") for r in ODD], "doc_id long, text string, score string, label int, held_out string")
    labels = spark.createDataFrame([(1, 1, 1, "x"), (None, 0, 0, "y"), (9, None, None, "z")], "doc_id long, toxic int, quality int, text string")
    for some in (labels, labels.limit(0)):
        got = f(docs, some).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1  # null and empty alike
    assert f(docs.limit(0), labels).count() == 0


def test_disguised_words_are_restored(spark):
    texts = spark.createDataFrame([("the moron spoke to the other morons about idiots and stupid things " * 20,)], "text string")
    restorer = toxicity.Restorer(toxicity.LetterModel(toxicity.letter_model(texts)))
    assert toxicity.plain(restorer.text("a m0r0n and an 1d1ot")).split() == ["a", "moron", "and", "an", "idiot"]
    assert "stupid" in restorer.text("so s t u p i d indeed") and "stupid" in restorer.text("stuuuupid")
    assert "stupid" in restorer.text("an s.t.u.p.i.d one") and "stupid" in restorer.text("a stu.pid one")


LEXICON = {" stupid ": 5.0, " idiot ": 5.0, " moro": 5.0}


@pytest.fixture(scope="module")
def scorer(spark):
    texts = spark.createDataFrame([("you are the moron who spoke to other morons about idiots, a stupid idiot said, and stupid things they did " * 20,)], "text string")
    return toxicity.Scorer(toxicity.letter_model(texts), LEXICON, -2.0, -4.0)


@pytest.mark.parametrize("text", ["a s t u p i d fool", "y o u i d i o t", "y o u   i d i o t", "an id iot", "he is stu.pid", "i s.t.u.p.i.d.", "what an 1d1ot!!", "m0r0ns", "stuuupid", "a st upid thing"])
def test_spacing_is_part_of_the_lattice(scorer, text):
    assert scorer.score(text)[1], text


@pytest.mark.parametrize("text", ["", "the other things they spoke about", "did i o t", "a b c d e", "the pidgin of stu", "----", "a-b"])
def test_clean_spellings_are_left_alone(scorer, text):
    assert not scorer.score(text)[1], text


@pytest.mark.parametrize("raw", ["1d1ot", "st-upid", "m0r0n", "stuup1d", "i\x00d\x00i\x00o\x00t", "y\x01ou", "id\x02iot", "@b", "a"])
def test_decoding_is_the_best_of_all_readings(scorer, raw):
    """The Viterbi search against every path through the lattice."""
    model, restorer = scorer.restorer.model, scorer.restorer

    def price(path):
        a = b = 0
        total = 0.0
        for letter, spent in path:
            total += spent
            if letter:
                s = model.symbol(letter)
                total += float(model.cost[a, b, s])
                a, b = b, s
        return total + float(model.cost[a, b, 0])

    best = min(map(price, itertools.product(*[restorer.options(raw, i) for i in range(len(raw))])))
    found = restorer.decode(raw)
    readings = [p for p in itertools.product(*[restorer.options(raw, i) for i in range(len(raw))]) if "".join(x for x, _ in p) == found]
    assert math.isclose(min(map(price, readings)), best, rel_tol=1e-5)


@pytest.mark.parametrize("word", ["a1b" + "-" * 100_000 + "c", "a1b" + ".," * 50_000 + "c", "a1" + "xyzw" * 25_000, "|" * 30 + "---" * 30_000 + "a" * 10, "a1b" + "!?" * 50_000, "a " * 50_000, "$" * 100_000])
def test_long_odd_words_take_linear_time(scorer, word):
    began = time.time()
    scorer.score(word)
    assert time.time() - began < 3


def test_bare_words():
    assert [toxicity.bare(w) for w in ("(word)", "w!!", "a$$$", "a$$", "---", "", "_a_", "!x!", "x...$$$..")] == ["word", "w", "a", "a$$", "", "", "_a_", "!x", "x"]


def test_every_known_word_has_its_own_vector(spark):
    """Counts, context sums and pooled features against a plain restatement."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(5)
    hashed = {w: int(quality.words_of([w])[0][0]) for t in texts for w in t.split()}
    assert len(set(hashed.values())) == len(hashed)
    counts = {w: sum(t.split().count(w) for t in texts) for w in hashed}
    total = sum(counts.values())
    known = quality.known_words(docs, share=20 / total)
    assert set(map(int, known)) == {h for w, h in hashed.items() if counts[w] >= 20}
    sums = {w: np.zeros(quality.DIMS) for w in hashed}
    for t in texts:
        ws = t.split()
        for i, w in enumerate(ws):
            for j in range(max(0, i - quality.WINDOW), min(len(ws), i + quality.WINDOW + 1)):
                if i != j:
                    at, sign = quality.index_vectors(np.array([hashed[ws[j]]], dtype=np.uint64))
                    np.add.at(sums[w], at[0], sign[0])
    vectors = quality.word_vectors(docs, known)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    for w, h in hashed.items():
        if counts[w] >= 20:
            assert vectors[np.searchsorted(known, np.uint64(h))] == pytest.approx(unit(np.sign(sums[w]) * np.log1p(np.abs(sums[w]))), abs=2e-3)
    some = texts[:5]
    for t, x in zip(some, quality.pooled(some, known, vectors), strict=True):
        own = [vectors[np.searchsorted(known, np.uint64(hashed[w]))].astype(float) for w in t.split() if counts[w] >= 20]
        if own:
            assert x[: quality.DIMS] == pytest.approx(np.mean(own, axis=0), abs=1e-3) and x[-1] == pytest.approx(1 - len(own) / len(t.split()), abs=1e-5)


def test_temperature_calibrates():
    """Stretched logits are brought back: the log loss on rows not fitted is least at the temperature found."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = quality.Network(x, y, epochs=20)
    loss = lambda t: np.logaddexp(0, -(2 * y - 1) * net.logits(x) / t).mean()
    assert loss(net.temperature) <= min(loss(net.temperature * f) for f in (0.6, 1.7)) and abs(net.score(x).mean() - y.mean()) < 0.05
