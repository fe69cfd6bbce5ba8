"""Toxicity by noisy-channel deobfuscation and a learned lexicon.

A trigram model over letters is counted from all texts. Passages that look disguised
(digits or symbols among letters, letters spaced out or repeated, words broken by marks
or blanks) are restored by a Viterbi search over a lattice: every written character
offers the letters it may stand for, or being dropped, every gap offers to be dropped or
to be a word's border, each at a price, and the letter model weighs the readings. The
restored text is scored by terms (whole words and word beginnings) that labelled
documents show to be far more frequent in toxic ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled documents of either class that the lexicon is learned from, at most.
PER_CLASS = 15_000
THRESHOLD = 0.3

#: Symbols of the letter model: 0 what is not a letter, a to z, the letters à to ÿ, one for all others.
SYMBOLS, OTHER = 64, 63
#: Letters that a character may stand for. Fixed values of a writing habit.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SUBSTITUTED, DROPPED_REPEAT, DROPPED_MARK, DROPPED_SYMBOL, KEPT_MARK = 0.7, 0.6, 0.8, 2.0, 2.5
#: A gap between spaced-out letters: dropped, or a word's border; wider gaps rather are borders.
GAP_DROPPED, GAP_KEPT, WIDE_DROPPED, WIDE_KEPT = 0.0, 1.0, 2.0, 0.0
#: A plain blank inside a word that was broken in two.
JOINED = 3.0

PROBE = re.compile(r"[^\W\d_][0-9@$!|+]+[^\W\d_]|(?<!\S)[0-9@$!|+]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$|+](?!\S)|([^\W\d_])\1\1|[^\W\d_][.\-_*][^\W\d_]", re.I)
SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_]|[@$!|+])(?:[ \t.\-_*]+(?:[^\W_]|[@$!|+])(?![\w@$|+])){2,}")
GAPS = re.compile(r"[ \t.\-_*]+")
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
MARKS = re.compile(r"[^\w@$!|+]{2,}")
#: Gaps in the lattice.
NARROW, WIDE, BLANK = "\x00", "\x01", "\x02"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def bare(raw: str) -> str:
    """The word without the marks around it, in one scan from either end.

    Symbols that may stand for letters stay, but not an exclamation mark at the end, nor
    a symbol written three times or more there.
    """
    a, b = 0, len(raw)
    while a < b and not (raw[a].isalnum() or raw[a] in "_@$!|+"):
        a += 1
    while a < b and not raw[b - 1].isalnum() and raw[b - 1] != "_":
        c, k = raw[b - 1], b - 1
        while k > a and raw[k - 1] == c:
            k -= 1
        if c in "@$|+" and b - k < 3:
            break
        b = k
    return raw[a:b]


def symbol_table() -> np.ndarray:
    """The symbol of each code point below 0x250."""
    out = np.array([OTHER if chr(c).isalpha() else 0 for c in range(0x250)], dtype=np.int64)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    for c in range(0xE0, 0x100):
        if c != 0xF7:
            out[c] = 27 + c - 0xE0
    return out


def symbols(text: str, of: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < len(of), of[np.minimum(points, len(of) - 1)], OTHER)


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, total = symbol_table(), np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for text in batch["text"].to_pylist():
            s = np.concatenate([[0, 0], symbols(text, of), [0]])
            np.add.at(total, (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], 1)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(found, pa.int32()), "n": total[found]})


class LetterModel:
    """-log P(c | a b), smoothed with shorter contexts."""

    def __init__(self, counts: np.ndarray, weight: float = 5.0):
        n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        one = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * SYMBOLS)
        two = (n.sum(0) + weight * one) / (n.sum((0, 2))[:, None] + weight)
        three = (n + weight * two[None]) / (n.sum(2)[:, :, None] + weight)
        self.cost = (-np.log(three)).astype(np.float32)
        self.of = symbol_table()

    def symbol(self, c: str) -> int:
        return int(self.of[ord(c)]) if ord(c) < len(self.of) else OTHER if c.isalpha() else 0


class Restorer:
    """Readings of disguised passages, remembered for the task."""

    def __init__(self, model: LetterModel, memo: int = 200_000):
        self.model, self.memo, self.limit = model, {}, memo

    def remembered(self, raw: str, read: Callable[[str], str]) -> str:
        found = self.memo.get(raw)
        if found is None:
            if len(self.memo) > self.limit:
                self.memo.clear()
            found = self.memo[raw] = read(raw)
        return found

    def word(self, raw: str) -> str:
        """A word's reading; repeats count as three, a run of plain marks as one mark."""
        return self.remembered(raw, lambda x: self.decode(MARKS.sub(".", LONG_RUN.sub(r"\1\1\1", bare(x.lower())))))

    def spaced(self, raw: str) -> str:
        """The reading of a run of single characters with gaps."""
        return self.remembered(raw, lambda x: self.decode(GAPS.sub(lambda m: NARROW if len(m[0]) == 1 else WIDE, x.lower())))

    def joined(self, words: str) -> bool:
        """Whether two plain words (parted by BLANK) read better as one."""
        return bool(self.remembered(words, lambda x: "" if " " in self.decode(x) else "joined"))

    def options(self, raw: str, i: int) -> list[tuple[str, float]]:
        """The readings of the i-th character and their prices."""
        c = raw[i]
        if c.isalpha():
            return [(c, 0.0), ("", DROPPED_REPEAT)] if i and raw[i - 1] == c else [(c, 0.0)]
        if c == NARROW:
            return [("", GAP_DROPPED), (" ", GAP_KEPT)]
        if c == WIDE:
            return [("", WIDE_DROPPED), (" ", WIDE_KEPT)]
        if c == BLANK:
            return [("", JOINED), (" ", 0.0)]
        letters = STANDS_FOR.get(c, "")
        return [*((s, SUBSTITUTED) for s in letters), ("", DROPPED_SYMBOL if letters else DROPPED_MARK), (" ", KEPT_MARK)]

    def decode(self, raw: str) -> str:
        """The cheapest reading; linear in the length, with a bounded set of states."""
        cost, of = self.model.cost, self.model.symbol
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i in range(len(raw)):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for letter, price in self.options(raw, i):
                s = of(letter) if letter else -1
                for (a, b), (spent, path) in states.items():
                    if letter:
                        state, total, way = (b, s), spent + price + float(cost[a, b, s]), (path, letter)
                    else:
                        state, total, way = (a, b), spent + price, path
                    if state not in new or total < new[state][0]:
                        new[state] = (total, way)
            states = new
        end = min(((spent + float(cost[a, b, 0]), path) for (a, b), (spent, path) in states.items()), key=lambda x: x[0])
        letters, path = [], end[1]
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def text(self, text: str) -> str:
        """The whole text with its disguised passages restored."""
        if SPACED.search(text):
            text = SPACED.sub(lambda m: f" {self.spaced(m[0])} ", text)
        if PROBE.search(text):
            text = " ".join([self.word(w) if PROBE.search(w) else w for w in text.split()])
        return text


def plain(text: str) -> str:
    """Lower-cased letters, words parted by single spaces, a space at either end."""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


def terms_of(text: str) -> set[str]:
    """Whole words, and their beginnings of 4 to 6 letters."""
    words = set(plain(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in (4, 5, 6) if len(w) >= k}


def sketch(text: str) -> int:
    """The least hash of the text's three-word runs: near copies mostly share it."""
    words = np.array(text.split() or [""], dtype=object)
    h = pd.util.hash_array(words, categorize=False)
    with np.errstate(over="ignore"):
        runs = h if len(h) < 3 else (h[:-2] * np.uint64(31) + h[1:-1]) * np.uint64(31) + h[2:]
        return int(((runs ^ (runs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min().view(np.int64))


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "label": b["label"], "sketch": pa.array([sketch(t) for t in b["text"].to_pylist()], pa.int64())})


def term_counts(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    restorer, counts = Restorer(LetterModel(model)), (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "clean": pa.array([counts[0][t] for t in terms], pa.int64()), "toxic": pa.array([counts[1][t] for t in terms], pa.int64())})
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            counts[int(label)].update(terms_of(restorer.text(text)))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush()
    yield flush()


class Scorer:
    """Scores of texts under a letter model and a lexicon.

    Words of the lexicon broken by one blank are found as such, and count where the
    lattice of the two pieces reads better as one word. In a run of spaced-out letters
    they count wherever they begin, since its words have no borders of their own.
    """

    def __init__(self, model: np.ndarray, lexicon: dict[str, float], prior: float, unmatched: float):
        self.restorer, self.lexicon, self.prior, self.unmatched = Restorer(LetterModel(model)), lexicon, prior, unmatched
        self.terms, self.inner = ahocorasick.Automaton(), ahocorasick.Automaton()
        for term, weight in lexicon.items():
            word = term.strip()
            if not term.endswith(" ") or len(word) < 4:
                continue
            self.inner.add_word(word, (term, weight))
            for k in range(1, len(word)):
                self.terms.add_word(f" {word[:k]} {word[k:]} ", (term, weight, f"{word[:k]}{BLANK}{word[k:]}"))
        for term, weight in lexicon.items():
            self.terms.add_word(term, (term, weight, None))
        self.terms.make_automaton()
        self.inner.make_automaton()

    def score(self, text: str) -> tuple[float, list[str]]:
        hits: dict[str, float] = {}
        for _, (term, weight, broken) in self.terms.iter(plain(self.restorer.text(text))) if self.lexicon else ():
            if term not in hits and (broken is None or self.restorer.joined(broken)):
                hits[term] = weight
        for run in SPACED.finditer(text) if len(self.inner) else ():
            hits.update(found for _, found in self.inner.iter(self.restorer.spaced(run[0]).replace(" ", "")))
        logit = self.prior + max(hits.values()) + 0.5 * math.log(len(hits)) if hits else self.unmatched
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), sorted(h.strip() for h in hits)


def scored(batches: Iterator[pa.RecordBatch], *model: object) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(*model)
    for batch in batches:
        found = [scorer.score(text) for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array([f[0] for f in found], pa.float64()), "terms": pa.array([f[1] for f in found], pa.list_(pa.string()))})


def passed(batches: Iterator[pa.RecordBatch], column: int, threshold: float, *model: object) -> Iterator[pa.RecordBatch]:
    """The rows, whole, whose text scores below the threshold."""
    scorer = Scorer(*model)
    for batch in batches:
        yield batch.filter(pa.array([scorer.score(text or "")[0] < threshold for text in batch.column(column).to_pylist()], pa.bool_()))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def letter_model(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts; SYMBOLS cubed numbers, whatever the corpus."""
    rows = docs.select(text_of().alias("text")).mapInArrow(trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for gram, n in rows:
        counts[gram] = n
    return counts


def sampled_labels(labels: DataFrame, name: str, usable: Column, per_class: int) -> tuple[DataFrame, list[int]]:
    """(doc_id, label) of at most per_class rows of either class, and how many each class has."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    some = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return some[0].unionByName(some[1]), [sizes.get(k, 0) for k in (0, 1)]


def learn_lexicon(docs: DataFrame, sample: DataFrame, counts: np.ndarray) -> dict[str, float]:
    """Terms with their log odds, from the sampled documents; near copies count once.

    A term counts where its excess in toxic documents could not come from trying as
    many terms as there are: its likelihood ratio must exceed the log of their number,
    which no term of a single document does. All terms that pass are kept; the sample's
    documented size bounds them.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    labelled = texts.join(F.broadcast(sample), "doc_id").mapInArrow(sketched, "doc_id long, label int, sketch long")
    once = labelled.groupBy("sketch", "label").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label")).persist()
    n = {r[0]: r[1] for r in once.groupBy("label").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        once.unpersist()
        return {}
    found = texts.join(F.broadcast(once), "doc_id").mapInArrow(lambda b: term_counts(b, counts), "term string, clean long, toxic long")
    found = found.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= 2)
    found = found.persist()
    tried = max(2, found.count())
    share = toxic / (toxic + clean)
    a, b = F.col("toxic"), F.col("clean")
    q = (a + 0.25) / (a + b + 0.5)
    ratio = a * F.log(q / share) + b * F.log((1 - q) / (1 - share))
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    rows = found.select("term", ratio.alias("ratio"), odds.alias("odds")).filter((F.col("odds") > 1.0) & (F.col("ratio") > math.log(tried) + 1)).collect()
    found.unpersist()
    once.unpersist()
    return {r["term"]: float(r["odds"]) for r in sorted(rows)}


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, terms.

    * Labels (doc_id, toxic) are learned from only where crc32(doc_id) % folds is not
      ``held_out``, from at most ``per_class`` documents of either class; the letter model
      is counted from all texts. Score and terms depend on the text alone.
    * Null texts count as empty; a text without any listed term scores low, below the
      threshold. Without labels of both classes nothing can be told, and all score so.
    * Repeated rows are scored alike; a null doc_id is not held out; an empty table gives
      no rows; other columns play no part.
    """
    sent = learned(docs, labels, folds, held_out, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = rows.mapInArrow(lambda b: scored(b, *sent.value), "doc_id long, score double, terms array<string>")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms")


def clean_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, with all their columns, that ``toxicity`` predicts 0 for."""
    sent, column = learned(docs, labels, folds, held_out, per_class), docs.columns.index("text")
    return docs.mapInArrow(lambda b: passed(b, column, threshold, *sent.value), docs.schema)


def learned(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, per_class: int) -> Broadcast:
    """The letter model's counts, the lexicon, and the logits of the prior and of a text without terms."""
    counts = letter_model(docs)
    sample, sizes = sampled_labels(labels, "toxic", fold(F.col("doc_id"), folds) != held_out, per_class)
    lexicon = learn_lexicon(docs, sample, counts)
    prior = math.log((sizes[1] + 0.5) / (sizes[0] + 0.5)) if sum(sizes) else -2.0
    return docs.sparkSession.sparkContext.broadcast((counts, lexicon, prior, min(prior, -4.0)))
