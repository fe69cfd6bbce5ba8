"""Phrase collocations: frequent phrases by hash buckets and Apriori pruning, ranked by how far they exceed chance.

Texts are tokenised once, into chunks of word ids. Then one pass for each length: the
pass of length m counts exactly the m-word phrases whose (m-1)-word parts are both
frequent (Apriori) and whose hash bucket holds enough phrases (PCY); what it finds prunes
the bucket counts of length m + 1 (DHP), made in its second half. Frequent parts and
buckets reach the tasks as bitmaps of bounded size; a bit set by mistake costs a
phrase more to count and changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, on_hot, shuffle_width, text_of

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Words of a chunk, of which a text is never parted.
CHUNK_WORDS = 1_000_000
#: Words for each bucket, and the most buckets (as many bytes are a task's counters, an eighth of it is broadcast).
WORDS_A_BUCKET, MOST_BUCKETS, LEAST_BUCKETS = 8, 2**26, 2**20
#: Buckets that are summed up together.
SLICE = 65_536
#: Bits of the bitmap of frequent parts; a whole number of Spark's bitmaps of 32,768.
MARKS = 2**24
MARKS_A_ROW = 32_768
#: A-Z to small letters, tab to blank, and what parts pieces to a line feed; other bytes stay, so UTF-8 does.
PLAIN = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
GAP, NOTHING = 0, 1
CHUNK = "lang string, words binary, ids binary"


class Ids(dict):
    """Numbers words in the order they are met; 0 parts pieces, 1 is the empty word."""

    def __init__(self) -> None:
        super().__init__({b"\n": GAP, b"": NOTHING})

    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self)
        return made


def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) to chunks: the distinct words by id, and the ids of one lang's texts in order."""
    tables: dict[str, Ids] = {}
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def chunks() -> Iterator[pd.DataFrame]:
        for lang, ids in held.items():
            words = b"\n".join(w for w in list(tables[lang])[2:])
            yield pd.DataFrame({"lang": [lang], "words": [words], "ids": [zlib.compress(np.concatenate(ids).astype("<u4").tobytes(), 1)]})

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if lang not in tables:
                tables[lang], held[lang] = Ids(), []
            tokens = text.encode().translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(tables[lang].__getitem__, tokens), dtype=np.int32, count=len(tokens))
            held[lang].append(np.append(ids[ids != NOTHING], np.int32(GAP)))
            size += len(tokens)
            if size >= CHUNK_WORDS:
                yield from chunks()
                tables, held, size = {}, {}, 0
    yield from chunks()


class Chunk:
    """A chunk with the hash of every phrase of a length, by place."""

    def __init__(self, lang: str, words: bytes, ids: bytes):
        self.words = [b"\n", b"", *(words.split(b"\n") if words else [])]
        self.ids = np.frombuffer(zlib.decompress(ids), dtype="<u4").astype(np.int64)
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.of_word = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], dtype=np.uint64)

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """By place, the hash of the ``length`` words from there on, and whether they lie in one piece."""
        n = max(0, len(self.ids) - length + 1)
        at = self.of_word[self.ids]
        value, whole = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for k in range(length):
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + at[k : k + n]
            whole &= self.ids[k : k + n] != GAP
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return value ^ (value >> np.uint64(32)), whole

    def candidates(self, length: int, marks: np.ndarray | None, buckets: np.ndarray | None) -> np.ndarray:
        """Places of phrases whose parts are marked and whose bucket is."""
        value, whole = self.hashes(length)
        if marks is not None:
            part, _ = self.hashes(length - 1)
            frequent = bit(marks, part)
            whole &= frequent[: len(whole)] & frequent[1 : 1 + len(whole)]
        if buckets is not None:
            whole &= bit(buckets, value)
        return np.flatnonzero(whole)

    def counted(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct phrase and how often it occurs; ids are compared, not hashes."""
        code = np.zeros(len(places), dtype=np.int64)
        for k in range(length):
            code = code * len(self.words) + self.ids[places + k]
            if k + 1 < length:
                code = np.unique(code, return_inverse=True)[1].reshape(-1).astype(np.int64)
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        return places[first], count


def bit(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a value's bit is set; the bitmap's number of bits is a power of two."""
    slot = value & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def chunks_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Chunk]]:
    for batch in batches:
        for lang, words, ids in zip(batch["lang"], batch["words"], batch["ids"], strict=True):
            yield lang, Chunk(lang, words, ids)


def phrase_counts(length: int, marks: object, buckets: object) -> Callable:
    """Candidates of a length by chunk: lang, phrase, n and the place of its bit."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, chunk in chunks_of(batches):
            found = chunk.candidates(length, *(x and x.value for x in (marks, buckets)))
            if not len(found):
                continue
            places, n = chunk.counted(found, length)
            slot = (chunk.hashes(length)[0][places] & np.uint64(MARKS - 1)).astype(np.int64)
            phrases = [b" ".join([chunk.words[i] for i in chunk.ids[p : p + length]]).decode() for p in places]
            yield pd.DataFrame({"lang": [lang] * len(n), "phrase": phrases, "n": n.astype(np.int64), "slot": slot})

    return count


def bucket_counts(length: int, marks: object, size: int, support: int) -> Callable:
    """A task's counts of phrases by bucket, in slices; counts end at ``support``, beyond which they tell nothing."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.uint16)
        for _, chunk in chunks_of(batches):
            value = chunk.hashes(length)[0][chunk.candidates(length, marks.value, None)]
            slot, n = np.unique(value & np.uint64(size - 1), return_counts=True)
            total[slot] = np.minimum(total[slot] + n, support)
        for k in range(size // SLICE):
            own = total[k * SLICE : (k + 1) * SLICE]
            if own.any():
                yield pd.DataFrame({"slice": [k], "counts": [zlib.compress(own.tobytes(), 1)]})

    return count


def bucket_bits(support: int) -> Callable:
    """Sums up slices as they come; those of one number meet in one task."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch["slice"], batch["counts"], strict=True):
                own = total.setdefault(int(k), np.zeros(SLICE, dtype=np.int32))
                np.minimum(own + np.frombuffer(zlib.decompress(counts), dtype=np.uint16), support, out=own)
        for k, own in total.items():
            yield pd.DataFrame({"slice": [k], "bits": [np.packbits(own >= support, bitorder="little").tobytes()]})

    return add


def bitmap(rows: list, bits: int, row_bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, dtype=np.uint8)
    for k, own in rows:
        out[k * row_bits // 8 : (k + 1) * row_bits // 8] = np.frombuffer(own, dtype=np.uint8)
    return out


def marks_of(frequent: DataFrame) -> np.ndarray:
    """The bitmap of the frequent phrases' hashes; its size is fixed."""
    slot = F.col("slot")
    rows = frequent.groupBy((F.floor(slot / MARKS_A_ROW)).cast("int").alias("k")).agg(F.bitmap_construct_agg(slot % MARKS_A_ROW).alias("bits"))
    return bitmap(rows.collect(), MARKS, MARKS_A_ROW)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases with f >= support, single words included, and (lang, n), each lang's words."""
    spark = docs.sparkSession
    if not 1 <= support < 2**16:
        raise ValueError("counts of buckets have 16 bits")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    chunks = cut(texts.mapInPandas(tokenised, CHUNK))
    sent, found, marks, buckets, size, totals = [], [], None, None, 0, None

    def send(bits: np.ndarray) -> object:
        sent.append(spark.sparkContext.broadcast(bits))
        return sent[-1]

    for length in range(1, longest + 1):
        counts = chunks.mapInPandas(phrase_counts(length, marks, buckets), "lang string, phrase string, n long, slot long")
        summed = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("slot").alias("slot"))
        if length == 1:
            summed = cut(summed)
            totals = cut(summed.groupBy("lang").agg(F.sum("f").alias("n")))
            words = totals.agg(F.sum("n")).first()[0] or 0
            size = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (words // WORDS_A_BUCKET).bit_length()))
        frequent = cut(summed.filter(F.col("f") >= support).withColumn("words", F.lit(length)))
        found.append(frequent.select("lang", "phrase", "words", "f"))
        if length == longest or frequent.isEmpty():
            break
        marks = send(marks_of(frequent))
        parts = chunks.mapInPandas(bucket_counts(length + 1, marks, size, support), "slice int, counts binary")
        rows = parts.repartition(min(size // SLICE, shuffle_width(spark)), "slice").mapInPandas(bucket_bits(support), "slice int, bits binary").collect()
        buckets = send(bitmap(rows, size, SLICE))
    for b in sent:
        b.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def contained(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longer: the largest count of a candidate that a phrase lies inside of."""
    words = F.split("phrase", " ")
    pairs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: part(words, s, m))))
    inside = candidates.filter(F.col("words") > 2).select("lang", F.explode(F.array_distinct(pairs)).alias("phrase"), "f")
    return inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    * A null lang is ``und``; null and empty texts have no words, so an empty table or
      one without frequent phrases gives no rows. Repeated rows count again.
    * Phrases don't go over . , ; : ! ? or line breaks; blanks and tabs part words;
      A-Z count as a-z.
    * Ties go to the larger count, then to the phrase by bytes. Further columns of the
      input play no part.
    """
    counts, totals = frequent_phrases(docs, support, longest)
    candidates = counts.filter(F.col("words") > 1)
    longer = contained(candidates).withColumnsRenamed({"lang": "_lang", "phrase": "_phrase"})
    kept = candidates.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("f")))

    words = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), words.alias("_words"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cut(cuts.select("lang", "phrase", "a", "k", F.struct("lang", part(F.col("_words"), F.lit(1), F.col("k")).alias("phrase")).alias("left"), F.struct("lang", part(F.col("_words"), F.col("k") + 1, F.size("_words") - F.col("k")).alias("phrase")).alias("right")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    for side, name in (("left", "l"), ("right", "r")):
        summary = counts.select(F.struct("lang", "phrase").alias(f"_{side}"), F.col("f").alias(name))
        sides = on_hot(sides, side, summary, f"_{side}", name, total).drop(f"_{side}")
    rows = on_hot(sides, "lang", totals.withColumnRenamed("lang", "_of"), "_of", "n", total)
    scored = rows.withColumn("score", F.expr("cast((cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
