"""Keyword search: postings and BM25 over any number of queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.text import index_terms, query_terms

from .lineage import cut

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Documents of a segment, queries of a batch that meets it, and terms asked for that are sent to all tasks, at most.
SEGMENT, BATCH, MOST_TERMS = 4096, 512, 1 << 17


def packed_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, words) with each word once and its count."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(batch["words"]), 0), dtype=np.int64)
        coded = batch["words"].flatten().dictionary_encode()
        rows = np.repeat(np.arange(len(lengths)), lengths)
        key, tf = np.unique(rows * (1 << 32) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(key >> 32, minlength=len(lengths))))).astype(np.int32))
        terms, counts = coded.dictionary.take(pa.array(key & 0xFFFFFFFF)).cast(pa.string()), pa.array(tf.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, counts)], ["id", "length", "terms", "tf"])


def postings(docs: DataFrame) -> DataFrame:
    """(id, length, terms, tf) of docs (id, text): the keyword index as a table of one row for each document, its distinct terms and their counts side by side."""
    words = docs.select("id", index_terms(F.col("text")).alias("words"))
    return words.mapInArrow(packed_terms, f"id {docs.schema['id'].dataType.simpleString()}, length int, terms array<string>, tf array<int>")


def term_table(queries: DataFrame) -> DataFrame:
    """(query_id, term, words, weight) from queries (query_id, text); a repeated term weighs its count.

    Operators are blanked and the rest is split at white space. A piece of several words,
    as ``left-hand``, is a phrase: its words must follow each other. Pieces without a word
    ask for nothing.
    """
    pieces = queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("_p")).select("query_id", index_terms(F.col("_p")).alias("words")).filter(F.size("words") > 0)
    return pieces.groupBy("query_id", F.array_join("words", " ").alias("term"), "words").agg(F.count(F.lit(1)).alias("weight"))


def phrase_counts(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, length, term, tf) of the phrases of a term table in documents (id, _t: their words in order)."""
    phrases = asked.filter(F.size("words") > 1).select("term", "words").distinct()
    parts = phrases.select(F.col("term").alias("_phrase"), F.size("words").alias("_size"), F.posexplode("words").alias("_at", "_q"))
    words = terms.select("id", F.size("_t").alias("length"), F.posexplode("_t").alias("_pos", "_word"))
    begun = words.join(parts, F.col("_word") == F.col("_q")).groupBy("id", "length", "_phrase", "_size", (F.col("_pos") - F.col("_at")).alias("_start")).agg(F.count(F.lit(1)).alias("_met"))
    return begun.filter(F.col("_met") == F.col("_size")).groupBy("id", "length", F.col("_phrase").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of every document that holds a term or phrase of the query.

    The corpus is docs (id, text) as given, whatever the documents' state. Only terms
    that some query asks for are counted; lengths and the number of documents come from
    the same pass. Scores are rounded to 9 places, so that sums in another order
    agree and terms of the least weight still tell documents apart.
    """
    asked = term_table(queries)
    terms = docs.select("id", index_terms(F.col("text")).alias("_t"))
    stats = terms.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("mean"))
    wanted = asked.filter(F.size("words") == 1).select(F.col("term").alias("_q")).distinct()
    hits = terms.select("id", F.size("_t").alias("length"), F.explode("_t").alias("term")).join(wanted, F.col("term") == F.col("_q"), "left_semi")
    tf = hits.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf")).unionByName(phrase_counts(terms, asked))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.crossJoin(F.broadcast(stats))  # one row of totals
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weights = weights.select("term", idf.alias("idf"), "mean").join(asked.drop("words"), "term")
    part = F.col("weight") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return tf.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))


class Vocabulary:
    """The terms asked for, by number: their words, and which words make which term."""

    def __init__(self, terms: list[list[str]]):
        self.words = sorted({w for t in terms for w in t})
        at = {w: i for i, w in enumerate(self.words)}
        self.single = np.full(len(self.words) + 1, -1, dtype=np.int64)  # the last place is that of all other words
        self.phrases = []
        for i, t in enumerate(terms):
            if len(t) == 1:
                self.single[at[t[0]]] = i
            else:
                self.phrases.append((i, [at[w] for w in t]))

    def found(self, texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lengths of the texts, rows, terms, tf) of all terms that the texts (their words in order) hold."""
        lengths = np.asarray(pc.fill_null(pc.list_value_length(texts), 0), dtype=np.int64)
        words = pc.fill_null(pc.index_in(texts.flatten(), value_set=pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        term = self.single[words]
        keys = [(rows * (1 << 32) + term)[term >= 0]]
        if self.phrases:
            order = np.argsort(words, kind="stable")
            edges = np.searchsorted(words[order], np.arange(len(self.words) + 1))
            for i, parts in self.phrases:
                at = order[edges[parts[0]] : edges[parts[0] + 1]]
                at = at[at + len(parts) <= len(words)]
                at = at[rows[at + len(parts) - 1] == rows[at]]
                for step, w in enumerate(parts[1:], 1):
                    at = at[words[at + step] == w]
                keys.append(rows[at] * (1 << 32) + i)
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        return lengths, key >> 32, key & 0xFFFFFFFF, tf


SEGMENTS = "n long, total long, terms array<int>, df array<int>, ids array<string>, lengths array<int>, held array<int>, sizes array<int>, docs array<int>, tf array<int>"


def segments(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, live, words) as segments: their number and length in all, the documents of each term, and the postings of live ones by term, ids in order."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            lengths, rows, terms, tf = vocabulary.found(part["words"])
            all_terms, df = np.unique(terms, return_counts=True)
            kept = np.asarray(part["live"].to_numpy(zero_copy_only=False), dtype=bool)[rows]
            rows, terms, tf = rows[kept], terms[kept], tf[kept]
            own = np.unique(rows)
            ids = np.array(part["id"].take(pa.array(own)).to_pylist(), dtype=object)
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(own), dtype=np.int64)
            place[by_id] = np.arange(len(own))
            order = np.argsort(terms, kind="stable")
            held, sizes = np.unique(terms, return_counts=True)
            columns = {"terms": all_terms, "df": df, "lengths": lengths[own[by_id]], "held": held, "sizes": sizes, "docs": place[np.searchsorted(own, rows)][order], "tf": tf[order]}
            lists = {k: pa.array([v.astype(np.int32)], pa.list_(pa.int32())) for k, v in columns.items()}
            lists |= {"n": pa.array([len(lengths)], pa.int64()), "total": pa.array([int(lengths.sum())], pa.int64()), "ids": pa.array([ids[by_id].tolist()], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict({name.split()[0]: lists[name.split()[0]] for name in SEGMENTS.split(", ")})


def best_of_segments(batches: Iterator[pa.RecordBatch], limit: int, mean: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """The best rows of each query of a batch in each segment it meets; scores are rounded before they are compared, ties to the smaller id."""
    for batch in batches:
        for i in range(batch.num_rows):
            of = lambda name: batch[name][i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            ids, held, docs, tf = batch["ids"][i].values, of("held"), of("docs"), of("tf").astype(float)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * of("lengths")[docs] / mean))
            ends, q_ends = np.cumsum(of("sizes")), np.cumsum(of("q_sizes"))
            starts = ends - of("sizes")
            q_terms, q_weights, sums = of("q_terms"), of("q_weights"), np.zeros(len(ids))
            at = np.searchsorted(held, q_terms)
            there = at < len(held)
            there[there] = held[at[there]] == q_terms[there]
            queries, places, scores = [], [], []
            for j, (a, z) in enumerate(zip(np.concatenate(([0], q_ends[:-1])), q_ends, strict=True)):
                for x in np.flatnonzero(there[a:z]) + a:
                    own = slice(starts[at[x]], ends[at[x]])
                    sums[docs[own]] += q_weights[x] * part[own]
                found = np.flatnonzero(sums)
                score = np.round(sums[found], 9)
                sums[found] = 0
                if len(found) > limit:
                    reach = score >= np.partition(score, len(score) - limit)[len(score) - limit]
                    found, score = found[reach], score[reach]
                    first = np.lexsort((found, -score))[:limit]
                    found, score = found[first], score[first]
                queries.append(np.full(len(found), j))
                places.append(found)
                scores.append(score)
            queries, places = (pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x])) for x in (queries, places))
            yield pa.RecordBatch.from_pydict({"query_id": batch["q_ids"][i].values.take(queries), "id": ids.take(places), "score": pa.array(np.concatenate([np.zeros(0), *scores]))})


def ranked(docs: DataFrame, queries: DataFrame, limit: int, k1: float = K1, b: float = B, segment: int = SEGMENT, batch: int = BATCH, most: int = MOST_TERMS) -> DataFrame:
    """(query_id, rank, id, score): the ``limit`` best live rows of docs (id, text and, unless all are live, live) by ``bm25`` over all of them; ids as text.

    Texts are read once. What the queries ask for of them is packed into segments, each of
    which meets the queries in batches, a bounded piece of work that only the best rows
    leave: scores of all documents are nowhere a table. Terms asked for and their numbers
    of documents are sent to all tasks, ``most`` at most; with more of them all scores
    are made by joins, and the best taken of these.
    """
    live = F.coalesce("live", F.lit(False)) if "live" in docs.columns else F.lit(True)
    docs = docs.select(F.col("id").cast("string").alias("id"), live.alias("live"), "text")
    asked = cut(term_table(queries).withColumn("query_id", F.col("query_id").cast("string")))
    terms = [r["words"] for r in asked.select("term", "words").distinct().orderBy("term").limit(most + 1).collect()]
    if len(terms) > most:
        own = docs.filter("live").select("id")
        return best(bm25(docs, queries, k1, b).join(own, "id", "left_semi"), limit).select("query_id", "rank", "id", "score")
    vocabulary = Vocabulary(terms)
    cells = cut(docs.select("id", "live", index_terms(F.col("text")).alias("words")).mapInArrow(lambda it: segments(it, vocabulary, segment), SEGMENTS))
    n, total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    counts = cells.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()
    df = np.zeros(len(terms))
    df[[r["terms"] for r in counts]] = [r["df"] for r in counts]
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
    numbers = {" ".join(t): i for i, t in enumerate(terms)}

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("query_id", "ascending"), ("term", "ascending")])
        ids, sizes = np.unique(np.array(t["query_id"].to_pylist(), dtype=object), return_counts=True)
        at = np.array([numbers[x] for x in t["term"].to_pylist()])
        lists = {"q_ids": pa.array([ids.tolist()], pa.list_(pa.string())), "q_sizes": pa.array([sizes.astype(np.int32)], pa.list_(pa.int32()))}
        return pa.table(lists | {"q_terms": pa.array([at.astype(np.int32)], pa.list_(pa.int32())), "q_weights": pa.array([t["weight"].to_numpy() * idf[at]], pa.list_(pa.float64()))})

    parts = max(1, math.ceil(asked.select("query_id").distinct().count() / batch))
    sent = asked.select("query_id", "term", "weight").groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts))).applyInArrow(packed, "q_ids array<string>, q_sizes array<int>, q_terms array<int>, q_weights array<double>")
    met = cells.select("ids", "lengths", "held", "sizes", "docs", "tf").filter(F.size("ids") > 0).crossJoin(sent)
    mean = total / n if total else 1.0
    hits = met.mapInArrow(lambda it: best_of_segments(it, limit, mean, k1, b), "query_id string, id string, score double")
    return best(hits, limit).select("query_id", "rank", "id", "score")


def best(scores: DataFrame, k: int, order: list | None = None, by: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank from 1; ties to the smaller id."""
    w = Window.partitionBy(by).orderBy(*(order or [F.col("score").desc(), F.col("id")]))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword_search(docs: DataFrame, active_ids: DataFrame | None, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, id, score): BM25 over all of docs, active ones only, then the limit.

    Without active_ids the column live of docs tells which are active.
    """
    if active_ids is not None:
        own = active_ids.toDF("_own").distinct()
        docs = docs.select("id", "text").join(own, F.col("id") == F.col("_own"), "left").select("id", "text", F.col("_own").isNotNull().alias("live"))
    return ranked(docs, queries, limit)
