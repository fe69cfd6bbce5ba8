"""Similarity join of documents on the Jaccard measure of their word n-grams.

MinHash banding: bands and rows follow from the target recall at the threshold. Each
document is reduced to one hash per band; documents that share a band hash with the
smallest document of that bucket are tied to it (a star, not all pairs), and the
connected parts of these ties are the candidate families. A family is verified on the
full n-gram sets, which meet once, with the set of the family's representative (the text
with the most bucket mates). From then on a text is its difference D to that set, which
tells as much: the sets A and B differ in |D_A ^ D_B| grams. Two texts whose differences
are both small enough, |D| <= |A| (1 - t) / (1 + t), are linked for certain, so these
near ones are only counted. The far ones meet each other and the near ones in blocks of
differences, each a bounded piece of work, and only sums and spanning ties leave it.
Equal texts are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, on_hot, take, text_hash, text_of
from .components import components, forest

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 96
#: Documents and grams of a block of a family, about; two blocks meet in one task.
FAMILY_BLOCK, BLOCK_GRAMS = 256, 1_000_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band that reach the recall at the threshold with at most ``most`` hashes.

    Thresholds so low that ``most`` hashes don't reach the recall get bands of one row.
    """
    fits = [(math.ceil(math.log(1 - recall) / math.log1p(-threshold)) if threshold < recall else 1, 1)]
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            fits.append((bands, rows))
    return fits[-1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts that spread every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``words`` lower-cased words; a shorter text is one run."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(split, dtype=object), categorize=False)
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One long per band: a hash of ``rows`` minima and the band's number."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.full(bands * rows, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for part in np.array_split(grams, max(1, len(grams) // 8192)):
            hashed = (part[None, :] * (seeds | np.uint64(1))[:, None]) ^ (seeds >> np.uint64(7))[:, None]
            hashed ^= hashed >> np.uint64(32)
            least = np.minimum(least, (hashed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
        out = np.arange(bands, dtype=np.uint64)
        for column in least.reshape(bands, rows).T:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def signatures(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch["_text"]:
            grams = shingles(text.as_py(), words)
            out.append(band_hashes(grams, bands, rows) if len(grams) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_key"], batch["text_hash"], pa.array(out, pa.list_(pa.int64()))], ["doc_id", "_key", "text_hash", "_bands"])


def sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [shingles(t.as_py(), words).tobytes() for t in batch["_text"]]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("_key", "_family", "_chief")), pa.array(grams, pa.binary())], ["_key", "_family", "_chief", "_grams"])


def differences(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Each text as the size of its set, its difference to the representative's, and whether it is near."""
    for batch in batches:
        sizes, out = [], []
        for grams, base in zip(batch["_grams"], batch["_base"], strict=True):
            own = np.frombuffer(grams.as_py(), dtype=np.uint64)
            sizes.append(len(own))
            out.append(np.setxor1d(own, np.frombuffer(base.as_py(), dtype=np.uint64), assume_unique=True))
        near = [(1 + threshold) * len(d) <= (1 - threshold) * n for n, d in zip(sizes, out, strict=True)]
        yield pa.RecordBatch.from_pydict({"_key": batch["_key"], "_family": batch["_family"], "_size": pa.array(sizes, pa.int64()), "_n_diff": pa.array([len(d) for d in out], pa.int64()), "_near": pa.array(near, pa.bool_()), "_diff": pa.array([d.tobytes() for d in out], pa.binary())})


def similar_pairs(sizes: np.ndarray, parts: list[np.ndarray], n: int, threshold: float) -> np.ndarray:
    """Matrix of the pairs (one of the first n texts, any text) with a Jaccard measure of the threshold or more.

    ``sizes`` are those of the full sets, ``parts`` the differences to one common set.
    """
    m, counts = len(parts), np.array([len(p) for p in parts])
    at = np.repeat(np.arange(m), counts)
    _, column, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    at, column = at[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    common = np.zeros((n, m), dtype=np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + width, width))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            dense = np.zeros((m, width), dtype=np.float32)
            dense[at[a:b], column[a:b] % width] = 1
            common += dense[:n] @ dense.T
    apart = counts[:n, None] + counts[None, :] - 2 * common.astype(np.float64)
    both = (sizes[:n, None] + sizes[None, :]).astype(np.float64)
    return (1 + threshold) * apart <= (1 - threshold) * both + 1e-6


def verify(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """Links between a block of far texts and another block, and a spanning tie for each text that has one."""
    table = table.sort_by("_key")
    i, j = key[1], key[2]
    block = table["_block"].to_numpy()
    order = np.argsort(block != i, kind="stable")
    keys = np.array(table["_key"].to_pylist(), dtype=object)[order]
    parts = [np.frombuffer(x, dtype=np.uint64) for x in table["_diff"].to_pylist()]
    n = int((block == i).sum())
    close = similar_pairs(table["_size"].to_numpy()[order], [parts[x] for x in order], n, threshold)
    if i == j:
        np.fill_diagonal(close, False)
    else:
        close[:, :n] = False
    a, b = np.nonzero(close)
    links = np.bincount(a, minlength=len(keys)) + (np.bincount(b, minlength=len(keys)) if i != j else 0)
    root, some = forest(len(keys), a, b), links > 0
    return pa.table({"u": pa.array(keys[some], pa.string()), "v": pa.array(keys[root[some]], pa.string()), "n": pa.array(links[some], pa.int64())})


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = FAMILY_BLOCK) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, class_size, copies, kept, text_hash.

    * Documents are linked when the Jaccard measure of their sets of ``words``-word runs
      is at least ``threshold``. Words are lower-cased and split at white space; a text of
      fewer words is one run, a null or empty text has none and links to nothing.
    * Equal texts (null as empty) are one class without links among them: copies counts
      the rows of the text, n_links the different texts that it is linked with.
    * class_id is the smallest doc_id of all texts connected by links, class_size the
      rows of the class; kept marks one row of each class, that of class_id.
    * A null doc_id keeps its row out of class_id unless the class has no other; where a
      doc_id repeats within a class, one row only is kept.
    * An empty table gives no rows; other columns play no part.
    """
    bands, rows = banding(threshold, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_of()).alias("_key"), text_of().alias("_text"), text_hash().alias("text_hash"))
    base = source.mapInArrow(lambda b: signatures(b, words, bands, rows), "doc_id long, _key string, text_hash long, _bands array<long>")
    base = cut(base.withColumn("_tag", F.monotonically_increasing_id()))
    # the row that would stay: the first with the smallest doc_id, or, without doc_ids, the first
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_tag").alias("tag"))
    texts = base.groupBy("_key").agg(F.min(first).alias("_first"), F.any_value("_bands").alias("_bands"), F.count(F.lit(1)).alias("copies"))

    total = base.count()
    near = verified_links(source, texts, cut(families(texts, bands * total)), words, threshold, block)
    linked = near.join(texts.select(F.col("_key").alias("_k"), "_first", "copies"), F.col("_key") == F.col("_k"))
    per_class = linked.groupBy("_root").agg(F.min("_first").alias("_best"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("_n")).withColumnRenamed("_root", "_r")
    linked = on_hot(linked, "_root", per_class, "_r", "_n", total).select("_k", "_best", "class_size", "n_links")
    told = texts.join(linked, F.col("_key") == F.col("_k"), "left").select(
        F.col("_key").alias("_own"), F.coalesce("_best", "_first").alias("_best"), F.coalesce("class_size", "copies").alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies"
    )
    return on_hot(base.drop("_bands"), "_key", told, "_own", "copies", total).select("doc_id", F.col("_best.id").alias("class_id"), "n_links", "class_size", "copies", (F.col("_tag") == F.col("_best.tag")).alias("kept"), "text_hash")


def families(texts: DataFrame, total: int) -> DataFrame:
    """_key, _family, _mates of every text that shares a bucket: its bucket mates, summed over bands; total: band hashes, about."""
    hashes = texts.select("_key", F.explode("_bands").alias("_hash"))
    least = hashes.groupBy("_hash").agg(F.min("_key").alias("v"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(F.col("_hash").alias("_h"), "v", "_n")
    met = on_hot(hashes, "_hash", least, "_h", "_n", total)
    ties = cut(met.groupBy(F.col("_key").alias("u"), "v").agg(F.sum("_n").alias("_n")))
    mates = ties.groupBy(F.col("u").alias("_key")).agg(F.sum("_n").alias("_mates"))
    return mates.join(components(ties.select("u", "v")), F.col("_key") == F.col("node")).select("_key", F.col("root").alias("_family"), "_mates")


def verified_links(source: DataFrame, texts: DataFrame, members: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """_key, _root, n_links of every text that has a link."""
    chiefs = members.groupBy(F.col("_family").alias("_f")).agg(F.max_by("_key", F.struct("_mates", "_key")).alias("_chief"), F.count(F.lit(1)).alias("_n"))
    total = members.count()
    placed = on_hot(members, "_family", chiefs, "_f", "_n", total).select("_key", "_family", (F.col("_key") == F.col("_chief")).alias("_chief"))
    placed = placed.withColumnRenamed("_key", "_k").join(texts.select("_key", F.col("_first.id").alias("_rep")), F.col("_k") == F.col("_key")).select("_k", "_rep", "_family", "_chief")
    own = source.join(placed, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("_key") == F.col("_k"))).select("_key", "_family", "_chief", "_text").dropDuplicates(["_key"])
    grams = cut(own.mapInArrow(lambda b: sets(b, words), "_key string, _family string, _chief boolean, _grams binary"))
    bases = grams.filter("_chief").select(F.col("_family").alias("_f"), F.col("_grams").alias("_base"))
    met = grams.join(bases, F.col("_family") == F.col("_f")).select("_key", "_family", "_grams", "_base")
    apart = cut(met.mapInArrow(lambda b: differences(b, threshold), "_key string, _family string, _size long, _n_diff long, _near boolean, _diff binary"))

    # near texts of a family are all linked with each other; far ones meet every text of it in blocks
    count = lambda near, what: F.coalesce(F.sum(F.when(F.col("_near") == near, what)), F.lit(0))
    blocks = lambda near: F.greatest(F.ceil(count(near, F.lit(1)) / block), F.ceil(count(near, F.col("_n_diff")) / BLOCK_GRAMS)).cast("int")
    sizes = apart.groupBy(F.col("_family").alias("_f")).agg(F.count(F.lit(1)).alias("_n"), count(True, F.lit(1)).alias("_n_near"), blocks(True).alias("_near_blocks"), blocks(False).alias("_far_blocks"), F.min(F.when(F.col("_near"), F.col("_key"))).alias("_first_near"))
    told = on_hot(apart, "_family", sizes, "_f", "_n", total)
    certain = told.filter(F.col("_near") & (F.col("_n_near") > 1)).select(F.col("_key").alias("u"), F.col("_first_near").alias("v"), (F.col("_n_near") - 1).alias("n"))

    spot = F.pmod(F.xxhash64("_key"), F.when(F.col("_near"), F.col("_near_blocks")).otherwise(F.col("_far_blocks"))).cast("int")
    put = told.filter(F.col("_far_blocks") > 0).withColumn("_block", F.when(F.col("_near"), F.col("_far_blocks") + spot).otherwise(spot))
    last = F.when(F.col("_near"), F.col("_far_blocks") - 1).otherwise(F.col("_far_blocks") + F.col("_near_blocks") - 1)
    meets = put.withColumn("_other", F.explode(F.sequence(F.lit(0), last))).select("_key", "_family", "_size", "_diff", "_block", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
    checked = meets.repartition("_family", "_i", "_j").groupBy("_family", "_i", "_j").applyInArrow(lambda key, t: verify(tuple(k.as_py() for k in key), t, threshold), "u string, v string, n long")
    found = cut(certain.unionByName(checked))
    links = found.groupBy("u").agg(F.sum("n").alias("n_links"))
    roots = components(found.select("u", "v"))
    return links.join(roots, F.col("u") == F.col("node")).select(F.col("u").alias("_key"), F.col("root").alias("_root"), "n_links")


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that ``jaccard_join`` keeps: one of each class."""
    return take(docs, jaccard_join(docs, words, threshold).select("doc_id", "text_hash", F.col("kept").cast("int").alias("n")))
