"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often they occur. For each term and
each place of the signature, hashes give two gamma(2, 1) variates r and c and a uniform
one b; a term of weight w then has the step t = floor(ln w / r + b) and the value
c / exp(r * (t - b + 1)). The least value of a document is its sample. Two documents
sample alike at a place with a probability equal to their generalised Jaccard similarity
(sum of the lesser weights over sum of the greater), so the share of equal places
estimates it, with a standard error of sqrt(J * (1 - J) / PLACES).

All of it is codegen'd arithmetic over rows of (document, term), grouped where the
texts lie: texts are shuffled once, terms and samples never.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_width, text_of

PLACES = 64
#: Places that one row of a term has values for; few, so that the generated code stays small enough for the JVM to compile.
STRETCH = 4
#: Hex digits of a place in the fingerprint.
DIGITS = 4
#: Stands for null where rows are matched by doc_id; as a doc_id of its own it counts as null.
NO_ID = -(2**63)


def words_of(text: Column) -> Column:
    """Words in small letters, between white space; may hold empty ones."""
    return F.split(F.lower(text), r"\s+")


def sample_value(weight: str, place: str) -> str:
    """SQL for the logarithm of the value of a term of log weight ``weight`` at a place of the signature.

    Two hashes give the variates: r by the halves of the first, c and b by thirds of the
    second. As text, since thousands of calls from Python would cost more than the work.
    """
    one, two = f"xxhash64(term, {place})", f"xxhash64(term, -1 - {place})"
    r = f"({64 * math.log(2)!r}D - ln((shiftrightunsigned({one}, 32) + 0.5D) * (({one} & {2**32 - 1}L) + 0.5D)))"
    c = f"({42 * math.log(2)!r}D - ln((({two} & {2**21 - 1}L) + 0.5D) * ((shiftrightunsigned({two}, 21) & {2**21 - 1}L) + 0.5D)))"
    b = f"(shiftrightunsigned({two}, 42) / {2.0**22!r}D)"
    return f"ln({c}) - {r} * (floor({weight} / {r} + {b}) - {b} + 1.0D)"


def least_samples(terms: DataFrame, keys: list[str], weights: dict[str, str]) -> DataFrame:
    """keys, and for each entry of ``weights`` (name, column) the signature under that name, as binary.

    terms: keys, term (a hash), and columns of weights; a weight of 0 takes no part. A
    signature without any term is all zeros.
    """
    logs = terms.select(*keys, "term", *[F.ln(F.col(c)).alias(f"_w_{n}") for n, c in weights.items()])  # ln 0 is null
    stretches = logs.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(PLACES - STRETCH), F.lit(STRETCH))))
    places = [(n, p) for n in weights for p in range(STRETCH)]
    values = stretches.selectExpr(*keys, "_at", *[f"{sample_value(f'_w_{n}', f'(_at + {p})')} AS _{n}_{p}" for n, p in places])
    least = values.groupBy(*keys, "_at").agg(*[F.expr(f"min(_{n}_{p})").alias(f"_{n}_{p}") for n, p in places])
    digits = f"if({{0}} is null, '{'0' * DIGITS}', lpad(hex(xxhash64({{0}}) & {16**DIGITS - 1}L), {DIGITS}, '0'))"
    parts = least.selectExpr(*keys, "_at", *[f"concat({', '.join(digits.format(f'_{n}_{p}') for p in range(STRETCH))}) AS {n}" for n in weights])
    whole = "unhex(array_join(transform(array_sort(collect_list(struct(_at, {0}))), x -> x.{0}), ''))"
    return parts.groupBy(*keys).agg(*[F.expr(whole.format(n)).alias(n) for n in weights])


def likeness(one: str, other: str) -> Column:
    """Share of equal places of two fingerprints (columns of hex): the estimate of the similarity."""
    equal = [f"int(substring({one}, {at}, {DIGITS}) = substring({other}, {at}, {DIGITS}))" for at in range(1, 1 + DIGITS * PLACES, DIGITS)]
    return F.expr(f"({' + '.join(equal)}) / {float(PLACES)}D")


def keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: rows alike in did and th are alike in doc_id and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))


def doc_id() -> Column:
    return F.nullif(F.col("did"), F.lit(NO_ID)).alias("doc_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex): one row for each distinct pair of doc_id and text."""
    rows = keyed(docs).groupBy("did", "th").agg(F.first("text").alias("text"))
    terms = rows.select("did", "th", F.explode(words_of(F.col("text"))).alias("word"))
    counted = terms.groupBy("did", "th", F.xxhash64("word").alias("term")).agg(F.count(F.when(F.col("word") != "", 1)).alias("n"))
    return least_samples(counted, ["did", "th"], {"own": "n"}).select(doc_id(), F.lower(F.hex("own")).alias("fingerprint"))


def ring(keys: DataFrame) -> DataFrame:
    """did, th, n_chars with the next row's key (ndid, nth) and the one before (pdid, pth, its n_chars p_chars), in a ring.

    Only keys are sorted: by range, then inside each range; a row for each range ties the
    ends together.
    """
    order = ["did", "th"]
    ranged = keys.repartitionByRange(shuffle_width(keys.sparkSession), *order).sortWithinPartitions(*order)
    rows = cut(ranged.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    key = F.struct("did", "th", "n_chars")
    ends = rows.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    parts = Window.orderBy("_part")  # a row for each range
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ties = ends.select(
        F.col("_part").alias("_of"), F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("after"), F.coalesce(F.lag("last").over(parts), F.last("last").over(whole)).alias("before")
    )
    own = Window.partitionBy("_part").orderBy(*order)
    inner = rows.withColumn("_next", F.lead(key).over(own)).withColumn("_last", F.lag(key).over(own))
    tied = inner.join(ties, F.col("_part") == F.col("_of"))
    after, before = F.coalesce("_next", "after"), F.coalesce("_last", "before")
    return tied.select(
        *[F.col(c).alias(f"k_{c}") for c in ("did", "th", "n_chars")], after["did"].alias("ndid"), after["th"].alias("nth"), before["did"].alias("pdid"), before["th"].alias("pth"), before["n_chars"].alias("p_chars")
    )


def with_edited(docs: DataFrame) -> DataFrame:
    """did, th, n_chars, text, edited, own_next, copies, ndid, nth: each distinct row and its edited text.

    Of rows alike in doc_id and text all but the last are followed by their like; these
    are one row more, with own_next true and their number as copies.
    """
    rows = keyed(docs)
    keys = rows.groupBy("did", "th").agg(F.max(F.length("text")).alias("n_chars"))
    texts = rows.groupBy("did", "th").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    met = texts.join(cut(ring(keys)).hint("merge"), (F.col("did") == F.col("k_did")) & (F.col("th") == F.col("k_th")))
    # With the same columns on both sides (hence copies, which are always some) one shuffle of the texts serves both.
    heads = met.filter(F.col("copies") > 0).select(F.col("pdid").alias("h_did"), F.col("pth").alias("h_th"), F.left("text", F.floor(F.col("p_chars") / 4).cast("int")).alias("head"))
    both = met.join(heads.hint("merge"), (F.col("did") == F.col("h_did")) & (F.col("th") == F.col("h_th")))
    q = F.floor(F.col("k_n_chars") / 4).cast("int")
    kept = F.left("text", F.col("k_n_chars") - q)
    last = F.struct(F.lit(False).alias("own_next"), F.concat(kept, F.col("head")).alias("edited"), F.lit(1).cast("long").alias("copies"), "ndid", "nth")
    rest = F.struct(F.lit(True).alias("own_next"), F.concat(kept, F.left("text", q)).alias("edited"), (F.col("copies") - 1).alias("copies"), F.col("did").alias("ndid"), F.col("th").alias("nth"))
    each = F.explode(F.when(F.col("copies") > 1, F.array(last, rest)).otherwise(F.array(last))).alias("e")
    return both.select("did", "th", F.col("k_n_chars").alias("n_chars"), "text", each).select("did", "th", "n_chars", "text", "e.*")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    * Null texts are empty. Texts without words have a fingerprint of zeros, which is
      like itself alone.
    * Rows follow each other by doc_id, null first, rows of one doc_id by a hash of the
      text; a row that repeats both is followed by its like. A lone row follows itself.
    * An empty table gives no rows; further columns of the input play no part.
    """
    rows = with_edited(docs)
    keys = ["did", "th", "own_next", "n_chars", "copies", "ndid", "nth", "sha"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("s")
    bodies = rows.select(*keys[:-1], F.unhex(F.sha2("edited", 256)).alias("sha"), sides)
    words = bodies.select(*keys, "s.side", F.explode(words_of(F.col("s.body"))).alias("word"))
    there = F.col("word") != ""
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count(F.when(there & (F.col("side") == 0), 1)).alias("n"), F.count(F.when(there & (F.col("side") == 1), 1)).alias("n_edited"))
    made = cut(least_samples(terms, keys, {"own": "n", "edited": "n_edited"}))
    following = made.filter(~F.col("own_next")).select(F.col("did").alias("f_did"), F.col("th").alias("f_th"), F.col("own").alias("following"))
    hexed = lambda c: F.lower(F.hex(c))
    near = made.join(following, (F.col("ndid") == F.col("f_did")) & (F.col("nth") == F.col("f_th")))
    out = near.select(doc_id(), "n_chars", "copies", hexed("sha").alias("edited_sha256"), hexed("own").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"), hexed("following").alias("_next"))
    out = out.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).withColumn("near_next", likeness("fingerprint", "_next"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_k")
    return out.select(each, *[c for c in out.columns if c not in ("copies", "_next")]).drop("_k").withColumn("n_chars", F.col("n_chars").cast("long"))
