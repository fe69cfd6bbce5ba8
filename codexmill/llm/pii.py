"""Personal data, and the terms that give it away.

Base kinds are found by patterns and checks. Beyond them, corpus co-occurrence tells how
much a term anywhere in the document of a protected value discloses of it: with counts of documents, the
pointwise mutual information of term and value over the information of the value,

    ln(N * n(value, term) / (n(value) * n(term))) / ln(N / n(value)),

is 1 for a term that never occurs without the value and 0 for one that has no bearing on
it. Terms from GENERALISE on are replaced by a general word, from REMOVE on they are
removed, in the documents that hold the value. A pair seen in fewer than SUPPORT
documents proves nothing: there, every rare word would seem to give the value away. So a
value that stands in one document only is protected by its own span (every base value is
one, and ``sanitise`` replaces it), not through the words around it.

All of it is column expressions, joins and counts with map-side combining; positions in
a text are running sums by doubling reach, so a text of n matches takes n log n steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The contract's patterns, written so that they take linear time: a match starts where a
#: run of its first characters starts or where the last match ended, and gives nothing back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all; the first is a plain search.
NEEDS = {"email": ("@", None), "ip": (".", r"[0-9]\.[0-9]+\.[0-9]"), "card": ("", r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": ("+", r"\+[0-9]")}
WORD = r"[\p{L}\p{N}]{3,}+"
GENERALISE, REMOVE = 0.75, 0.95
#: Documents in which a value and a term must be found together.
SUPPORT = 2
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        doubled = F.when(i % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check that a match must pass."""
    n = F.length(digits_of(value))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "[.]"), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits_of(value))).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of each place of an array, all values up to it combined; each step doubles how far back a place has looked."""
    reach = lambda v: F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda d: d < F.size(v))
    step = lambda acc, d: F.transform(acc, lambda v, i: F.when(i >= d, combine(v, F.get(acc, i - d))).otherwise(v))
    return let(values, lambda v: F.aggregate(reach(v), v, step))


def located(text: Column, pattern: Column, kind: str, rank: int) -> Column:
    """Spans of all matches, leftmost and non-overlapping, in code points, end exclusive.

    The pieces between the matches and the matches themselves, laid end to end, give
    every position.
    """

    def span(end: Column, found: Column) -> Column:
        return F.struct((end - F.length(found)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), found.alias("value"))

    def spans(matches: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        return F.zip_with(running(lengths, lambda a, b: a + b), matches, span)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with by(span, end of all earlier spans) for each span, which are in order; what overlaps goes once.

    The text is cut as four bytes for each code point, where a place is found without counting.
    """

    def built(wide: Column, s: Column, ends: Column) -> Column:
        piece = lambda at, n: F.decode(F.substring(wide, at * 4 + 1, F.greatest(n, F.lit(0)) * 4), "UTF-32")
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        parts = F.transform(s, lambda x, i: F.concat(piece(before(i), x["start"] - before(i)), by(x, before(i))))
        last = F.get(ends, F.size(ends) - 1)
        return F.concat(F.array_join(parts, ""), piece(last, F.octet_length(wide)))

    ends_of = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    whole = let(F.encode(text, "UTF-32"), lambda wide: let(spans, lambda s: let(ends_of(s), lambda ends: built(wide, s, ends))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def passing(kind: str) -> Callable[[Column], Column]:
    return lambda span: holds(kind, span["value"])


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    found = []
    for rank, kind in enumerate(KINDS):
        mark, need = NEEDS[kind]
        ask = F.contains(text, F.lit(mark)) if mark else F.lit(True)
        ask = ask & text.rlike(need) if need else ask
        spans = F.filter(located(text, F.lit(PATTERNS[kind]), kind, rank), passing(kind))
        found.append(F.when(ask, spans).otherwise(empty))
    return F.array_sort(F.concat(*found))


def entity_of(span: Column) -> Column:
    """The protected value without its spelling: case, blanks and marks set aside."""
    value = F.when(span["kind"].isin("card", "phone"), digits_of(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def masked(text: Column, base: Column) -> Column:
    """The text with its base spans blanked out, every other character in its place."""
    return replaced(text, base, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))


def terms_of(text: Column, base: Column) -> Column:
    """The distinct words of the text outside its base spans, which are protected already."""
    return F.array_distinct(F.regexp_extract_all(F.lower(masked(text, base)), F.lit(WORD), F.lit(0)))


def prepared(docs: DataFrame, keep_text: bool) -> DataFrame:
    """doc_id, tag, base, text (null where no base span is, unless kept), entities; the first four are written out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = cut(rows.select("doc_id", "base", F.when(F.lit(keep_text) | (F.size("base") > 0), F.col("text")).alias("text")).withColumn("tag", F.monotonically_increasing_id()))
    return rows.withColumn("entities", F.array_distinct(F.transform("base", entity_of)))


def pairs_of(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """_tag, _e, _t: each row's pairs of an entity, if among entities, and a distinct term of the whole text."""
    held = rows.filter(F.size("base") > 0)
    own = held.select(F.col("tag").alias("_tag"), F.explode("entities").alias("entity")).join(entities, "entity", "left_semi").groupBy("_tag").agg(F.collect_list("entity").alias("_own"))
    met = held.select("tag", "text", "base").join(own, F.col("tag") == F.col("_tag"))
    return met.select("_tag", "_own", F.explode(terms_of(F.col("text"), F.col("base"))).alias("_t")).select("_tag", F.explode("_own").alias("_e"), "_t")


def disclosing_terms(docs: DataFrame, rows: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """entity, term, disclosure, removed of the pairs over the threshold; counts are of all documents."""
    n = rows.count()
    # a value in fewer documents than support has no pair in as many, so none is lost
    values = rows.select(F.explode("entities").alias("_entity")).groupBy("_entity").agg(F.count(F.lit(1)).alias("n_c")).filter(F.col("n_c") >= support)
    pairs = pairs_of(rows, values.select(F.col("_entity").alias("entity")))
    together = pairs.groupBy(F.col("_e").alias("entity"), F.col("_t").alias("term")).agg(F.count(F.lit(1)).alias("n_ct")).filter(F.col("n_ct") >= support)
    words = terms_of(text_of(), base_spans(text_of()))
    frequency = docs.select(F.explode(words).alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("n_t"))
    joined = together.join(values, F.col("entity") == F.col("_entity")).join(frequency, F.col("term") == F.col("_term"))
    pmi = F.log(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    disclosure = F.when(F.col("n_c") < n, pmi / F.log(F.lit(float(n)) / F.col("n_c")))
    return joined.select("entity", "term", disclosure.alias("disclosure")).filter(F.col("disclosure") >= generalise).withColumn("removed", F.col("disclosure") >= remove)


def personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, base, spans, and text where it has spans (or everywhere).

    * base holds the spans of email, ip, card and phone, spans these and those of
      disclosing terms, each (start, rank, end, kind, value) by start, then kind; a kind's
      matches are leftmost and do not overlap, those that fail its check are dropped.
    * Terms are words of three or more letters or digits, in any case and at any distance
      from the value; every one of a flagged term's places in every row that holds its
      value is a span, save those inside a base span, which are left to that. Joint and
      single counts are all of documents.
    * Null texts count as empty; repeated rows count as further documents; an empty
      table gives no rows; other columns play no part.
    """
    rows = prepared(docs, keep_text)
    flagged = cut(disclosing_terms(docs, rows, generalise, remove))
    told = pairs_of(rows, flagged.select("entity"))
    own = told.join(flagged, (F.col("_e") == F.col("entity")) & (F.col("_t") == F.col("term"))).groupBy("_tag").agg(F.collect_set("term").alias("_terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("_removed"))
    joined = rows.select("doc_id", "tag", "base", "text").join(own, F.col("tag") == F.col("_tag"), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    terms = F.when(F.col("_terms").isNotNull(), located(masked(F.col("text"), F.col("base")), pattern, TERM, len(KINDS)))
    spans = F.array_sort(F.concat("base", F.coalesce(terms, F.expr(f"cast(array() as array<{SPAN}>)"))))
    return joined.select("doc_id", "base", spans.alias("spans"), "text", F.coalesce("_removed", F.expr("cast(array() as array<string>)")).alias("removed"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text, spans: every text with base values and disclosing terms replaced.

    A base value becomes its kind in brackets, a generalised term [TERM]; a removed
    term leaves nothing. Where spans overlap, the first names the whole stretch.
    """
    found = personal_data(docs, generalise, remove, keep_text=True)


    def label(s: Column, at: Column) -> Column:
        gone = (s["start"] < at) | (s["kind"] == TERM) & F.array_contains("removed", F.lower(s["value"]))
        return F.when(gone, "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    return found.select("doc_id", replaced(F.col("text"), F.col("spans"), label).alias("text"), "spans")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans as text."""
    found = personal_data(docs)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
