"""Content-addressed identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"


def text_or(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def strip(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def blank(c: Column) -> Column:
    """Whether nothing is left of the text when it is stripped; seen at its first other character."""
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def stripped(c: Column) -> Column:
    """As ``strip``, for columns: the text is searched only if it begins or ends with white space."""
    return F.when(F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(SPACE), strip(c)).otherwise(c)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def or_else(c: Column, *others: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(F.nullif(c, F.lit("")), *[F.nullif(o, F.lit("")) for o in others])


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def source_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def slug(c: Column, n: int = 40) -> Column:
    """Lower-cased letters and digits joined by dashes, cut to n; "node" if nothing is left."""
    dashed = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, n), F.lit("")), F.lit("node"))


def node_id(body: Column, document: Column) -> Column:
    return F.concat(F.lit("node:"), slug(or_else(document, F.lit("node")), 24), F.lit(":"), short_hash(body))


def exogenous_id(seed: Column) -> Column:
    return F.concat(F.lit("exo:"), short_hash(seed))


def edge_id(source: Column, target: Column, label: Column) -> Column:
    return F.concat(F.lit("edge:"), short_hash(F.concat_ws("|", source, target, label), 16))


def item_id(node: Column, field: Column, ordinal: Column) -> Column:
    return short_hash(F.concat_ws("|", node, field, ordinal.cast("string")))


def version_hash(parts: Column, separator: str = "\n") -> Column:
    """One hash over an ordered array of bodies."""
    return F.sha2(F.array_join(parts, separator), 256)
