"""Markdown with image units as rows: a table function that parts it, and the way back."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

#: The markup of image units. Fixed values.
UNIT = re.compile(r"<image-unit\b[^>]*>.*?</image-unit>", re.IGNORECASE | re.DOTALL)
TAG = re.compile(r"<img\b[^>]*>", re.IGNORECASE)
SAID = re.compile(r"<image-description\b[^>]*>(.*?)</image-description>", re.IGNORECASE | re.DOTALL)
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
UNDESCRIBED = "image without description"
ROW = "position int, kind string, raw string, src string, alt string, title string, description string, problem string"


def attribute(tag: str, name: str) -> str:
    """The value of an attribute in double, single or no quotes; empty if there is none."""
    found = re.search(rf"{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", tag, re.IGNORECASE)
    return next((g for g in found.groups() if g), "") if found else ""


class Segments:
    """One row for each piece of a text in order: markdown as it stands, and image units with what they hold."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        text, at, position = text or "", 0, 0
        for unit in UNIT.finditer(text):
            if unit.start() > at:
                yield position, "markdown", text[at : unit.start()], None, None, None, None, None
                position += 1
            raw = unit.group(0)
            tag, said = TAG.search(raw), SAID.search(raw)
            src, alt, title = (attribute(tag.group(0) if tag else "", n).strip() if n == "src" else attribute(tag.group(0) if tag else "", n) for n in ("src", "alt", "title"))
            description = said.group(1).strip() if said else ""
            yield position, "image", raw, src, alt, title, description, UNDESCRIBED if src and not description else None
            position, at = position + 1, unit.end()
        if at < len(text) or not position:
            yield position, "markdown", text[at:], None, None, None, None, None


def table_function() -> UserDefinedTableFunction:
    return F.udtf(Segments, returnType=ROW)


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the rows of ``Segments``, by a lateral join: the raw pieces of a key in order are its text; a null text is one empty piece."""
    spark = df.sparkSession
    spark.udtf.register("codexmill_segments", table_function())
    return spark.sql(f"SELECT d.`{key}`, s.* FROM {{d}} d, LATERAL codexmill_segments(d.`{text}`) s", d=df)


def joined(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): the pieces put together as they stood; a text's pieces are bounded by its length."""
    held = F.array_sort(F.collect_list(F.struct("position", "raw")))
    return rows.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x["raw"]), "").alias("text"))


def escaped(value: Column) -> Column:
    for plain, entity in ENTITIES:
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def unit(src: Column, alt: Column, title: Column, description: Column) -> Column:
    """An image unit's markup out of its parts; a src or title that is empty is left out."""
    named = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f' {name}="'), escaped(v), F.lit('"'))).otherwise("")
    image = F.concat(F.lit("<img"), named("src", F.trim(src)), F.lit(' alt="'), escaped(F.coalesce(alt, F.lit(""))), F.lit('"'), named("title", title), F.lit(">"))
    return F.concat(F.lit("<image-unit>\n  <image-media>\n    "), image, F.lit("\n  </image-media>\n  <image-description>\n"), F.coalesce(description, F.lit("")), F.lit("\n  </image-description>\n</image-unit>"))


def problems(rows: DataFrame, key: str) -> DataFrame:
    """(key, position, problem) of the pieces that don't hold."""
    return rows.filter(F.col("problem").isNotNull()).select(key, "position", "problem")
