"""Evidence of nodes: what search finds instead of whole nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.functions.ids import blank, item_id, stripped
from codexmill.functions.text import chunks

#: Size and overlap of body windows, in characters.
BIG, SMALL = (3000, 300), (512, 80)


def search_items(nodes: DataFrame, big: tuple[int, int] = BIG, small: tuple[int, int] = SMALL) -> DataFrame:
    """Item rows of nodes: title, summary, each claim, big and small windows of the body; blank ones have no row.

    Ids tell node, field and ordinal, so building them again gives the same rows. All
    five kinds come from one pass over the nodes.
    """
    window = lambda field, size: F.transform(chunks(F.col("body"), *size), lambda c, i: F.struct(F.lit(field).alias("field"), c["chunk"].alias("text"), i.cast("int").alias("ordinal"), c["start"].cast("int").alias("start_char"), c["end"].cast("int").alias("end_char")))
    nowhere = F.lit(None).cast("int")
    plain = lambda field, text, i: F.struct(F.lit(field).alias("field"), text.alias("text"), i.cast("int").alias("ordinal"), nowhere.alias("start_char"), nowhere.alias("end_char"))
    claims = F.transform(F.coalesce("claims", F.array().cast("array<string>")), lambda c, i: plain("claim", c, i))
    parts = F.concat(F.array(plain("title", F.col("title"), F.lit(0)), plain("summary", F.col("summary"), F.lit(0))), claims, window("big_chunk", big), window("small_chunk", small))
    rows = nodes.select(F.col("id").alias("node_id"), F.explode(parts).alias("p"), F.col("source_path"), F.col("source_material_hash").alias("source_hash")).filter(~blank(F.col("p.text")))
    rows = rows.select("node_id", "p.field", stripped(F.col("p.text")).alias("text"), "p.ordinal", "p.start_char", "p.end_char", "source_path", "source_hash")
    return rows.select(item_id(F.col("node_id"), F.col("field"), F.col("ordinal")).alias("id"), *rows.columns)
