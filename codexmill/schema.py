"""Tables of the knowledge graph as Spark schemas, and a way to bring older data to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIVE, STALE, SUPERSEDED, DELETED = "active", "stale", "superseded", "deleted"
ENDOGENOUS, EXOGENOUS = "endogenous", "exogenous"

LISTS = {"claims": T.ArrayType(T.StringType()), "keywords": T.ArrayType(T.StringType()), "source_episode_ids": T.ArrayType(T.StringType()), "embedding": T.ArrayType(T.FloatType())}
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
KINDS = LISTS | {"source_ranges": RANGES, "ordinal": T.IntegerType(), "start_char": T.IntegerType(), "end_char": T.IntegerType()}


def schema(names: str) -> T.StructType:
    """Columns by name; all that ``KINDS`` doesn't name are strings."""
    return T.StructType([T.StructField(n, KINDS.get(n, T.StringType())) for n in names.split()])


#: Times are strings in ISO form, always UTC, so that text order is time order.
NODES = schema("id body type title original_document_name source_path source_ranges source_version source_material_hash entity claims keywords summary cluster status created_at updated_at")
EDGES = schema("id source_node_id target_node_id label summary created_at valid_at invalid_at expired_at source_episode_ids")
ITEMS = schema("id node_id field text ordinal start_char end_char source_path source_hash")
VECTORS = schema("id embedding")
SOURCES = schema("document_name source_hash ingested_at")
META = schema("key value")
JOBS = schema("id type payload user_id status created_at started_at finished_at result error")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema in order: missing ones null (lists empty), others cast."""
    def column(field: T.StructField):
        if field.name in df.columns:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        empty = F.array().cast(field.dataType) if isinstance(field.dataType, T.ArrayType) else F.lit(None).cast(field.dataType)
        return empty.alias(field.name)

    return df.select(*[column(f) for f in schema.fields])
