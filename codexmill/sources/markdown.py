"""Markdown trees, manifests, planning folders, PDFs and images as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.functions import text
from codexmill.functions.ids import or_else, strip

IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp"}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def folder_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, folder, content) of every .md file below root."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    return files.select(path.alias("path"), file_name(path).alias("name"), folder_name(path).alias("folder"), F.col("value").alias("content"))


def pending_markdown(files: DataFrame) -> DataFrame:
    """(path, skipped): sources to describe; described outputs and sources that have one are named with the reason."""
    described = files.filter(F.col("name").endswith(".described.md")).select(F.regexp_replace("path", r"\.described\.md$", ".md").alias("_p"))
    marked = files.join(described, F.col("path") == F.col("_p"), "left")
    reason = F.when(F.col("name").endswith(".described.md"), "is a described output").when(F.col("_p").isNotNull(), "described output exists")
    return marked.select("path", "content", reason.alias("skipped"))


def manifest_pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(pages, chain) of a folder with manifest.json: files of the manifest that exist and say something.

    A page's cluster is its folder's name made readable; pages of a folder are chained
    in the manifest's order.
    """
    manifest = spark.read.option("multiLine", True).schema("source string, files array<struct<filename:string,title:string,summary:string,source_ranges:string>>").json(f"{root}/manifest.json")
    listed = manifest.select("source", F.posexplode("files").alias("ord", "f")).select("source", "ord", file_name(F.col("f.filename")).alias("_name"), "f.title", "f.summary", "f.source_ranges")
    met = listed.join(markdown_files(spark, root), F.col("_name") == F.col("name")).filter(strip("content") != "")
    pages = met.select(F.col("source").alias("document"), "ord", "name", or_else(F.col("title"), text.title_of(F.col("content")), F.col("name")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), text.parse_ranges(F.col("source_ranges")).alias("ranges"), text.humanize(F.col("folder")).alias("cluster"), "folder", F.col("content").alias("body"))
    return pages, chained(pages, "folder")


def planning_pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(pages, chain) of a folder with docs/*.md: front matter, then metadata.json, then coverage.json, by precedence."""
    files = markdown_files(spark, f"{root}/docs").filter(strip("content") != "")
    said = files.withColumn("_f", text.frontmatter(F.col("content"))).select("name", "_f.meta", "_f.body")
    metadata = spark.read.option("multiLine", True).schema("inferred_file_name string, original_file_name string, files array<struct<name:string,header:string>>").json(f"{root}/_planning/metadata.json")
    headers = metadata.select(F.explode("files").alias("f")).select(text.canonical_name(F.col("f.name")).alias("_m"), F.col("f.header").alias("header"))
    document = metadata.select(or_else(F.col("original_file_name"), F.col("inferred_file_name")).alias("document")).limit(1)
    coverage = spark.read.option("multiLine", True).schema("files array<struct<filename:string,source_start:int,source_end:int,title:string,summary:string,header:string>>").json(f"{root}/_planning/coverage.json")
    covered = coverage.select(F.explode("files").alias("c")).select(text.canonical_name(F.col("c.filename")).alias("_c"), F.col("c.title").alias("c_title"), F.col("c.summary").alias("c_summary"), F.col("c.header").alias("c_header"), F.col("c.source_start").alias("start"), F.col("c.source_end").alias("end"))
    rows = said.withColumn("_key", text.canonical_name(F.col("name"))).join(headers, F.col("_key") == F.col("_m"), "left").join(covered, F.col("_key") == F.col("_c"), "left").crossJoin(document)  # one row
    order = Window.partitionBy("document").orderBy(text.natural_number(F.col("name")), "name")
    own_ranges = text.parse_ranges(F.col("meta")["source_lines"])
    ranges = F.when(F.size(own_ranges) > 0, own_ranges).when(F.col("start").isNotNull(), F.array(F.struct("start", "end"))).otherwise(own_ranges)
    pages = rows.withColumn("ord", F.row_number().over(order) - 1).select("document", "ord", "name", or_else(F.col("meta")["title"], F.col("c_title"), F.col("header"), text.title_of(F.col("body")), F.col("name")).alias("title"), F.coalesce(or_else(F.col("meta")["summary"], F.col("c_summary")), F.lit("")).alias("summary"), ranges.alias("ranges"), or_else(F.col("c_header"), F.col("header"), F.lit("General")).alias("cluster"), F.lit("docs").alias("folder"), "body")
    return pages, chained(pages, "document")


def chained(pages: DataFrame, group: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy("ord")
    return pages.select(F.col("name").alias("source"), F.lead("name").over(w).alias("target")).filter(F.col("target").isNotNull())


def load(spark: SparkSession, root: str, has_manifest: bool) -> tuple[DataFrame, DataFrame]:
    return manifest_pages(spark, root) if has_manifest else planning_pages(spark, root)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, url): images as data URLs; unknown types count as PNG."""
    types = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.coalesce(types[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))], F.lit("image/png"))
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_TYPES)).select("path", F.col("length").alias("size"), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content")).alias("url"))


def smallest_image(images: DataFrame) -> DataFrame:
    return images.filter(F.col("size") > 0).agg(F.min_by("path", F.struct("size", "path")).alias("path"))


def convert_pdfs(spark: SparkSession, root: str, done: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """(path, hash, status, content) of each PDF below root: converted, failed, or skipped if its hash is in ``done``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select("path", F.sha2("content", 256).alias("hash"), "content")
    skipped = files.join(done.toDF("hash").distinct(), "hash", "left_semi").select("path", "hash", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                try:
                    out.append((row.path, row.hash, "completed", convert(row.content)))
                except Exception as error:  # one bad file is a row, not the end of the job
                    out.append((row.path, row.hash, "failed", str(error)))
            yield pd.DataFrame(out, columns=["path", "hash", "status", "content"])

    todo = files.join(done.toDF("hash").distinct(), "hash", "left_anti").select("path", "hash", "content")
    return todo.mapInPandas(run, "path string, hash string, status string, content string").unionByName(skipped)
