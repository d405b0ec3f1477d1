"""Readers of the submodule registry, the scrape matrix, page folders and object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.url import is_metadata_path, safe_path

REGISTRY = "targets array<struct<module_key string, submodule_key string, base_url string, version_selector string, github_repo string>>"
METADATA = "title string, url string, module string, submodule string, version string, content_type string, content_hash string, scraped_at timestamp"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per target of a registry file (JSON with a list of targets)."""
    return spark.read.schema(REGISTRY).option("multiLine", True).json(path).select(F.inline("targets"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Jobs (module, submodule, version, lane, url, pages) of a scrape matrix: up to three lanes a row, blanks left out."""
    raw = spark.read.option("header", True).csv(path)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    lanes = F.array(
        F.struct(F.lit("reference").alias("lane"), blank("reference_url").alias("url"), F.lit(None).cast("array<string>").alias("pages")),
        F.struct(F.lit("api").alias("lane"), blank("api_url").alias("url"), F.lit(None).cast("array<string>").alias("pages")),
        F.struct(F.lit("wiki").alias("lane"), blank("github_repo").alias("url"), F.split(blank("github_wiki_pages"), r"\|").alias("pages")),
    )
    rows = raw.select(blank("module").alias("module"), blank("submodule").alias("submodule"), blank("version").alias("version"), F.inline(lanes))
    return rows.where("module is not null and url is not null and (lane <> 'wiki' or pages is not null)")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, markdown, metadata struct) of a folder of markdown files, each with the metadata.json beside it, if readable."""
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace(F.input_file_name(), r"^file:/+", "/"), F.lit("^" + base + "/"), F.lit(""))
    files = spark.read.option("recursiveFileLookup", True)
    texts = files.option("pathGlobFilter", "*.md").text(base, wholetext=True).select(rel.alias("path"), F.col("value").alias("markdown"))
    metas = files.option("pathGlobFilter", "*.json").text(base, wholetext=True).select(rel.alias("meta"), F.col("value").alias("json")).where(is_metadata_path(F.col("meta")))
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    # the newer layout keeps metadata beside the page, the older one in a folder of its own by the page's name
    near = metas.select(F.when(F.col("meta").rlike(r"(^|/)metadata\.json$"), F.concat(folder(F.col("meta")), F.lit("document.md"))).otherwise(
        F.regexp_replace(F.regexp_replace("meta", r"(^|/)metadata/", "$1"), r"\.json$", ".md")).alias("path"), F.from_json("json", METADATA).alias("metadata"))
    return texts.where(safe_path(F.col("path"))).join(near, "path", "left")


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """(key, size_bytes, last_modified, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    key = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), F.lit("^" + root.rstrip("/") + "/"), F.lit(""))
    return files.select(key.alias("key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), "content")
