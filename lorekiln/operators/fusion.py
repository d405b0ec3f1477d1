"""Fusing rankings and finishing a search: reciprocal ranks, one row per URL, thresholds, status, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions.text import xml_attribute, xml_escape

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def reciprocal(rank: Column, weight: float = 1.0) -> Column:
    return F.lit(float(weight)) / (F.lit(float(RRF_K)) + rank)


def fuse(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float] = (1.0, 1.0), short: bool = False) -> DataFrame:
    """(id, score, dense_rank, sparse_rank) from two rankings (id, rank): sums of reciprocal ranks, rounded to 9 places.

    With `short` both are known to be a few rows (the heads of rankings) and are fused in one task without a shuffle.
    """
    d = dense.select("id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"))
    s = sparse.select("id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"))
    both = d.unionByName(s)
    one = (both.coalesce(1) if short else both).groupBy("id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    score = F.coalesce(reciprocal(F.col("dense_rank"), weights[0]), F.lit(0.0)) + F.coalesce(reciprocal(F.col("sparse_rank"), weights[1]), F.lit(0.0))
    return one.select("id", F.round(score, 9).alias("score"), "dense_rank", "sparse_rank")


def result_order() -> list[Column]:
    """Best first; equal scores in dense order, then those found by keywords alone in theirs, then by id."""
    return [F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col("id").asc()]


def one_per_url(results: DataFrame, url: str = "url") -> DataFrame:
    """The best row of each url; rows without one are all kept. Input is at most the fused candidates of a query."""
    key = F.when(F.coalesce(F.trim(url), F.lit("")) == "", F.concat(F.lit("\x00"), F.col("id").cast("string"))).otherwise(F.col(url))
    return results.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*result_order()))).where("__r = 1").drop("__r")


def finish(results: DataFrame, k: int, threshold: float | None = None, submodule: str | None = None) -> DataFrame:
    """Filters after fusion (submodule without regard to case, score threshold), then the k best with their place."""
    if submodule is not None:
        results = results.where(F.lower(F.coalesce("submodule", F.lit(""))) == submodule.lower())
    if threshold is not None:
        results = results.where(F.col("score") >= threshold)
    return results.orderBy(*result_order()).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*result_order())))


def response_status(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row (status, results_found, max_score): success, below_threshold where filters left nothing, or no_results."""
    a = raw.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))
    n, best = a.select("n").scalar(), a.select("max_score").scalar()
    left = kept.agg(F.count(F.lit(1)).alias("kept"))
    return left.select(F.when(F.col("kept") > 0, "success").when(n > 0, "below_threshold").otherwise("no_results").alias("status"), n.alias("results_found"), best.alias("max_score"))


def render_item(tag: str = "doc_chunk") -> Column:
    """A result as an XML element with its attributes, breadcrumb and content escaped."""
    version = F.concat(F.lit("v"), F.concat_ws(".", "version_major", "version_minor"))
    attribute = lambda name, value: F.concat(F.lit(f"{name}="), xml_attribute(value))
    attributes = F.concat_ws(
        " ",
        attribute("module", F.col("module")), attribute("version", version), attribute("url", F.col("url")),
        attribute("rank", F.col("place").cast("string")), attribute("score", F.format_string("%.4f", "score")),
        F.when(F.coalesce("submodule", F.lit("")) != "", attribute("submodule", F.col("submodule"))),
    )
    crumb = F.coalesce(F.nullif(F.trim("section_path"), F.lit("")), F.col("title"))
    return F.concat(
        F.lit(f"<{tag} "), attributes, F.lit(">\n  <breadcrumb>"), xml_escape(crumb), F.lit("</breadcrumb>\n  <content>"),
        xml_escape(F.col("content")), F.lit(f"</content>\n</{tag}>"),
    )


def score_breakdown() -> Column:
    d = F.when(F.col("dense_rank").isNotNull(), F.concat(F.lit("dense: #"), F.col("dense_rank").cast("string")))
    s = F.when(F.col("sparse_rank").isNotNull(), F.concat(F.lit("sparse: #"), F.col("sparse_rank").cast("string")))
    both = F.concat_ws(", ", d, s)
    return F.when(both == "", "N/A").otherwise(both)


def prompt(results: DataFrame, query: str, heading: str = "Search Results") -> DataFrame:
    """One row: the k results of a search as a prompt text; a fixed sentence where there are none."""
    module = F.concat_ws("/", "module", F.nullif("submodule", F.lit("")))
    part = F.concat(
        F.lit("### "), F.col("place").cast("string"), F.lit(". "), F.col("title"), F.lit("\n- **URL:** "), F.col("url"), F.lit("\n- **Module:** "), module,
        F.lit("\n- **Version:** v"), F.concat_ws(".", "version_major", "version_minor"), F.lit("\n- **Score:** "), F.format_string("%.4f", "score"),
        F.lit("\n- **Section:** "), F.coalesce("section_path", F.lit("")), F.lit("\n\n"), F.trim("content"), F.lit("\n"),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("t")))), lambda x: x["t"])
    body = results.agg(F.array_join(parts, "\n").alias("b"))
    text = F.when(F.col("b") == "", "No relevant documentation chunks found.").otherwise(F.col("b"))
    return body.select(F.trim(F.concat(F.lit(f"## {heading}\n\n**Query:** {query}\n\n"), text)).alias("prompt"))
