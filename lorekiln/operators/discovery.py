"""Link discovery: a breadth-first walk over the edges of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.session import discard, settled


def discover(edges: DataFrame, entry: DataFrame, max_depth: int = 10, max_links: int | None = None) -> DataFrame:
    """(url, depth) of the pages reachable from the entry pages over edges (source, target), each at its least depth.

    The links are written once. One join and one anti join a level; each level is written to the shared folder, which keeps plans short and survives the
    loss of executors. Cycles end as visited pages are left out. With max_links only so many are kept, by depth and url.
    """
    links = settled(edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct(), "links")
    level = settled(entry.select("url", F.lit(0).alias("depth")).distinct(), "level")
    seen = level
    for depth in range(1, max_depth + 1):
        step = level.join(links, level["url"] == links["source"], "inner").select(F.col("target").alias("url")).distinct()
        level = settled(step.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    discard(links)
    return seen if max_links is None else seen.orderBy("depth", "url").limit(max_links)


def discovery_counters(found: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: links found, duplicates among them, pages discovered, and links filtered out (never below 0)."""
    n = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    a = found.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.count_distinct("url")).alias("duplicates"))
    return a.select("total", "duplicates", n.alias("discovered"), F.greatest(F.lit(0), F.col("total") - n - F.col("duplicates")).alias("filtered"))


def scrape_targets(found: DataFrame, module: str, version: str, submodule: str | None = None, content_type: str = "reference") -> DataFrame:
    """Discovered pages as jobs: id, url, module, submodule, version, content_type, depth."""
    return found.select(
        F.substring(F.sha2(F.encode("url", "UTF-8"), 256), 1, 16).alias("id"), "url", F.lit(module).alias("module"), F.lit(submodule).cast("string").alias("submodule"),
        F.lit(version).alias("version"), F.lit(content_type).alias("content_type"), "depth",
    )
