"""Lines that chunks share with the chunks of the nearest pages: page differencing over a collection of chunks.

This is the method dealt for markup residue. It finds what pages repeat, not what is markup, so it serves here as a measured
stage of its own beside the converter of `markup`; the README has the figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.differencing import shared_with_nearest


def shared_chunk_lines(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """(chunk_id, line_no): non-blank lines that a chunk shares with a chunk of the same place on the nearest page.

    A chunk's page is the current record of its document_id, the one with the latest scraped_at; chunks without a record
    stand together under an empty address. Within each host the chunks of one chunk_index follow each other by URL path and
    each is aligned with the one before and after it, so a document of any number of chunks is no task of its own. Lines
    are counted from 1 with the blank ones and compared without white space at their ends; CRLF and CR end lines too.
    Repeated rows count once; of a chunk_id with several contents each content is compared by itself.
    """
    now = records.where("id is not null").groupBy("id").agg(F.max(F.struct("scraped_at", "url")).alias("r")).select(F.col("id").alias("__id"), F.coalesce("r.url", F.lit("")).alias("url"))
    rows = chunks.where("content is not null").select("chunk_id", "document_id", "chunk_index", F.regexp_replace("content", r"\r\n?", "\n").alias("content")).distinct()
    placed = rows.join(now, F.col("document_id") == F.col("__id"), "left")
    url = F.coalesce("url", F.lit(""))
    site = F.xxhash64(F.lower(F.regexp_extract(url, r"^(?:\w+:)?//([^/?#]*)", 1)))
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x, i: F.struct(F.trim(x).alias("x"), (i + 1).alias("i"))), lambda s: s["x"] != "")
    pages = placed.select(
        F.xxhash64("chunk_id", "document_id", "content").alias("page"), site.alias("site"), F.coalesce("chunk_index", F.lit(-1)).alias("place"),
        F.regexp_extract(url, r"^(?:\w+:)?(?://[^/?#]*)?([^?#]*)", 1).alias("path"), "chunk_id", lines.alias("l"),
    )
    given = pages.select("page", "site", "place", "path", "chunk_id", F.transform("l", lambda s: F.xxhash64(s["x"])).alias("form"), F.transform("l", lambda s: s["i"]).alias("line"))
    compared = shared_with_nearest(given, ["site", "place", "path", "page"], "chunks")
    found = compared.select("chunk_id", F.explode(F.filter(F.arrays_zip("line", "shared"), lambda s: s["shared"])).alias("s"))
    return found.select("chunk_id", F.col("s.line").alias("line_no")).distinct()
