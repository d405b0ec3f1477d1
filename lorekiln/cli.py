"""Command line over folders of tables: index, search, status, delta, chunk, ingest.

    python -m lorekiln.cli index ROOT OUT          inverted index and vectors of ROOT/documents.parquet
    python -m lorekiln.cli search ROOT INDEX TEXT  results of a search, as lines, JSON or a prompt
    python -m lorekiln.cli status ROOT             catalog, runs and indexed modules
    python -m lorekiln.cli delta OLD NEW           changes between two manifests (path, content_hash, size_bytes)
    python -m lorekiln.cli chunk ROOT OUT          chunks of ROOT/documents.parquet
    python -m lorekiln.cli ingest FOLDER OUT       wiki pages of a folder, newest versions, tagged
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators import catalog, chunking, fusion, lexical, manifests, search, wiki
from lorekiln.operators.embedding import embed, hashing_strategy
from lorekiln.session import build_session, ready, release
from lorekiln.sources.tables import spread, table

DIMENSIONS = 64


def _documents(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        F.col("doc_id").alias("id"), empty("title"), empty("url"), F.coalesce("module", F.lit("unknown")).alias("module"), F.col("content_type").alias("submodule"),
        F.month("fetched_at").alias("version_major"), F.lit(0).alias("version_minor"), F.lit("").alias("section_path"), F.coalesce("text", F.lit("")).alias("content"),
    )


def index(spark: SparkSession, root: str, out: str) -> None:
    """Write the keyword index and the vectors of all documents below `out`, in place of what is there."""
    rows = spread(table(spark, root, "documents").select("doc_id", "text"))
    lexical.build_index(rows, "doc_id", "text").write(f"{out}/index")
    embed(rows, "doc_id", "text", hashing_strategy(DIMENSIONS)).withColumnRenamed("doc_id", "vec_id").write.mode("overwrite").parquet(f"{out}/vectors")


def search_docs(spark: SparkSession, root: str, out: str, query: str, **arguments) -> dict:
    """A search over a written index as a dictionary: status, counts, message and results; errors are a status, not raised."""
    given = {"query": query, "filters": {k: v for k, v in arguments.items() if k in ("module", "version", "submodule") and v is not None}}
    try:
        vector = hashing_strategy(DIMENSIONS)()([query])[0]
        found = search.tool_search(lexical.read_index(spark, f"{out}/index"), spark.read.parquet(f"{out}/vectors"), _documents(spark, root), query, vector, **arguments)
        rows = found.items.withColumns({"item": fusion.render_item(), "breakdown": fusion.score_breakdown()}).orderBy("place").collect()  # 10 rows at most
        results = [{"rank": r.place, "id": r.id, "title": r.title, "url": r.url, "score": r.score, "breakdown": r.breakdown, "content": r.item} for r in rows]
        return {**given, **found.status.first().asDict(), "results": results}
    except Exception as failure:  # noqa: BLE001  whatever fails is told to the caller
        return {**given, "status": "error", "message": f"Search failed: {failure}", "results_found": 0, "results_returned": 0, "results": []}


def prompt(spark: SparkSession, root: str, out: str, query: str, top_k: int = 3) -> str:
    vector = hashing_strategy(DIMENSIONS)()([query])[0]
    rows = search.hybrid(lexical.read_index(spark, f"{out}/index"), spark.read.parquet(f"{out}/vectors"), _documents(spark, root), query, vector, top_k)
    return fusion.prompt(rows, query).first()["prompt"]


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, content_type, version, markdown, error) of the wiki pages of a folder, the newest patch of the newest minors of
    each type, cleaned and tagged. A page that cannot be used has an error instead of a text; the others are not touched by it."""
    from lorekiln.functions import text as T

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    named = files.select(F.regexp_replace(F.input_file_name(), r"^file:/+", "/").alias("path"), "value")
    name = F.element_at(F.split("path", "/"), -1)
    rows = named.select("path", "value", T.wiki_content_type(name).alias("content_type"), T.wiki_version(name).alias("version"), T.first_heading(F.col("value"), name).alias("title"))
    kept = manifests.latest_wiki_files(rows.where("version is not null").select("path", F.col("content_type").alias("category"), "version")).select("path")
    error = F.when(F.col("version").isNull(), "no version").when(F.trim("value") == "", "empty page")
    tagged = wiki.tag_sections(T.clean_wiki_noise(F.col("value")), F.col("content_type"), F.col("version"))
    usable = rows.join(kept, "path", "left_semi").unionByName(rows.where("version is null"))
    return usable.select("path", "title", "content_type", "version", F.when(error.isNull(), tagged).alias("markdown"), error.alias("error"))


def main(given: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lorekiln", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("index", ("root", "out")), ("search", ("root", "out", "text")), ("status", ("root",)), ("delta", ("old", "new")), ("chunk", ("root", "out")), ("ingest", ("folder", "out"))):
        one = commands.add_parser(name)
        for p in places:
            one.add_argument(p)
        if name == "search":
            for option, kind, default in (("--module", str, None), ("--version", int, None), ("--submodule", str, None), ("--top-k", int, 3), ("--threshold", float, 0.01)):
                one.add_argument(option, type=kind, default=default)
            one.add_argument("--json", action="store_true")
            one.add_argument("--prompt", action="store_true")
        if name == "chunk":
            one.add_argument("--tier", choices=sorted(chunking.TIERS), default="slim")
    a = parser.parse_args(given)
    spark = ready(spark or build_session())
    if a.command == "index":
        index(spark, a.root, a.out)
    elif a.command == "search" and a.prompt:
        print(prompt(spark, a.root, a.out, a.text, a.top_k))
    elif a.command == "search":
        found = search_docs(spark, a.root, a.out, a.text, top_k=a.top_k, module=a.module, version=a.version, submodule=a.submodule, threshold=a.threshold)
        print(json.dumps(found, ensure_ascii=False, indent=2) if a.json else "\n".join([found["message"] or found["status"], *(f"[{r['rank']}] {r['title']} ({r['score']:.4f}) {r['url']}" for r in found["results"])]))
        return 0 if found["status"] != "error" else 1
    elif a.command == "status":
        catalog.status_report(table(spark, a.root, "document_records"), table(spark, a.root, "sync_history")).orderBy("module", "submodule", "major_version").show(1000, False)
        catalog.collection_status(table(spark, a.root, "chunks")).orderBy("module").show(1000, False)
    elif a.command == "delta":
        delta = manifests.manifest_delta(spark.read.json(a.old), spark.read.json(a.new))
        delta.orderBy("path").show(1000, False)
        manifests.delta_counters(delta).show()
    elif a.command == "chunk":
        rows = table(spark, a.root, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("markdown"))
        chunking.chunk_markdown(spread(rows), a.tier).write.mode("overwrite").parquet(a.out)
    else:
        ingest(spark, a.folder).write.mode("overwrite").parquet(a.out)
    release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
