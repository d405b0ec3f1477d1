"""Searches end to end: hybrid (keywords and vectors) and native hybrid (vectors re-ranked by sparse weights)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.operators.dense import nearest, sparse_scores
from lorekiln.operators.fusion import finish, fuse, one_per_url, reciprocal, response_status
from lorekiln.operators.lexical import Index, bm25_top
from lorekiln.session import settled


def check_arguments(query: str, top_k: int = 3, version: int | None = None, threshold: float = 0.01) -> None:
    if not 3 <= len(query.strip()) <= 500:
        raise ValueError("a query has 3 to 500 characters")
    if not 1 <= top_k <= 10:
        raise ValueError("top_k lies between 1 and 10")
    if version is not None and not 1 <= version <= 20:
        raise ValueError("a version lies between 1 and 20")
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")


def parse_interactive(line: str) -> tuple[str, dict[str, str]]:
    """A query without its `module=`, `version=` and `submodule=` words, and these; a version that is no number is dropped."""
    words, filters = [], {}
    for w in line.split():
        key, eq, value = w.partition("=")
        if eq and key in ("module", "version", "submodule"):
            if key != "version" or value.isdigit():
                filters[key] = value
        else:
            words.append(w)
    return " ".join(words), filters


def hybrid(
    index: Index, vectors: DataFrame, documents: DataFrame, query: str, vector: Sequence[float], k: int = 3, fetch: int = 20, threshold: float | None = None,
    dedup: bool = True, module: str | None = None, version: int | None = None,
) -> DataFrame:
    """Both retrievers' best `fetch`, fused by reciprocal ranks, one row per url, then the k best.

    `documents` is keyed by id; only its rows of the fused candidates (2 * fetch at most) are joined. A module or version
    filters the vectors before the search and the keyword scores after scoring, whose statistics stay those of the whole
    collection.
    """
    kept = None
    if module is not None or version is not None:
        hit = (F.lit(True) if module is None else F.col("module") == module) & (F.lit(True) if version is None else F.col("version_major") == version)
        kept = documents.where(hit).select("id")
        vectors = vectors.join(kept.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
    found = fuse(nearest(vectors, vector, fetch), bm25_top(index, query, fetch, kept), short=True)
    rows = documents.join(F.broadcast(found), "id", "inner").repartition(1)  # 2 * fetch rows at most
    return finish(one_per_url(rows) if dedup else rows, k, threshold)


@dataclass(frozen=True)
class Response:
    """What a search answers: `items` with their place, and `status`, one row (status, results_found, results_returned, max_score, message)."""

    items: DataFrame
    status: DataFrame


def tool_search(
    index: Index, vectors: DataFrame, documents: DataFrame, query: str, vector: Sequence[float], top_k: int = 3, module: str | None = None, version: int | None = None,
    submodule: str | None = None, threshold: float = 0.01,
) -> Response:
    """A search as users call it: arguments checked, 5 * top_k candidates of a hybrid search, then submodule, threshold and top_k.

    The candidates, 5 * top_k rows, are written once and serve items and status. `below_threshold` also says that the
    submodule filter left nothing. `documents` has id, module, submodule, version_major and url.
    """
    check_arguments(query, top_k, version, threshold)
    wide = settled(hybrid(index, vectors, documents, query, vector, 5 * top_k, 5 * top_k, module=module, version=version), "candidates")
    items = finish(wide.drop("place"), top_k, threshold, submodule)
    status = response_status(wide, items)
    returned = items.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    best, limit = F.format_string("%.4f", "max_score"), F.lit(str(threshold))
    message = (
        F.when(F.col("status") == "success", F.concat(F.lit("Found "), returned.cast("string"), F.lit(" relevant results")))
        .when(F.col("status") == "below_threshold", F.concat(F.lit("Found "), F.col("results_found").cast("string"), F.lit(" results but the best score "), best, F.lit(" is below threshold "), limit, F.lit(" or outside the submodule")))
        .otherwise("No results found")
    )
    return Response(items, status.select("status", "results_found", returned.alias("results_returned"), "max_score", message.alias("message")))


def native_hybrid(vectors: DataFrame, weights: DataFrame, documents: DataFrame, vector: Sequence[float], query: dict[str, float], k: int = 3, fetch: int = 20, dedup: bool = True) -> DataFrame:
    """Vector candidates re-ranked: ranks by dense similarity and by sparse weights are fused; a sparse score of 0 adds nothing."""
    near = nearest(vectors, vector, max(fetch, 2 * k))
    weighed = weights.join(F.broadcast(near.select("id")), "id", "left_semi")
    scored = near.join(sparse_scores(weighed, query).withColumnRenamed("score", "sparse"), "id", "left").fillna(0.0, ["sparse"])
    scored = scored.withColumn("dense", 1.0 / (1.0 + F.greatest(F.col("distance"), F.lit(0.0))))
    ranked = scored.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.col("dense").desc(), "rank")))
    ranked = ranked.withColumn("by_sparse", F.row_number().over(Window.orderBy(F.col("sparse").desc(), "dense_rank")))
    hit = F.col("sparse") > 0
    score = reciprocal(F.col("dense_rank")) + F.when(hit, reciprocal(F.col("by_sparse"))).otherwise(0.0)
    rows = ranked.select("id", F.round(score, 9).alias("score"), "dense_rank", F.when(hit, F.col("by_sparse")).alias("sparse_rank"))
    joined = documents.join(F.broadcast(rows), "id", "inner").repartition(1)  # fetch rows at most
    return finish(one_per_url(joined) if dedup else joined, k)


def unknown_module(chunks: DataFrame, module: str) -> bool:
    """Whether some modules are indexed and the given one is not."""
    return not chunks.isEmpty() and chunks.where(F.col("module") == module).isEmpty()


def unknown_modules(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(module, unknown) of the modules asked for: none is unknown as long as no module is indexed at all."""
    known = chunks.where("module is not null").select("module").distinct().withColumn("__known", F.lit(True))
    some = known.agg(F.count(F.lit(1)) > 0).scalar()
    return asked.join(known, "module", "left").select("module", (F.col("__known").isNull() & some).alias("unknown"))


def format_text(most: int = 500):
    """A result as plain text: place, title, score, address and the content, cut after `most` characters."""
    content = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    return F.concat(
        F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.format_string("%.4f", "score"), F.lit(")\n"),
        F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")),
    )
