"""Keyword search: an inverted index as tables and BM25 over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import tokens

# The usual parameters of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Index:
    """postings(term, id, tf, dl), lengths(id, dl) and terms(term, df, idf); `avgdl` and `documents` are one number each."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    documents: int
    avgdl: float

    def write(self, path: str) -> None:
        """Postings sorted by term within files, so that a query reads the row groups of its terms only."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")


def read_index(spark, path: str) -> Index:
    lengths = spark.read.parquet(f"{path}/lengths")
    n, avg = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    return Index(spark.read.parquet(f"{path}/postings"), lengths, spark.read.parquet(f"{path}/terms"), n, avg or 0.0)


def inverse_frequency(df: Column, n: int) -> Column:
    """ln(N - df + 1/2) - ln(df + 1/2), negative for a term in more than half of the documents."""
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


def term_statistics(postings: DataFrame, n: int) -> DataFrame:
    """(term, df, idf); a negative idf is replaced by EPSILON times the mean of all, taken before the replacement."""
    raw = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("raw", inverse_frequency(F.col("df"), n))
    mean = raw.agg(F.avg("raw").alias("m")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, mean * EPSILON).otherwise(F.col("raw")).alias("idf"))


def build_index(documents: DataFrame, key: str, text: str) -> Index:
    """The index of all documents; a null or tokenless text has length 0 and counts in the average. Keys are unique."""
    words = documents.select(F.col(key).alias("id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("w"))
    lengths = words.select("id", F.size("w").alias("dl"))
    # explode_outer keeps the optimizer from evaluating the pattern a second time in a filter on the size of its result
    exploded = words.select("id", F.size("w").alias("dl"), F.explode_outer("w").alias("term")).where("term is not null")
    postings = exploded.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    n, avg = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    return Index(postings, lengths, term_statistics(postings, n), n, avg or 0.0)


def query_terms(query: str) -> dict[str, int]:
    """Terms of a query with their number: a term given twice counts twice."""
    import re

    out: dict[str, int] = {}
    for t in re.findall(r"\w+", query.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def _matching(index: Index, query: str) -> tuple[DataFrame, bool]:
    """(id, score) of the documents with a term of the query, and whether a term counts against a document.

    Only the postings of the query's terms are read. Their idf, one number a term from the whole collection, is fetched
    first, so nothing is joined.
    """
    terms = query_terms(query)
    known = {r["term"]: r["idf"] for r in index.terms.where(F.col("term").isin(*terms)).collect()} if terms else {}  # a row a term
    if not known:
        return index.lengths.limit(0).select("id", F.lit(0.0).alias("score")), False
    weight = F.create_map(*[x for t, v in known.items() for x in (F.lit(t), F.lit(v * terms[t]))])
    tf, dl = F.col("tf"), F.col("dl")
    part = F.try_element_at(weight, F.col("term")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (index.avgdl or 1.0)))
    found = index.postings.where(F.col("term").isin(*known)).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return found, min(known.values()) < 0


def bm25_scores(index: Index, query: str) -> DataFrame:
    """(id, score) of every document, 0 without a term of the query, rounded to 6 places so that equal texts tie."""
    found, _ = _matching(index, query)
    return index.lengths.select("id").join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_top(index: Index, query: str, k: int, ids: DataFrame | None = None) -> DataFrame:
    """(id, score, rank): the k best of bm25_scores, of the documents in `ids` (unique) only if given; ties by id.

    The statistics stay those of the whole collection. Documents without a term fill the list in the order of their ids: the
    2 k smallest ids hold enough of them, so the collection is not joined. Only where a term counts against a document,
    which needs a term in most of a very small collection, all scores are compared.
    """
    found, against = _matching(index, query)
    every = (index.lengths if ids is None else ids).select("id")
    if against:
        scored = every.join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
        return top(scored, k)
    best = top(found if ids is None else found.join(every, "id", "left_semi"), k).select("id", "score")
    fill = every.orderBy("id").limit(2 * k).join(F.broadcast(best.select("id")), "id", "left_anti").select("id", F.lit(0.0).alias("score"))
    return top(best.unionByName(fill), k)


def top(scores: DataFrame, k: int, descending: bool = True, name: str = "rank") -> DataFrame:
    """The k best rows (ties by id) with their place; a top-k in each task, then one of k rows a task."""
    from pyspark.sql import Window

    order = [F.col("score").desc() if descending else F.col("score").asc(), F.col("id").asc()]
    best = scores.orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)))
