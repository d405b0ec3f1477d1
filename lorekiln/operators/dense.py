"""Vector search and sparse weights."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors the cells of an index are fitted on at most: those with the lowest hashes of their id. All vectors are assigned.
FIT_VECTORS = 50_000
#: The share of the cells a search reads: on vectors without clusters, the hardest case, 0.25 finds 72 % of the ten nearest, 0.5 90 %, 0.6 95 %.
PROBED = 0.6


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance in double precision; for unit vectors its order is that of the cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, distance, rank) of the k nearest rows: an exact scan with a top-k in each task. Filters go before it."""
    from lorekiln.operators.lexical import top

    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.round(squared_distance(F.col(column), query), 6).alias("score"))
    return top(rows, k, descending=False).withColumnRenamed("score", "distance")


def prune_weights(weights: DataFrame, most: int = 150) -> DataFrame:
    """The `most` largest weights of each id (id, term, weight); ties by term. A record's terms are bounded by its text."""
    one = weights.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), 1, most).alias("t"))
    return one.select("id", F.explode("t").alias("t")).select("id", "t.term", (-F.col("t.w")).alias("weight"))


def sparse_scores(weights: DataFrame, query: dict[str, float]) -> DataFrame:
    """(id, score): dot product of the weights (id, term, weight) with those of the query; ids without a common term are absent."""
    hit = weights.where(F.col("term").isin(*query))
    worth = F.create_map(*[x for t, w in query.items() for x in (F.lit(t), F.lit(float(w)))])
    return hit.groupBy("id").agg(F.round(F.sum(F.col("weight") * F.try_element_at(worth, F.col("term"))), 6).alias("score"))


@dataclass(frozen=True)
class Cells:
    """Vectors by cell: `path`/vectors has one folder a cell, `centres` the cell centres in the order of their numbers.

    Nearest rows come from the cells next to the query, a fixed share of all, so a search reads that share of the files.
    """

    path: str
    centres: list[list[float]]

    def nearest(self, spark: SparkSession, query: Sequence[float], k: int, probes: int | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
        """(id, distance, rank) of the k nearest rows of the `probes` cells nearest to the query (the share PROBED of all if not given)."""
        gap = lambda c: sum((a - b) ** 2 for a, b in zip(c, query))
        order = sorted(range(len(self.centres)), key=lambda i: (gap(self.centres[i]), i))
        near = order[: probes or max(1, math.ceil(len(order) * PROBED))]
        return nearest(spark.read.parquet(f"{self.path}/vectors").where(F.col("cell").isin(near)), query, k, key, column)


def build_cells(vectors: DataFrame, path: str, cells: int | None = None, key: str = "vec_id", column: str = "embedding") -> Cells:
    """Write the vectors by cell; the cells are fitted by k-means on FIT_VECTORS vectors at most, every vector is assigned.

    Null vectors are left out, as they are in a scan. About the square root of the number of fitted vectors is a good number
    of cells. Repeated rows stay repeated.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(column).isNotNull())
    sample = rows.select(F.col(column).alias("__v"), F.xxhash64(key).alias("__h")).orderBy("__h").limit(FIT_VECTORS)
    fitted = sample.select(array_to_vector(F.col("__v").cast("array<double>")).alias("features")).cache()
    n = fitted.count()
    if n == 0:
        rows.withColumn("cell", F.lit(0)).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        return Cells(path, [])
    model = KMeans(k=max(1, min(n, cells or round(math.sqrt(n)))), seed=7, maxIter=10).fit(fitted)
    fitted.unpersist()
    placed = model.transform(rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))).drop("features").withColumnRenamed("prediction", "cell")
    # a cell is spread over several files where it is large: the key deals its rows out
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    return Cells(path, [[float(x) for x in c] for c in model.clusterCenters()])


def recall(vectors: DataFrame, cells: Cells, every: int = 50, k: int = 10, key: str = "vec_id", column: str = "embedding") -> float:
    """The share of the k nearest rows that the index finds, over the rows whose id is divisible by `every`, against the scan.

    A measuring aid: it runs one scan and one probe a query.
    """
    queries = vectors.where((F.col(key) % every == 0) & F.col(column).isNotNull()).select(column).limit(100).collect()
    hits = total = 0
    for (q,) in queries:
        true = {r["id"] for r in nearest(vectors, q, k, key, column).select("id").collect()}
        hits += len(true & {r["id"] for r in cells.nearest(vectors.sparkSession, q, k, None, key, column).select("id").collect()})
        total += len(true)
    return hits / total if total else 1.0
