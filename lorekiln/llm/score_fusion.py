"""One ranking from several differently scaled scores.

Method: robust standardisation (median and median absolute deviation within the query), logistic squashing of outliers,
weighted geometric mean of the bounded values.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.operators.ranks import rank_in_ranges
from lorekiln.session import settled

#: 1 / 1.4826 makes the deviation comparable with a standard deviation for normally distributed scores.
MAD_SCALE = 1.4826
#: Relative rank error of the sketch that brackets a median is at most 1 / ACCURACY; the bracket is ten times as wide.
ACCURACY = 10_000
BRACKET = 10 / ACCURACY
SCORES = ("dense_score", "sparse_score")


def _clean(c: str) -> Column:
    """NaN counts as missing."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c).cast("double"))


def latest_candidates(candidates: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """One row per query and chunk: that of the latest scored_at (ties: the larger scores). NaN becomes null."""
    state = F.struct("scored_at", *[_clean(s).alias(s) for s in scores])
    return candidates.groupBy("query_id", "chunk_id").agg(F.max(state).alias("s")).select("query_id", "chunk_id", *[F.col(f"s.{s}").alias(s) for s in scores])


def _per_query(df: DataFrame, stats: DataFrame) -> DataFrame:
    s = stats.withColumnRenamed("query_id", "__q")
    return df.join(s, df["query_id"].eqNullSafe(s["__q"]), "left").drop("__q")


def medians(rows: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """(query_id, one column per name): the exact lower median of each value, nulls left out; null where there is none.

    A mergeable sketch brackets the median, rows below the bracket are counted, and of the rows inside, one in 500, equal
    values are folded before the median is picked by its rank. So a query with a third of all rows is pre-aggregated on the
    map side in every step, and its result does not depend on its size or on the order of merging.
    """
    named = rows.select("query_id", *[v.alias(n) for n, v in values.items()])
    around = F.array(F.lit(0.5 - BRACKET), F.lit(0.5 + BRACKET))
    sketch = named.groupBy("query_id").agg(*[F.percentile_approx(n, around, ACCURACY).alias(f"{n}_in") for n in values])
    placed = _per_query(named, sketch)
    below = [F.count_if(F.col(n) < F.col(f"{n}_in")[0]).alias(f"{n}_below") for n in values]
    counts = placed.groupBy("query_id").agg(*[F.count(n).alias(f"{n}_all") for n in values], *below)
    inside = [F.when((F.col(n) >= F.col(f"{n}_in")[0]) & (F.col(n) <= F.col(f"{n}_in")[1]), F.struct(F.lit(n).alias("name"), F.col(n).alias("x"))) for n in values]
    found = placed.select("query_id", F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("s")).groupBy("query_id", "s.name", "s.x").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("query_id", "name").orderBy("x")
    summed = _per_query(found.withColumn("upto", F.sum("k").over(upto)), counts)
    picked = []
    for n in values:
        rank = F.ceil(F.col(f"{n}_all") / 2) - F.col(f"{n}_below")
        here = (F.col("name") == n) & (F.col("upto") >= rank) & (F.col("upto") - F.col("k") < rank)
        picked.append(F.max(F.when(here, F.col("x"))).alias(n))
    return summed.groupBy("query_id").agg(*picked)


def bounded_scores(candidates: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """Latest candidates with `<score>_unit` in [0, 1]: logistic((x - median) / (MAD_SCALE * MAD)) within the query.

    Where the deviation is 0 the mean absolute deviation takes its place; where that is 0 as well, or a value is infinite, a
    value above the median gets 1, one below 0 and the median itself 0.5. A missing score has unit 0, below every other.
    """
    rows = settled(latest_candidates(candidates, scores), "latest")
    rows = _per_query(rows, medians(rows, {f"{s}_mid": F.col(s) for s in scores}))
    finite = lambda c: F.when(F.isnan(c) | (c == float("inf")), F.lit(None)).otherwise(c)
    away = {s: finite(F.abs(F.col(s) - F.col(f"{s}_mid"))) for s in scores}
    rows = settled(rows.withColumns({f"{s}_away": c for s, c in away.items()}), "away")
    mean = rows.groupBy("query_id").agg(*[F.avg(f"{s}_away").alias(f"{s}_aad") for s in scores])
    rows = _per_query(_per_query(rows, medians(rows, {f"{s}_mad": F.col(f"{s}_away") for s in scores})), mean)
    for s in scores:
        scale = F.when(F.col(f"{s}_mad") > 0, F.col(f"{s}_mad") * MAD_SCALE).otherwise(F.col(f"{s}_aad"))
        gap = F.col(s) - F.col(f"{s}_mid")
        z = F.when(scale > 0, gap / scale)
        side = F.when(F.col(s) > F.col(f"{s}_mid"), 1.0).when(F.col(s) < F.col(f"{s}_mid"), 0.0).otherwise(0.5)
        unit = F.when(F.col(s).isNull(), 0.0).when(z.isNull() | F.isnan(z), side).otherwise(1.0 / (1.0 + F.exp(-z)))
        rows = rows.withColumn(f"{s}_unit", unit)
    return rows.select("query_id", "chunk_id", *scores, *[f"{s}_unit" for s in scores])


def fused_score(weights: Mapping[str, float]) -> Column:
    """Weighted geometric mean of the units to 12 places, 0 as soon as one unit with a positive weight is 0."""
    total = float(sum(weights.values()))
    some_zero = F.lit(False)
    logs = F.lit(0.0)
    for s, w in weights.items():
        if w > 0:
            some_zero = some_zero | (F.col(f"{s}_unit") <= 0)
            logs = logs + F.log(F.col(f"{s}_unit")) * (w / total)
    return F.when(some_zero, 0.0).otherwise(F.round(F.exp(logs), 12))


def fuse_scores(candidates: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """query_id, chunk_id, the scores, their units and `fused` in [0, 1]; one row per query and chunk."""
    weights = dict(weights or {s: 1.0 for s in SCORES})
    return bounded_scores(candidates, tuple(weights)).withColumn("fused", fused_score(weights))


def rank_fused(candidates: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """fuse_scores with `rank` 1, 2, ... within the query, ties by chunk_id; a hot query is cut into ranges of that order."""
    return rank_in_ranges(fuse_scores(candidates, weights), ["query_id"], [F.col("fused").desc(), F.col("chunk_id").asc_nulls_last()], "rank")


def kth_highest(rows: DataFrame, column: str, unit: str, name: str, k: int) -> DataFrame:
    """Per query `name`, the k-th highest value of `column`, and `name`_unit with it; null where fewer rows have one.

    Ranks up to k are limited on the map side before the shuffle, so a hot query moves at most k rows a task.
    """
    w = Window.partitionBy("query_id").orderBy(F.col(column).desc(), F.col(unit).desc())
    top = rows.where(F.col(column).isNotNull()).select("query_id", column, unit).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    last = F.col("__r") == k
    return top.groupBy("query_id").agg(F.max(F.when(last, F.col(column))).alias(name), F.max(F.when(last, F.col(unit))).alias(f"{name}_unit"))


def head_candidates(candidates: DataFrame, k: int = 3) -> DataFrame:
    """query_id, chunk_id of candidates that in each score fewer than k candidates of their query exceed.

    Found by the fused ranking: both units of such a candidate reach the k-th highest unit of their score, so its fused
    value reaches the geometric mean of these two. Only rows above that floor (with a slack for rounding) are compared
    exactly, by the raw scores. A candidate with a missing score is no case; queries with fewer than k scores have no floor.
    """
    rows = settled(fuse_scores(candidates), "fused")
    # the unit never falls as the score rises, so the k-th highest unit comes with the k-th highest score
    dense, sparse = (kth_highest(rows, c, f"{c}_unit", n, k) for c, n in (("dense_score", "__d3"), ("sparse_score", "__s3")))
    both = dense.unionByName(sparse, allowMissingColumns=True).groupBy("query_id").agg(*[F.max(c).alias(c) for c in ("__d3", "__d3_unit", "__s3", "__s3_unit")])
    floor = _per_query(rows, both)
    reach = F.sqrt(F.coalesce(F.col("__d3_unit"), F.lit(0.0)) * F.coalesce(F.col("__s3_unit"), F.lit(0.0)))
    likely = floor.where((F.col("fused") >= reach * (1 - 1e-9) - 1e-11) & F.col("dense_score").isNotNull() & F.col("sparse_score").isNotNull())
    exact = (F.col("__d3").isNull() | (F.col("dense_score") >= F.col("__d3"))) & (F.col("__s3").isNull() | (F.col("sparse_score") >= F.col("__s3")))
    return likely.where(exact).select("query_id", "chunk_id")
