"""Activating a prepared snapshot: swap of directories with a way back, and checks of what an archive holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest archive that is unpacked.
MAX_MEMBERS, MAX_BYTES = 200_000, 10 * 1024**3


def activate(spark: SparkSession, staged: str, target: str) -> None:
    """Put the folder `staged` in the place of `target`; what was there returns if the swap fails half way.

    Both lie on the same Hadoop file system, so each step is a rename. A missing staging folder changes nothing.
    """
    jvm = spark.sparkContext._jvm
    new, now, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, target, target.rstrip("/") + ".before"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(new):
        raise FileNotFoundError(staged)
    fs.delete(old, True)
    kept = fs.exists(now) and fs.rename(now, old)
    if not fs.rename(new, now):
        if kept:
            fs.rename(old, now)
        raise OSError(f"{staged} could not be activated")
    fs.delete(old, True)


def member_problem(name: Column, is_link: Column) -> Column:
    """Why an archive member may not be unpacked: absolute, climbing out, a link; null where it may."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "no name")
        .when(name.rlike(r"^[/\\]|^[A-Za-z]:"), "absolute path")
        .when(name.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "leaves the root")
        .when(F.coalesce(is_link, F.lit(False)), "link")
    )


def archive_verdict(members: DataFrame) -> DataFrame:
    """One row (members, bytes, problems, safe) over the members (name, size_bytes, is_link) of an archive."""
    a = members.agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count(member_problem(F.col("name"), F.col("is_link"))).alias("problems")
    )
    return a.withColumn("safe", (F.col("problems") == 0) & (F.col("members") <= MAX_MEMBERS) & (F.col("bytes") <= MAX_BYTES))
