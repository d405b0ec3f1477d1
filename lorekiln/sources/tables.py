"""Reading the catalog and corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` below `root`; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan for work that is dear by row: spread over all cores where the files give fewer tasks than there are cores.

    A table of many files or row groups, as any large one is, comes back as it is; a small one in a single row group, which
    no reader can split, is dealt out row by row, since else one core would do all the work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
