"""New or changed records to chunks, as a stream over arriving files (an addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators.chunking import chunk_markdown


def stream_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, tier: str = "slim", order: str | None = None) -> None:
    """Chunk all records (document_id, markdown, ...) that have arrived below `source` since the last run, then stop.

    Of several records of a document in a batch the one with the largest `order` counts (a column such as scraped_at), or
    where none is named the one whose file arrived last; ties: the larger text. A document without chunks, as its text is
    null, empty or blank, leaves a row without content that ends its older chunks. Each micro-batch replaces the partitions
    of its own id in `target`, so a batch that is run again after a failure overwrites what it had written. The checkpoint
    keeps what was read; nothing is skipped or read twice.
    """
    arrived = F.col("__at") if order is None else F.col(order)

    def write(batch: DataFrame, number: int) -> None:
        newest = F.max_by("markdown", F.struct(arrived.alias("at"), F.coalesce("markdown", F.lit("")).alias("m")))
        rows = batch.where("document_id is not null").groupBy("document_id").agg(newest.alias("markdown"))
        chunks = chunk_markdown(rows, tier)
        ended = rows.select("document_id").join(chunks.select("document_id").distinct(), "document_id", "left_anti")
        out = chunks.unionByName(ended, allowMissingColumns=True).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    if order is None:
        stream = stream.withColumn("__at", F.col("_metadata.file_modification_time"))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document as of the last batch that brought it; none for a document that came without a text."""
    rows = spark.read.parquet(target)
    last = rows.groupBy(F.col("document_id").alias("d")).agg(F.max("batch").alias("b"))
    return rows.join(last, (rows["document_id"] == last["d"]) & (rows["batch"] == last["b"]), "left_semi").where("content is not null")
