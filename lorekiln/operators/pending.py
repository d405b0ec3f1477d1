"""Processing only new or changed records: partition fingerprints and atomic replacement of changed partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Buckets of the key space. A state of N rows has N / BUCKETS rows to a partition; choose about one per 100 MB of catalog.
BUCKETS = 64


def _hash_key(c: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def bucket_of(c: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a key: its MD5, of which the first 15 hex digits count, so that other systems find the same one."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(c), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def current_rows(records: DataFrame) -> DataFrame:
    """The row of each id with the latest scraped_at (ties: latest synced_at, then the largest hash). Null ids are ignored."""
    state = F.struct(F.col("scraped_at").alias("scraped_at"), F.col("synced_at").alias("synced_at"), _hash_key("content_hash").alias("content_hash"))
    return records.where("id is not null").groupBy("id").agg(F.max(state).alias("s")).select("id", "s.*")


def completed_hashes(log: DataFrame, history: DataFrame) -> DataFrame:
    """Per document the hash of its latest `ok` attempt in a completed run (document_id, indexed_hash); the hash may be null.

    Rows of the log are pre-aggregated to one per (document, run) before the join, so a document or run with a large
    share of the log costs one row a task. A run counts as completed if any of its rows says so.
    """
    tries = log.where("outcome = 'ok' and document_id is not null").groupBy("document_id", "run_id").agg(
        F.max(F.struct("logged_at", _hash_key("content_hash").alias("h"))).alias("t")
    )
    done = history.where("status = 'completed'").select(F.col("id").alias("run_id")).distinct()
    return tries.join(done, "run_id", "left_semi").groupBy("document_id").agg(F.max("t").alias("t")).select(
        "document_id", F.col("t.h").alias("indexed_hash")
    )


def fingerprints(df: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """(bucket, n, digest): rows and the wrapping sum of row hashes of each key bucket.

    Sums commute, so the order of rows and the layout of files do not matter; repeats change n and digest both.
    The sum is taken over decimal(38) and folded to a long, so it never overflows for fewer than 1e18 rows.
    """
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    hashed = df.select(bucket_of(key, buckets).alias("bucket"), row.cast("decimal(38,0)").alias("h"))
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("h").cast("string").alias("digest"))


def joint_fingerprints(records: DataFrame, log: DataFrame, history: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, print): one string per bucket of record ids, over the records, attempts and run states it depends on.

    Attempts are followed by the status of their run, so a run that turns completed changes the buckets of its documents.
    """
    status = history.groupBy(F.col("id").alias("run_id")).agg(F.max(F.when(F.col("status") == "completed", 1).otherwise(0)).alias("done"))
    # one row per distinct attempt: a hot document or run is pre-aggregated before the join with the run states
    tries = log.groupBy("document_id", "run_id", "outcome", "content_hash", "logged_at").agg(F.count(F.lit(1)).alias("n")).join(status, "run_id", "left")
    a = fingerprints(records, "id", ["id", "scraped_at", "synced_at", "content_hash"], buckets).select("bucket", F.concat_ws(":", F.lit("r"), "n", "digest").alias("p"))
    b = fingerprints(tries, "document_id", ["document_id", "run_id", "outcome", "content_hash", "logged_at", "n", "done"], buckets).select(
        "bucket", F.concat_ws(":", F.lit("l"), "n", "digest").alias("p")
    )
    return a.unionByName(b).groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list("p")), "|").alias("print"))


def pending_records(records: DataFrame, log: DataFrame, history: DataFrame) -> DataFrame:
    """Records whose present content still has to be indexed: id, content_hash, indexed_hash, scraped_at.

    A record is pending when its current row has synced_at and its latest completed `ok` attempt is absent, has no hash, or
    has another hash; letter case and blanks around a hash do not count, an empty hash is none. A record without a
    content hash is pending as long as it is synced, as nothing can show that it was indexed.
    """
    now = current_rows(records).where("synced_at is not null")
    seen = completed_hashes(log, history)
    joined = now.join(seen, now["id"] == seen["document_id"], "left")
    stale = F.col("indexed_hash").isNull() | F.col("content_hash").isNull() | (F.col("indexed_hash") != F.col("content_hash"))
    return joined.where(stale).select("id", "content_hash", "indexed_hash", "scraped_at")


@dataclass(frozen=True)
class PendingTable:
    """A table of pending records that is kept up to date partition by partition.

    `path`/rows holds the pending records by bucket, `path`/prints the fingerprints under which each bucket was computed.
    refresh() compares the fingerprints of the inputs with those kept, recomputes only the buckets that differ, replaces
    these atomically by dynamic partition overwrite and only then records their fingerprints, also by overwrite of the
    same buckets. A run that dies in between leaves old fingerprints, so the next one does the same buckets again and gets
    the same rows: nothing is skipped and nothing is doubled.
    """

    path: str
    buckets: int = BUCKETS

    def _kept(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema("print string, bucket int").parquet(f"{self.path}/prints")
        except AnalysisException:
            return spark.createDataFrame([], "print string, bucket int")

    def changed(self, records: DataFrame, log: DataFrame, history: DataFrame) -> DataFrame:
        """(bucket, print) of the buckets to recompute; print is null for a bucket that has become empty."""
        now = joint_fingerprints(records, log, history, self.buckets)
        kept = self._kept(records.sparkSession).withColumnRenamed("print", "old")
        return now.join(kept, "bucket", "full").where(~F.col("print").eqNullSafe(F.col("old"))).select("bucket", "print")

    def refresh(self, records: DataFrame, log: DataFrame, history: DataFrame) -> list[int]:
        """Bring the table up to date; returns the buckets recomputed, in order (at most `buckets` numbers)."""
        spark = records.sparkSession
        todo = self.changed(records, log, history).collect()  # one short row a bucket
        if not todo:
            return []
        ids = [r["bucket"] for r in todo]
        every = len(ids) == self.buckets
        part = lambda df, key: df if every else df.where(bucket_of(key, self.buckets).isin(ids))
        rows = pending_records(part(records, "id"), part(log, "document_id"), history).withColumn("bucket", bucket_of("id", self.buckets))
        # a bucket without pending rows is replaced too: a marker row keeps the overwrite of its partition
        marks = spark.createDataFrame([(b,) for b in ids], "bucket int").select(
            F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("indexed_hash"),
            F.lit(None).cast(dict(rows.dtypes)["scraped_at"]).alias("scraped_at"), "bucket",
        )
        width = max(1, min(self.buckets, len(ids), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        out = rows.unionByName(marks).repartition(width, "bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        prints = spark.createDataFrame([(r["print"], r["bucket"]) for r in todo], "print string, bucket int")
        prints.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/prints")
        return sorted(ids)

    def read(self, spark: SparkSession) -> DataFrame:
        """The pending records as of the last refresh, with their bucket."""
        return spark.read.parquet(f"{self.path}/rows").where("id is not null")
