"""What changed between consecutive full snapshots, from validity intervals (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.operators.ranks import rank_in_buckets

#: Of a manifest document only what the change feed needs, values as text whatever their JSON type; a document that is no JSON lands in `_bad`.
MANIFEST = "struct<generated_at string, files array<struct<path string, content_hash string, size_bytes string>>, _bad string>"
TARGET = ("module", "submodule", "version")


def read_snapshots(manifests: DataFrame) -> DataFrame:
    """The readable deliveries: target columns, key, manifest_hash, generated_at, files.

    A delivery is unreadable when its JSON does not parse, has no files list or no valid generated_at, or when it has no
    manifest_hash; such rows are passed over, so a snapshot survives as long as one of its deliveries is readable. A size that
    is no number is null. Null
    targets are targets of their own. Extra columns are ignored.
    """
    doc = F.from_json("manifest_json", MANIFEST, {"columnNameOfCorruptRecord": "_bad"})
    parsed = manifests.where("manifest_hash is not null").select(*TARGET, F.lower(F.trim("manifest_hash")).alias("key"), "manifest_hash", doc.alias("d"))
    good = parsed.where("d is not null and d._bad is null and d.files is not null").select(
        *TARGET, "key", "manifest_hash", F.expr("try_cast(d.generated_at as timestamp)").alias("generated_at"), F.col("d.files").alias("files")
    )
    return good.where("generated_at is not null")


def number_snapshots(deliveries: DataFrame) -> DataFrame:
    """One row per snapshot: target, key, manifest_hash, generated_at, `ord` (1, 2, ...) in the order of generated_at.

    Of several deliveries of a hash the earliest generated_at counts; ties between snapshots go by manifest_hash. File lists
    stay out of it, so what is sorted are short rows, in cells of a target and a day.
    """
    heads = deliveries.groupBy(*TARGET, "key").agg(F.min(F.struct("generated_at", "manifest_hash")).alias("s"))
    heads = heads.select(*TARGET, "key", "s.manifest_hash", "s.generated_at")
    day = F.date_trunc("day", F.col("generated_at"))
    return rank_in_buckets(heads, TARGET, day, [F.col("generated_at"), F.col("manifest_hash")], "ord")


def intervals(deliveries: DataFrame, numbered: DataFrame) -> DataFrame:
    """Validity intervals: target, path, h, size_bytes, from_ord, to_ord.

    A file listed twice in a snapshot counts once (the smallest hash, should they differ); hashes compare in lower case;
    a null hash is a state of its own; entries without a path are ignored. File rows are hashed once, by target and path,
    which serves the deduplication, the islands and the later windows alike.
    """
    keys = [*TARGET, "path"]
    listed = deliveries.select(*TARGET, "key", F.explode("files").alias("f")).select(
        *TARGET, "key", F.col("f.path").alias("path"), F.coalesce(F.lower("f.content_hash"), F.lit("")).alias("h"), F.expr("try_cast(try_cast(f.size_bytes as decimal(38, 4)) as bigint)").alias("size_bytes")
    )
    heads = numbered.select(*[F.col(c).alias(f"n_{c}") for c in TARGET], F.col("key").alias("n_key"), "ord")
    same = [listed[c].eqNullSafe(heads[f"n_{c}"]) for c in TARGET]
    placed = listed.where("path is not null").join(heads, [*same, listed["key"] == heads["n_key"]], "inner")
    states = placed.repartition(*keys).groupBy(*keys, "ord").agg(F.min(F.struct("h", "size_bytes")).alias("s")).select(*keys, "ord", "s.h", "s.size_bytes")
    island = F.col("ord") - F.row_number().over(Window.partitionBy(*keys, "h").orderBy("ord"))
    return (
        states.withColumn("island", island)
        .groupBy(*keys, "h", "island")
        .agg(F.min("ord").alias("from_ord"), F.max("ord").alias("to_ord"), F.min_by("size_bytes", "ord").alias("size_bytes"))
        .drop("island")
    )


def snapshot_changes(manifests: DataFrame) -> DataFrame:
    """FileChange rows between each readable snapshot and the one before it of the same target.

    Columns: module, submodule, version, manifest_hash (of the later snapshot), path, change_type (added, modified, removed),
    old_hash, new_hash, size_bytes (of the new state; null when removed). The first snapshot of a target has no changes.
    An interval that starts right where another of the same path ended is a modification, any other start after the first
    snapshot an addition; an end before the last snapshot without such a start is a removal.
    """
    deliveries = read_snapshots(manifests)
    numbered = number_snapshots(deliveries)
    spans = intervals(deliveries, numbered)
    by_path = Window.partitionBy(*TARGET, "path").orderBy("from_ord")
    seen = spans.select(
        "*",
        F.lag("to_ord").over(by_path).alias("prev_to"), F.lag("h").over(by_path).alias("prev_h"),
        F.lead("from_ord").over(by_path).alias("next_from"),
    )
    starts = F.when(
        F.col("from_ord") > 1,
        F.struct(
            F.col("from_ord").alias("at"),
            F.when(F.col("prev_to") == F.col("from_ord") - 1, F.lit("modified")).otherwise(F.lit("added")).alias("change_type"),
            F.when(F.col("prev_to") == F.col("from_ord") - 1, F.col("prev_h")).alias("old_hash"),
            F.col("h").alias("new_hash"), F.col("size_bytes").alias("size_bytes"),
        ),
    )
    ends = F.when(
        F.col("next_from").isNull() | (F.col("next_from") > F.col("to_ord") + 1),
        F.struct(
            (F.col("to_ord") + 1).alias("at"), F.lit("removed").alias("change_type"), F.col("h").alias("old_hash"),
            F.lit(None).cast("string").alias("new_hash"), F.lit(None).cast("long").alias("size_bytes"),
        ),
    )
    events = seen.select(*TARGET, "path", F.explode(F.filter(F.array(starts, ends), lambda e: e.isNotNull())).alias("e"))
    events = events.select(*TARGET, "path", "e.*")
    heads = numbered.select(*[F.col(c).alias(f"t_{c}") for c in TARGET], F.col("ord"), "manifest_hash")
    # a removal "at" the snapshot after the last one finds no partner here: the file was simply still there at the end
    same = [events[c].eqNullSafe(heads[f"t_{c}"]) for c in TARGET]
    return events.join(heads, [*same, events["at"] == heads["ord"]], "inner").select(
        *TARGET, "manifest_hash", "path", "change_type",
        F.nullif("old_hash", F.lit("")).alias("old_hash"), F.nullif("new_hash", F.lit("")).alias("new_hash"), "size_bytes",
    )
