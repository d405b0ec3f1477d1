"""Manifests of files: building, hashing, deltas, the manifest cache, snapshot pairs and targets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.functions.version import parse_version


def pack_hash(hashes: Column) -> Column:
    """Hash of the sorted content hashes of a pack, repeats included."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(hashes)), ""), 256)


def build_manifest(files: DataFrame, by: list[str]) -> DataFrame:
    """Per target file_count, total_size_bytes and pack_hash. A target's hashes meet in one task: 64 bytes a file."""
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"), pack_hash(F.col("content_hash")).alias("pack_hash"))


def manifest_hash(document: Column) -> Column:
    """Hash of a manifest struct in one canonical form: its fields as JSON, in the order of the struct, nulls left out."""
    return F.sha2(F.encode(F.to_json(document), "UTF-8"), 256)


def manifest_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change_type, old_hash, new_hash, size_bytes of all paths whose state differs; one full outer join on path.

    Paths are unique on each side. A null hash is a state of its own. An empty old side makes everything `added`.
    """
    o = old.select(F.col("path"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("in_old"))
    n = new.select(F.col("path"), F.col("content_hash").alias("new_hash"), "size_bytes", F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    return o.join(n, "path", "full").select("path", kind.alias("change_type"), "old_hash", "new_hash", "size_bytes").where("change_type is not null")


def delta_counters(delta: DataFrame) -> DataFrame:
    """added, modified, removed, total and the bytes to fetch (a missing size is 0, removals need none)."""
    kind = F.col("change_type")
    return delta.agg(
        F.count_if(kind == "added").alias("added"), F.count_if(kind == "modified").alias("modified"), F.count_if(kind == "removed").alias("removed"),
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(kind != "removed", F.coalesce("size_bytes", F.lit(0)))), F.lit(0)).alias("bytes_to_download"),
    )


def apply_delta(old: DataFrame, delta: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """The manifest after a sync: path, content_hash. Only changes whose path is in `applied` count, the rest stays due."""
    done = delta if applied is None else delta.join(applied.select("path").distinct(), "path", "left_semi")
    kept = old.select("path", "content_hash").join(done.select("path"), "path", "left_anti")
    return kept.unionByName(done.where("change_type <> 'removed'").select("path", F.col("new_hash").alias("content_hash")))


def verify_downloads(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Contents against the hashes listed for their paths: path, success, error."""
    got = files.select("path", F.sha2("content", 256).alias("actual"))
    joined = listing.select("path", "content_hash").join(got, "path", "left")
    error = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.lower("content_hash"), "hash mismatch")
    return joined.select("path", error.isNull().alias("success"), error.alias("error"))


def save_manifests(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest cache with new manifests in place of those of the same target; null submodules are equal."""
    key = ["module", "submodule", "version"]
    one = new.groupBy(*key).agg(F.max(F.struct("fetched_at", "manifest_hash", "manifest_json")).alias("r")).select(*key, "r.manifest_hash", "r.manifest_json", "r.fetched_at")
    return drop_manifests(cache, one).unionByName(one)


def drop_manifests(cache: DataFrame, targets: DataFrame) -> DataFrame:
    key = ["module", "submodule", "version"]
    t = targets.select(*[F.col(c).alias(f"t_{c}") for c in key]).distinct()
    same = [cache[c].eqNullSafe(t[f"t_{c}"]) for c in key]
    return cache.join(t, same, "left_anti")


def upload_status(target: DataFrame, existing: DataFrame, force: bool = False, order: str = "last_modified") -> DataFrame:
    """key, status: `uploaded` for new or changed content (all with force), `skipped` for what is there with the same hash.

    Of several existing rows of a key the first by `order` counts, ties by the smaller hash.
    """
    have = existing.groupBy("key").agg(F.min(F.struct(order, "content_hash")).alias("r")).select("key", F.col("r.content_hash").alias("have"))
    same = F.col("have") == F.col("content_hash")
    return target.join(have, "key", "left").select("key", F.when(F.coalesce(same, F.lit(False)) & F.lit(not force), "skipped").otherwise("uploaded").alias("status"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest file, or no rows where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).option("multiLine", True).json(path) if there else spark.createDataFrame([], schema)


def cached_manifest(cache: DataFrame, module: str, version: str, submodule: str | None = None) -> DataFrame:
    """The newest cached manifest of one target (null-safe submodule): manifest_hash, fetched_at and its parsed head.

    JSON that does not parse gives nulls.
    """
    same = (F.col("module") == module) & F.col("submodule").eqNullSafe(F.lit(submodule)) & (F.col("version") == version)
    doc = F.from_json("manifest_json", "file_count int, total_size_bytes bigint, pack_hash string, generated_at string")
    rows = cache.where(same).orderBy(F.col("fetched_at").desc(), F.col("manifest_hash")).limit(1)
    return rows.select("module", "submodule", "version", "manifest_hash", "fetched_at", doc.alias("d")).select("module", "submodule", "version", "manifest_hash", "fetched_at", "d.file_count", "d.total_size_bytes", "d.pack_hash")


def distinct_objects(listings: Sequence[DataFrame], skip: str = "manifest.json") -> DataFrame:
    """The objects of several listings (key, size_bytes, ...), each key as the first listing that has it gives it; manifests left out."""
    numbered = [df.withColumn("__n", F.lit(i)) for i, df in enumerate(listings)]
    every = reduce(DataFrame.unionByName, numbered)
    columns = [c for c in every.columns if c not in ("key", "__n")]
    one = every.where(~F.col("key").endswith(skip)).groupBy("key").agg(F.min(F.struct("__n", *columns)).alias("r"))
    return one.select("key", *[f"r.{c}" for c in columns])


def freshness(stored: DataFrame, latest: DataFrame) -> DataFrame:
    """scope, token, action: `skip` where the stored token (scope, token) is the latest one, else `refresh`; scopes without a
    latest token are `missing` and keep the stored one."""
    s = stored.select(F.col("scope"), F.col("token").alias("have"))
    n = latest.groupBy("scope").agg(F.max("token").alias("token"))
    action = F.when(F.col("token").isNull(), "missing").when(F.col("token").eqNullSafe(F.col("have")), "skip").otherwise("refresh")
    return n.join(s, "scope", "full").select("scope", F.coalesce("token", "have").alias("token"), action.alias("action"))


SNAPSHOT = r"^(?:(.*)/)?(chroma_db|sqlite_metadata)_(\d{4}_\d{2}_\d{2}(?:_\d{2}_\d{2}_\d{2})?)\.zip$"


def snapshot_objects(objects: DataFrame) -> DataFrame:
    """scope, kind, token, taken_at, key, last_modified of the objects whose key names a snapshot."""
    part = lambda i: F.regexp_extract("key", SNAPSHOT, i)
    rows = objects.where(F.col("key").rlike(SNAPSHOT)).select("key", "last_modified", part(1).alias("scope"), part(2).alias("kind"), part(3).alias("token"))
    taken = F.coalesce(F.try_to_timestamp("token", F.lit("yyyy_MM_dd_HH_mm_ss")), F.try_to_timestamp("token", F.lit("yyyy_MM_dd")))
    return rows.withColumn("taken_at", taken).where("taken_at is not null")


def latest_pair(objects: DataFrame, scopes: list[str]) -> DataFrame:
    """The latest token that every kind of snapshot has, in the first scope that has one: scope, token, kind, key."""
    rank = F.array_position(F.array(*[F.lit(s) for s in scopes]), F.col("scope"))
    rows = snapshot_objects(objects).withColumn("rank", rank).where("rank > 0")
    newest = rows.groupBy("rank", "scope", "token", "taken_at", "kind").agg(F.max(F.struct("last_modified", "key")).alias("o"))
    full = newest.groupBy("rank", "scope", "token", "taken_at").agg(F.count(F.lit(1)).alias("kinds"), F.collect_list(F.struct("kind", F.col("o.key").alias("key"))).alias("parts"))
    best = full.where("kinds = 2").orderBy("rank", F.col("taken_at").desc()).limit(1)
    return best.select("scope", "token", F.inline("parts"))


def sync_targets(keys: DataFrame, modules: list[str]) -> DataFrame:
    """module, submodule, version of all object keys `prefix/version/...`; of the modules that begin a prefix the longest wins."""
    names = keys.sparkSession.createDataFrame([(m,) for m in modules], "name string")
    parts = keys.select(F.split("key", "/").alias("p")).where("size(p) >= 3").select(F.col("p")[0].alias("prefix"), F.col("p")[1].alias("version")).distinct()
    hit = parts.join(F.broadcast(names), (F.col("prefix") == F.col("name")) | F.col("prefix").startswith(F.concat(F.col("name"), F.lit("-"))))  # a short fixed list
    module = hit.groupBy("prefix", "version").agg(F.max_by("name", F.length("name")).alias("module"))
    return module.select("module", F.nullif(F.expr("substring(prefix, length(module) + 2)"), F.lit("")).alias("submodule"), "version")


def latest_wiki_files(files: DataFrame, minors: int = 2) -> DataFrame:
    """Of the files (category, version) the newest patch of each minor, of the newest minors of each category."""
    v = files.select("*", parse_version(F.col("version")).alias("v")).where("v is not null")
    patch = F.row_number().over(Window.partitionBy("category", "v.major", "v.minor").orderBy(F.col("v.patch").desc(), F.col("version")))
    newest = v.withColumn("p", patch).where("p = 1")
    minor = F.row_number().over(Window.partitionBy("category").orderBy(F.col("v.major").desc(), F.col("v.minor").desc()))
    return newest.withColumn("m", minor).where(F.col("m") <= minors).drop("p", "m", "v")
