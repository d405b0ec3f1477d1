"""The catalog of documents and its sync history: merges, flags, look-ups, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions.text import short_id, sha256_hex
from lorekiln.operators.embedding import delete_vectors

#: Columns that a known document takes over from a new delivery; module, version and url keep their first value.
TAKEN_OVER = ("title", "content_hash", "file_path", "s3_key", "size_bytes", "scraped_at", "synced_at", "schema_version")


def duplicate_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that an insert may not bring: those already there and those given more than once."""
    twice = new.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    return new.select("id").join(existing.select("id"), "id", "left_semi").unionByName(twice).distinct()


def upsert(existing: DataFrame, new: DataFrame, update_keys: bool = False) -> DataFrame:
    """Merge by id. A known document takes TAKEN_OVER (with update_keys all columns) and loses is_indexed when its hash changes.

    Of several new rows of an id the latest scraped_at wins. One full outer join on id; rows that only one side has pass
    through. Hashes compare exactly; a null hash differs from any other.
    """
    state = F.struct("scraped_at", *[c for c in existing.columns if c not in ("id", "scraped_at")])
    fresh = new.groupBy("id").agg(F.max(state).alias("n")).withColumnRenamed("id", "new_id")
    both = existing.join(fresh, existing["id"] == fresh["new_id"], "full")
    known, given = F.col("id").isNotNull(), F.col("new_id").isNotNull()
    out = []
    for c in existing.columns:
        old, neu = F.col(c), F.col("new_id") if c == "id" else F.col(f"n.{c}")
        if c == "id":
            value = F.coalesce(old, neu)
        elif c == "is_indexed":
            value = F.when(~known, neu).when(given & ~F.col("content_hash").eqNullSafe(F.col("n.content_hash")), False).otherwise(old)
        elif update_keys or c in TAKEN_OVER:
            value = F.when(given, neu).otherwise(old)
        else:
            value = F.when(known, old).otherwise(neu)
        out.append(value.alias(c))
    return both.select(*out)


def page_records(pages: DataFrame) -> DataFrame:
    """Catalog fields of scraped pages (url, markdown): id, content_hash and the size in bytes of the UTF-8 text."""
    return pages.select("*", short_id(F.col("url")).alias("id"), sha256_hex(F.col("markdown")).alias("content_hash"), F.octet_length("markdown").cast("long").alias("size_bytes"))


def set_flag(records: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    """Set a column of the rows whose id is in `ids`; a semi join by shuffle or broadcast as the sizes suggest."""
    marks = ids.select(F.col("id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    joined = records.join(marks, records["id"] == marks["__id"], "left")
    return joined.select(*[F.when(F.col("__hit"), value).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in records.columns])


def scope(module: str | None, major: int | None = None, submodule: str | None = None) -> Column:
    """Rows of a module, a major version and a submodule. The submodule counts only with a module, and a module without one
    means the rows that have none."""
    cond = F.lit(True)
    if module is not None:
        cond = cond & (F.col("module") == module) & F.col("submodule").eqNullSafe(F.lit(submodule))
    if major is not None:
        cond = cond & (F.col("major_version") == major)
    return cond


def reset_indexed(records: DataFrame, module: str | None = None, major: int | None = None, submodule: str | None = None) -> DataFrame:
    hit = F.coalesce(scope(module, major, submodule), F.lit(False))
    return records.withColumn("is_indexed", F.when(hit, False).otherwise(F.col("is_indexed")))


def delete(records: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    return records.join(keys.select(on).distinct(), on, "left_anti").select(*records.columns)


def unindexed(records: DataFrame, limit: int) -> DataFrame:
    """The next batch to index: synced, not indexed, latest synced_at first; ties by id."""
    return records.where("not is_indexed and synced_at is not null").orderBy(F.col("synced_at").desc(), "id").limit(limit)


def by_version(records: DataFrame, module: str, major: int, minor: int | None = None, patch: int | None = None, submodule: str | None = None) -> DataFrame:
    cond = scope(module, major, submodule)
    if minor is not None:
        cond = cond & (F.col("minor_version") == minor)
    if patch is not None:
        cond = cond & (F.col("patch_version") == patch)
    order = ["file_path"] if minor is not None and patch is not None else [F.col("minor_version").desc(), F.col("patch_version").desc(), "file_path"]
    return records.where(cond).orderBy(*order, "id")


def version_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("module", "submodule", "major_version", "minor_version", "patch_version").agg(F.count(F.lit(1)).alias("documents"))


def collection_status(chunks: DataFrame) -> DataFrame:
    """Per module its versions and submodules in order, as text, and its number of chunks; no module is `unknown`, no version 0."""
    module = F.coalesce(F.nullif("module", F.lit("")), F.lit("unknown")).alias("module")
    sets = chunks.groupBy(module).agg(
        F.array_sort(F.collect_set(F.coalesce("version_major", F.lit(0)))).alias("v"),
        F.array_sort(F.collect_set(F.nullif("submodule", F.lit("")))).alias("s"),
        F.count(F.lit(1)).alias("chunks"),
    )
    return sets.select("module", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("versions"), F.array_join("s", ",").alias("submodules"), "chunks")


def latest_sync(history: DataFrame) -> DataFrame:
    """The latest run of each target, by started_at; ties by id. max_by, so a busy target is pre-aggregated."""
    row = F.struct("started_at", "id", "status", "completed_at", "files_added", "files_modified", "files_removed")
    return history.groupBy("module", "submodule").agg(F.max(row).alias("r")).select("module", "submodule", "r.*")


def sync_history(history: DataFrame, module: str | None = None, submodule: str | None = None, limit: int = 50) -> DataFrame:
    return history.distinct().where(scope(module, None, submodule)).orderBy(F.col("started_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def finish_run(history: DataFrame, run_id: int, at: Column, error: str | None = None, **counts: int) -> DataFrame:
    """The history with a run completed, or failed with a message; counts overwrite the run's own."""
    here = F.col("id") == run_id
    changed = {"status": F.lit("completed" if error is None else "failed"), "completed_at": at, "error_message": F.lit(error).cast("string"), **{k: F.lit(v).cast("int") for k, v in counts.items()}}
    return history.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in changed.items()})


def sync_summary(history: DataFrame) -> DataFrame:
    """One row: targets, completed and failed runs, files added, modified and removed, runs with an error message."""
    runs = history.distinct()
    done = F.col("status") == "completed"
    return runs.agg(
        F.count_distinct(F.struct("module", F.coalesce("submodule", F.lit("")))).alias("targets"),
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.when(done, F.col("files_added"))).alias("added"), F.sum(F.when(done, F.col("files_modified"))).alias("modified"),
        F.sum(F.when(done, F.col("files_removed"))).alias("removed"),
        F.count_if(F.coalesce("error_message", F.lit("")) != "").alias("errors"),
    )


def sync_errors(history: DataFrame) -> DataFrame:
    """(started_at, id, error_message): the error messages of all runs, oldest first; null and empty ones are none."""
    return history.distinct().where(F.coalesce("error_message", F.lit("")) != "").select("started_at", "id", "error_message").orderBy(F.col("started_at").asc_nulls_first(), "id")


def start_run(history: DataFrame, run_id: int, module: str, version: str, at: Column, submodule: str | None = None) -> DataFrame:
    """The history with a run in progress added; an id that is taken is refused."""
    if not history.where(F.col("id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} is there already")
    row = history.sparkSession.range(1).select(
        F.lit(run_id).cast("long").alias("id"), F.lit(module).alias("module"), F.lit(submodule).cast("string").alias("submodule"), F.lit(version).alias("version"),
        F.lit("in_progress").alias("status"), at.cast("timestamp_ntz" if dict(history.dtypes)["started_at"] == "timestamp_ntz" else "timestamp").alias("started_at"),
    )
    return history.unionByName(row, allowMissingColumns=True)


def reindex(records: DataFrame, vectors: DataFrame, module: str | None = None, major: int | None = None, submodule: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with their flags reset and vectors without the same scope: what a fresh indexing run starts from.

    A module without a submodule means the records that have none (null) and the vectors whose submodule is empty.
    """
    return reset_indexed(records, module, major, submodule), delete_vectors(vectors, module=module, major=major, submodule=submodule)


def missing_tables(present: Sequence[str], required: Sequence[str]) -> list[str]:
    """The required tables that are not there, sorted."""
    return sorted(set(required) - set(present))


def batch_counts(results: DataFrame, status: str = "status") -> DataFrame:
    """(success, skipped, failed, total) of a batch of results."""
    one = lambda s: F.count_if(F.col(status) == s).alias(s)
    return results.agg(one("success"), one("skipped"), one("failed"), F.count(F.lit(1)).alias("total"))


def with_metadata(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Records (id, title, submodule, scraped_at, ...) completed by the metadata of their page: title and submodule of the
    metadata come first unless empty, scraped_at of the metadata first unless null. A record without metadata stays."""
    m = metadata.select(F.col("id").alias("__id"), F.nullif("title", F.lit("")).alias("__title"), F.nullif("submodule", F.lit("")).alias("__submodule"), F.col("scraped_at").alias("__at"))
    joined = records.join(m, records["id"] == m["__id"], "left")
    given = {"title": "__title", "submodule": "__submodule", "scraped_at": "__at"}
    return joined.select(*[F.coalesce(given[c], c).alias(c) if c in given else F.col(c) for c in records.columns])


def status_report(records: DataFrame, history: DataFrame) -> DataFrame:
    """Per module, submodule and major version: documents, indexed ones and the latest run of the module and submodule.

    Null submodules meet null submodules.
    """
    docs = records.groupBy("module", "submodule", "major_version").agg(F.count(F.lit(1)).alias("documents"), F.count_if("is_indexed").alias("indexed"))
    runs = latest_sync(history).select(F.col("module").alias("m"), F.col("submodule").alias("s"), F.col("status").alias("last_status"), F.col("started_at").alias("last_started"))
    joined = docs.join(runs, (docs["module"] == runs["m"]) & docs["submodule"].eqNullSafe(runs["s"]), "left")
    return joined.select("module", "submodule", "major_version", "documents", "indexed", "last_status", "last_started")


def validate(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows with `violations`, the names of the rules that are not true for them (null counts as broken)."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())]
    return records.withColumn("violations", F.filter(F.array(*broken), lambda v: v.isNotNull()))


def add_missing_columns(table: DataFrame, target: DataFrame) -> DataFrame:
    """A table of an older schema in the columns of a newer one; what it lacks is null."""
    return target.limit(0).unionByName(table, allowMissingColumns=True).select(*target.columns)


def window_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rn", rn).where("__rn = 1").drop("__rn")
