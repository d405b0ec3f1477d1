"""Queries on changed data: pending records and snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators.pending import PendingTable, joint_fingerprints
from lorekiln.operators.snapshot_changes import snapshot_changes
from lorekiln.session import fresh_path
from lorekiln.sources.tables import table


def _inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, root, t) for t in ("document_records", "index_log", "sync_history"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    pending = PendingTable(fresh_path(spark, "pending"))
    pending.refresh(*_inputs(spark, root))
    return pending.read(spark).select("id")


def p4_partitions(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, changed): partitions whose fingerprint differs between the catalog without, and with, its failed runs."""
    records, log, history = _inputs(spark, root)
    before = joint_fingerprints(records, log, history.where("status <> 'failed'")).withColumnRenamed("print", "old")
    after = joint_fingerprints(records, log, history)
    return after.join(before, "bucket", "full").select("bucket", (~F.col("print").eqNullSafe(F.col("old"))).alias("changed"))


def p4_rewritten(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, pending) of the buckets that the last completed run changes: a table as of before it, brought up to date."""
    records, log, history = _inputs(spark, root)
    tried = log.select(F.col("run_id").alias("id")).distinct()
    last = history.where("status = 'completed'").join(tried, "id", "left_semi").agg(F.max("id")).first()[0]
    pending = PendingTable(fresh_path(spark, "pending"))
    pending.refresh(records, log.where(F.col("run_id") != last), history.where(F.col("id") != last))
    changed = pending.refresh(records, log, history)
    counts = pending.read(spark).groupBy("bucket").agg(F.count(F.lit(1)).alias("pending"))
    rows = spark.createDataFrame([(b,) for b in changed], "bucket int")
    return rows.join(counts, "bucket", "left").select("bucket", F.coalesce("pending", F.lit(0)).alias("pending"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(table(spark, root, "local_manifest")).select("manifest_hash", "path", "change_type")


def p6_changes(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(table(spark, root, "local_manifest"))


QUERIES = {f.__name__: f for f in (p4_found, p4_partitions, p4_rewritten, p6_found, p6_changes)}

_SNAPSHOTS = """
with readable as (
  select module, submodule, version, manifest_hash, manifest_json, cast(json_extract_string(manifest_json, '$.generated_at') as timestamptz) as generated_at
  from (select * from local_manifest where json_valid(manifest_json))),
snapshots as (select module, submodule, version, manifest_hash, min(generated_at) as generated_at, min(manifest_json) as manifest_json from readable group by all),
numbered as (select *, row_number() over (partition by module, submodule, version order by generated_at, manifest_hash) as ord from (
  select module, submodule, version, manifest_hash, min(generated_at) as generated_at, min(manifest_json) as manifest_json from readable group by 1, 2, 3, 4)),
files as (
  select module, submodule, version, ord, manifest_hash, json_extract_string(f, '$.path') as path, min(lower(json_extract_string(f, '$.content_hash'))) as h
  from (select module, submodule, version, ord, manifest_hash, unnest(cast(json_extract(manifest_json, '$.files') as json[])) as f from numbered)
  group by all),
pairs as (select n.module, n.submodule, n.version, n.ord, n.manifest_hash from numbered n where n.ord > 1),
now as (select * from files where ord > 1),
prev as (select f.module, f.submodule, f.version, p.manifest_hash, f.path, f.h from files f join pairs p
  on f.module is not distinct from p.module and f.submodule is not distinct from p.submodule and f.version is not distinct from p.version and f.ord = p.ord - 1)
"""

_BUCKET = "cast(cast('0x' || substr(md5(coalesce({0}, '')), 1, 15) as bigint) % 64 as int)"
_PENDING = """cur as (select id, synced_at, nullif(lower(trim(content_hash)), '') as h,
    row_number() over (partition by id order by scraped_at desc nulls last, synced_at desc nulls last, lower(content_hash) desc nulls last) as r from document_records),
done as (select distinct id from sync_history where status = 'completed'),
tries as (select document_id, nullif(lower(trim(content_hash)), '') as h,
    row_number() over (partition by document_id order by logged_at desc nulls last, lower(content_hash) desc nulls last) as r
  from index_log where outcome = 'ok' and run_id in (select id from done)),
pending as (select c.id from cur c left join tries t on t.document_id = c.id and t.r = 1
  where c.r = 1 and c.synced_at is not null and (t.h is null or c.h is null or t.h <> c.h))"""

SQL = {
    "p4_partitions": f"""
with runs as (select id, max(case when status = 'completed' then 1 else 0 end) as done, max(case when status = 'completed' and status <> 'failed' then 1 else 0 end) as kept,
    max(case when status <> 'failed' then 1 else 0 end) as there from sync_history group by id),
used as (select distinct {_BUCKET.format("id")} as bucket from document_records union select distinct {_BUCKET.format("document_id")} from index_log),
moved as (select distinct {_BUCKET.format("document_id")} as bucket from index_log l join runs r on r.id = l.run_id where r.there = 0)
select bucket, bucket in (select bucket from moved) as changed from used""",
    "p4_rewritten": f"""
with {_PENDING},
last as (select max(id) as id from sync_history where status = 'completed' and id in (select run_id from index_log)),
moved as (select distinct {_BUCKET.format("document_id")} as bucket from index_log where run_id = (select id from last)),
counts as (select {_BUCKET.format("id")} as bucket, count(*) as pending from pending group by 1)
select bucket, coalesce(pending, 0) as pending from moved left join counts using (bucket)""",
    "p4_found": """
with cur as (select id, synced_at, nullif(lower(trim(content_hash)), '') as h,
    row_number() over (partition by id order by scraped_at desc nulls last, synced_at desc nulls last, lower(content_hash) desc nulls last) as r from document_records),
done as (select distinct id from sync_history where status = 'completed'),
tries as (select document_id, nullif(lower(trim(content_hash)), '') as h,
    row_number() over (partition by document_id order by logged_at desc nulls last, lower(content_hash) desc nulls last) as r
  from index_log where outcome = 'ok' and run_id in (select id from done))
select c.id from cur c left join tries t on t.document_id = c.id and t.r = 1
where c.r = 1 and c.synced_at is not null and (t.h is null or c.h is null or t.h <> c.h)""",
    "p6_found": _SNAPSHOTS + """
select coalesce(n.manifest_hash, p.manifest_hash) as manifest_hash, coalesce(n.path, p.path) as path,
  case when p.path is null then 'added' when n.path is null then 'removed' else 'modified' end as change_type
from now n full join prev p on n.manifest_hash = p.manifest_hash and n.path = p.path
where n.h is distinct from p.h""",
    "p6_changes": _SNAPSHOTS + """,
sized as (
  select manifest_hash, json_extract_string(f, '$.path') as path, lower(json_extract_string(f, '$.content_hash')) as h, min(cast(json_extract(f, '$.size_bytes') as bigint)) as size_bytes
  from (select manifest_hash, unnest(cast(json_extract(manifest_json, '$.files') as json[])) as f from numbered) group by 1, 2, 3),
heads as (select module, submodule, version, manifest_hash from numbered)
select h.module, h.submodule, h.version, h.manifest_hash, coalesce(n.path, p.path) as path,
  case when p.path is null then 'added' when n.path is null then 'removed' else 'modified' end as change_type,
  p.h as old_hash, n.h as new_hash, s.size_bytes
from now n full join prev p on n.manifest_hash = p.manifest_hash and n.path = p.path
join heads h on h.manifest_hash = coalesce(n.manifest_hash, p.manifest_hash)
left join sized s on s.manifest_hash = n.manifest_hash and s.path = n.path and s.h = n.h
where n.h is distinct from p.h""",
}
