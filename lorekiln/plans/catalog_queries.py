"""Queries over the catalog, the sync history and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.functions import url as U
from lorekiln.functions import version as V
from lorekiln.operators import catalog as C
from lorekiln.operators import manifests as M
from lorekiln.operators import pending as P
from lorekiln.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# The current row of each record; the same choice as operators.pending.current_rows, with all columns.
_CURRENT = """cur as (select * exclude (r) from (select *, row_number() over (partition by id order by scraped_at desc nulls last, synced_at desc nulls last, lower(content_hash) desc nulls last) as r
  from document_records) where r = 1)"""


def current(spark: SparkSession, root: str) -> DataFrame:
    order = [F.col("scraped_at").desc_nulls_last(), F.col("synced_at").desc_nulls_last(), F.lower("content_hash").desc_nulls_last()]
    return C.window_first(table(spark, root, "document_records"), ["id"], order)


@query(f"with {_CURRENT} select id, content_hash, synced_at from cur")
def current_records(spark: SparkSession, root: str) -> DataFrame:
    return current(spark, root).select("id", "content_hash", "synced_at")


@query("""with old as (select * exclude (r) from (select *, row_number() over (partition by id order by scraped_at, content_hash, synced_at nulls first) as r from document_records) where r = 1),
new as (select * exclude (r) from (select *, row_number() over (partition by id order by scraped_at desc, url desc nulls last, title desc nulls last) as r from document_records where scraped_at >= timestamp '2025-06-01') where r = 1)
select coalesce(o.id, n.id) as id, case when n.id is not null then n.title else o.title end as title, case when n.id is not null then n.content_hash else o.content_hash end as content_hash,
  case when o.id is not null then o.patch_version else n.patch_version end as patch_version,
  case when o.id is null then n.is_indexed when n.id is not null and o.content_hash is distinct from n.content_hash then false else o.is_indexed end as is_indexed
from old o full join new n on o.id = n.id""")
def catalog_upsert(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "document_records")
    old = C.window_first(rows, ["id"], [F.col("scraped_at"), F.col("content_hash"), F.col("synced_at").asc_nulls_first()])
    new = C.window_first(rows.where("scraped_at >= timestamp '2025-06-01'"), ["id"], [F.col("scraped_at").desc(), F.col("url").desc_nulls_last(), F.col("title").desc_nulls_last()])
    return C.upsert(old, new).select("id", "title", "content_hash", "patch_version", "is_indexed")


@query("select id from document_records group by id having count(*) > 1")
def insert_conflicts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "document_records")
    return C.duplicate_ids(rows.limit(0), rows)


@query(f"""with {_CURRENT}, ok as (select distinct document_id from index_log where outcome = 'ok')
select id, case when ok.document_id is not null then true else is_indexed end as is_indexed from cur left join ok on ok.document_id = cur.id""")
def mark_indexed(spark: SparkSession, root: str) -> DataFrame:
    ids = table(spark, root, "index_log").where("outcome = 'ok'").select(F.col("document_id").alias("id"))
    return C.set_flag(current(spark, root), ids, "is_indexed", F.lit(True)).select("id", "is_indexed")


@query(f"""with {_CURRENT}, run as (select distinct document_id from index_log where outcome = 'ok')
select id, case when run.document_id is not null and synced_at is null then scraped_at else synced_at end as synced_at from cur left join run on run.document_id = cur.id""")
def mark_synced(spark: SparkSession, root: str) -> DataFrame:
    ids = table(spark, root, "index_log").where("outcome = 'ok'").select(F.col("document_id").alias("id"))
    return C.set_flag(current(spark, root), ids, "synced_at", F.coalesce("synced_at", "scraped_at")).select("id", "synced_at")


@query(f"""with {_CURRENT} select id, case when module = 'spring-boot' and submodule is null and major_version = 4 then false else is_indexed end as is_indexed from cur""")
def reset_indexed(spark: SparkSession, root: str) -> DataFrame:
    return C.reset_indexed(current(spark, root), "spring-boot", 4).select("id", "is_indexed")


@query(f"with {_CURRENT} select id, s3_key from cur where id not in (select document_id from index_log where outcome = 'error' and document_id is not null)")
def delete_docs(spark: SparkSession, root: str) -> DataFrame:
    gone = table(spark, root, "index_log").where("outcome = 'error'").select(F.col("document_id").alias("id"))
    return C.delete(current(spark, root), gone).select("id", "s3_key")


@query(f"with {_CURRENT} select id, synced_at from cur where not is_indexed and synced_at is not null order by synced_at desc, id limit 100")
def unindexed_batch(spark: SparkSession, root: str) -> DataFrame:
    return C.unindexed(current(spark, root), 100).select("id", "synced_at")


@query(f"""with {_CURRENT} select id, minor_version, patch_version, file_path from cur where module = 'spring-cloud' and submodule is null and major_version = 4""")
def docs_by_version(spark: SparkSession, root: str) -> DataFrame:
    return C.by_version(current(spark, root), "spring-cloud", 4).select("id", "minor_version", "patch_version", "file_path")


@query(f"""with {_CURRENT} select s3_key, content_hash from cur where module = 'spring-boot' and submodule is null and major_version = 4 and minor_version = 0 and patch_version = 0""")
def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    return C.by_version(current(spark, root), "spring-boot", 4, 0, 0).select("s3_key", "content_hash")


@query(f"with {_CURRENT}, k as (select max(url) as url from cur) select id, cur.url, title from cur join k on cur.url = k.url")
def point_lookup(spark: SparkSession, root: str) -> DataFrame:
    rows = current(spark, root)
    key = rows.agg(F.max("url").alias("u")).first()["u"]
    return rows.where(F.col("url") == key).select("id", "url", "title")


@query("select module, count(*) as documents from document_records group by module")
def list_modules(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "document_records").groupBy("module").agg(F.count(F.lit(1)).alias("documents"))


@query("select module, submodule, major_version, minor_version, patch_version, count(*) as documents from document_records group by all")
def version_counts(spark: SparkSession, root: str) -> DataFrame:
    return C.version_counts(table(spark, root, "document_records"))


@query("""select coalesce(nullif(module, ''), 'unknown') as module, string_agg(distinct cast(coalesce(version_major, 0) as varchar), ',' order by cast(coalesce(version_major, 0) as varchar)) as versions,
  coalesce(string_agg(distinct nullif(submodule, ''), ',' order by nullif(submodule, '')), '') as submodules, count(*) as chunks from chunks group by 1""")
def collection_status(spark: SparkSession, root: str) -> DataFrame:
    return C.collection_status(table(spark, root, "chunks"))


@query(f"with {_CURRENT} select count(*) filter (is_indexed) as indexed, count(*) filter (not is_indexed) as unindexed, max(schema_version) as newest_schema from cur")
def index_counts(spark: SparkSession, root: str) -> DataFrame:
    return current(spark, root).agg(F.count_if("is_indexed").alias("indexed"), F.count_if(~F.col("is_indexed")).alias("unindexed"), F.max("schema_version").alias("newest_schema"))


_LATEST = """latest as (select module, submodule, id, status, started_at from (
  select *, row_number() over (partition by module, submodule order by started_at desc nulls last, id desc) as r from sync_history) where r = 1)"""


@query(f"with {_LATEST} select module, submodule, id, status, started_at from latest")
def latest_sync(spark: SparkSession, root: str) -> DataFrame:
    return C.latest_sync(table(spark, root, "sync_history")).select("module", "submodule", "id", "status", "started_at")


@query(f"""with {_CURRENT}, {_LATEST}, d as (select module, submodule, major_version, count(*) as documents, count(*) filter (is_indexed) as indexed from cur group by module, submodule, major_version)
select d.module, d.submodule, major_version, documents, indexed, l.status as last_status, l.started_at as last_started from d left join latest l on d.module = l.module and d.submodule is not distinct from l.submodule""")
def status_report(spark: SparkSession, root: str) -> DataFrame:
    return C.status_report(current(spark, root), table(spark, root, "sync_history"))


@query("select distinct id, module, started_at from sync_history where status = 'in_progress'")
def in_progress(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "sync_history").where("status = 'in_progress'").select("id", "module", "started_at").distinct()


@query("select id, status, started_at from (select distinct * from sync_history) where module = 'spring-boot' and submodule is null order by started_at desc nulls last, id desc limit 50")
def sync_history(spark: SparkSession, root: str) -> DataFrame:
    return C.sync_history(table(spark, root, "sync_history"), "spring-boot").select("id", "status", "started_at")


@query("""select count(distinct (module, coalesce(submodule, ''))) as targets, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
  cast(sum(case when status = 'completed' then files_added end) as bigint) as added, cast(sum(case when status = 'completed' then files_modified end) as bigint) as modified,
  cast(sum(case when status = 'completed' then files_removed end) as bigint) as removed, count(*) filter (coalesce(error_message, '') <> '') as errors from (select distinct * from sync_history)""")
def sync_summary(spark: SparkSession, root: str) -> DataFrame:
    return C.sync_summary(table(spark, root, "sync_history"))


@query("""select id, case when id = 1 then 'failed' else status end as status, case when id = 1 then 'lost connection' else error_message end as error_message, case when id = 1 then 7 else files_added end as files_added
from sync_history""")
def sync_lifecycle(spark: SparkSession, root: str) -> DataFrame:
    return C.finish_run(table(spark, root, "sync_history"), 1, F.lit("2025-12-31 00:00:00").cast("timestamp_ntz"), "lost connection", files_added=7).select("id", "status", "error_message", "files_added")


@query("""with s as (select distinct module, submodule, version, started_at, completed_at, id from sync_history where completed_at is not null)
select id, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 as seconds from s""")
def sync_durations(spark: SparkSession, root: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = table(spark, root, "sync_history").where("completed_at is not null").select("id", "started_at", "completed_at").distinct()
    return rows.select("id", ((micros("completed_at") - micros("started_at")) / 1e6).alias("seconds"))


@query(f"""with {_CURRENT} select module, submodule, count(*) as file_count, cast(coalesce(sum(size_bytes), 0) as bigint) as total_size_bytes, sha256(string_agg(content_hash, '' order by content_hash)) as pack_hash
from cur group by module, submodule""")
def manifest_build(spark: SparkSession, root: str) -> DataFrame:
    return M.build_manifest(current(spark, root), ["module", "submodule"])


_SIDES = f"""with {_CURRENT}, o as (select id as path, content_hash, size_bytes from (select *, row_number() over (partition by id order by scraped_at, content_hash, size_bytes) as r from document_records where scraped_at < timestamp '2025-06-01') where r = 1),
n as (select id as path, content_hash, size_bytes from cur where scraped_at >= timestamp '2025-03-01')"""
_DELTA = _SIDES + """, delta as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' else 'modified' end as change_type,
  o.content_hash as old_hash, n.content_hash as new_hash, n.size_bytes from o full join n on o.path = n.path where o.path is null or n.path is null or o.content_hash is distinct from n.content_hash)"""


def _sides(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, root, "document_records").where("scraped_at < timestamp '2025-06-01'")
    old = C.window_first(rows, ["id"], [F.col("scraped_at"), F.col("content_hash"), F.col("size_bytes")])
    new = current(spark, root).where("scraped_at >= timestamp '2025-03-01'")
    return tuple(x.select(F.col("id").alias("path"), "content_hash", "size_bytes") for x in (old, new))


@query(_DELTA + " select * from delta")
def manifest_delta(spark: SparkSession, root: str) -> DataFrame:
    return M.manifest_delta(*_sides(spark, root))


@query(_DELTA + """ select count(*) filter (change_type = 'added') as added, count(*) filter (change_type = 'modified') as modified, count(*) filter (change_type = 'removed') as removed, count(*) as total,
  cast(coalesce(sum(case when change_type <> 'removed' then coalesce(size_bytes, 0) end), 0) as bigint) as bytes_to_download from delta""")
def delta_counters(spark: SparkSession, root: str) -> DataFrame:
    return M.delta_counters(M.manifest_delta(*_sides(spark, root)))


@query(_SIDES + " select path, 'added' as change_type, content_hash as new_hash from n")
def fresh_delta(spark: SparkSession, root: str) -> DataFrame:
    old, new = _sides(spark, root)
    return M.manifest_delta(old.limit(0), new).select("path", "change_type", "new_hash")


@query(_SIDES + " select path, content_hash from n")
def delta_applied(spark: SparkSession, root: str) -> DataFrame:
    """The old manifest with the whole delta applied is the new one."""
    old, new = _sides(spark, root)
    return M.apply_delta(old, M.manifest_delta(old, new))


@query("""select module, submodule, version, manifest_hash from (select *, row_number() over (partition by module, submodule, version order by fetched_at desc, manifest_hash desc) as r from local_manifest) where r = 1""")
def manifest_cache(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "local_manifest")
    early = rows.where("fetched_at < timestamp '2025-06-01'")
    kept = M.save_manifests(M.save_manifests(rows.limit(0), early), rows)
    return kept.select("module", "submodule", "version", "manifest_hash")


@query("select distinct module, submodule, version from local_manifest")
def manifest_targets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "local_manifest").select("module", "submodule", "version").distinct()


@query("""with t as (select module, version from local_manifest where submodule is null group by all order by module, version limit 1),
m as (select l.* from local_manifest l join t using (module, version) where submodule is null order by fetched_at desc, manifest_hash limit 1)
select module, submodule, version, manifest_hash, fetched_at, cast(case when json_valid(manifest_json) then json_extract(manifest_json, '$.file_count') end as int) as file_count,
 cast(case when json_valid(manifest_json) then json_extract(manifest_json, '$.total_size_bytes') end as bigint) as total_size_bytes, case when json_valid(manifest_json) then json_extract_string(manifest_json, '$.pack_hash') end as pack_hash from m""")
def manifest_lookup(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "local_manifest")
    target = rows.where("submodule is null").select("module", "version").distinct().orderBy("module", "version").first()
    return M.cached_manifest(rows, target["module"], target["version"])


_OBJECTS = """objects as (select case when o_orderkey % 3 = 0 then 'main/' else '' end || case when o_orderkey % 2 = 0 then 'chroma_db_' else 'sqlite_metadata_' end || strftime(o_orderdate, '%Y_%m_%d') || '.zip' as key,
  o_orderdate as last_modified from orders)"""


@query(f"""with {_OBJECTS}, p as (select distinct regexp_extract(key, '^(?:(.*)/)?(chroma_db|sqlite_metadata)_(.*)\\.zip$', 1) as scope, regexp_extract(key, '(chroma_db|sqlite_metadata)', 1) as kind, regexp_extract(key, '_(\\d{{4}}_\\d{{2}}_\\d{{2}})\\.zip$', 1) as token, key from objects),
b as (select scope, token from p group by scope, token having count(distinct kind) = 2), best as (select scope, token from b where scope = 'main' order by token desc limit 1)
select p.scope, p.token, kind, key from p join best on p.scope = best.scope and p.token = best.token""")
def snapshot_pair(spark: SparkSession, root: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy_MM_dd")
    key = F.concat(F.when(k % 3 == 0, "main/").otherwise(""), F.when(k % 2 == 0, "chroma_db_").otherwise("sqlite_metadata_"), day, F.lit(".zip"))
    return M.latest_pair(table(spark, root, "orders").select(key.alias("key"), F.col("o_orderdate").alias("last_modified")), ["main", ""])


_WIKI = "files as (select distinct p_brand as category, (p_size % 3 + 1) || '.' || (p_size % 7) || '.' || (p_partkey % 11) as version from part)"


@query(f"""with {_WIKI}, v as (select *, cast(split_part(version, '.', 1) as int) as a, cast(split_part(version, '.', 2) as int) as b, cast(split_part(version, '.', 3) as int) as c from files),
p as (select * from (select *, row_number() over (partition by category, a, b order by c desc) as r from v) where r = 1)
select category, version from (select *, row_number() over (partition by category order by a desc, b desc) as m from p) where m <= 2""")
def wiki_latest(spark: SparkSession, root: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    version = F.concat_ws(".", (size % 3 + 1).cast("string"), (size % 7).cast("string"), (key % 11).cast("string"))
    files = table(spark, root, "part").select(F.col("p_brand").alias("category"), version.alias("version")).distinct()
    return M.latest_wiki_files(files)


@query("""with k as (select distinct split_part(s3_key, '/', 1) as prefix, split_part(s3_key, '/', 2) as version from document_records where s3_key like '%/%/%'),
m as (select unnest(['spring-boot', 'spring-framework', 'spring-security', 'spring-data', 'spring-cloud', 'spring-ai', 'github-wiki', 'spring']) as name),
h as (select prefix, version, max_by(name, length(name)) as module from k join m on prefix = name or starts_with(prefix, name || '-') group by 1, 2)
select module, nullif(substring(prefix, length(module) + 2), '') as submodule, version from h""")
def sync_targets(spark: SparkSession, root: str) -> DataFrame:
    return M.sync_targets(table(spark, root, "document_records").select(F.col("s3_key").alias("key")), [*V.MINIMUM_MAJOR, "spring"])


@query(f"with {_CURRENT}, h as (select distinct lower(content_hash) as have, document_id from index_log) select s3_key as key, case when exists (select 1 from h where h.document_id = cur.id and h.have = cur.content_hash) then 'skipped' else 'uploaded' end as status from cur")
def upload_status(spark: SparkSession, root: str) -> DataFrame:
    log = table(spark, root, "index_log").select("document_id", F.lower("content_hash").alias("have")).distinct()
    rows = current(spark, root)
    have = rows.join(log, (rows["id"] == log["document_id"]) & (rows["content_hash"] == log["have"]), "left_semi").select(F.col("s3_key").alias("key"), "content_hash", F.col("scraped_at").alias("last_modified"))
    return M.upload_status(rows.select(F.col("s3_key").alias("key"), "content_hash"), have)


@query("""with v as (select distinct version from sync_history) select version, cast(split_part(version, '.', 1) as int) as major, coalesce(try_cast(nullif(split_part(version, '.', 2), '') as int), 0) as minor,
 coalesce(try_cast(nullif(split_part(version, '.', 3), '') as int), 0) as patch from v""")
def version_parse(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "sync_history").select("version").distinct()
    return rows.select("version", V.parse_version(F.col("version")).alias("v")).select("version", "v.major", "v.minor", "v.patch")


@query("select id, major_version >= case module when 'spring-boot' then 4 when 'spring-framework' then 7 when 'spring-security' then 6 when 'spring-data' then 4 when 'spring-cloud' then 4 when 'spring-ai' then 1 when 'github-wiki' then 0 else 1 end as served, (major_version, minor_version, patch_version) >= (4, 1, 0) and (major_version, minor_version, patch_version) <= (6, 2, 9) as inside from document_records")
def version_gates(spark: SparkSession, root: str) -> DataFrame:
    v = lambda s: V.parse_version(F.lit(s))
    own = V.parse_version(V.version_string(F.col("major_version").cast("string"), F.col("minor_version").cast("string"), F.col("patch_version").cast("string")))
    return table(spark, root, "document_records").select("id", V.meets_minimum(F.col("module"), F.col("major_version")).alias("served"), V.in_range(own, v("4.1.0"), v("6.2.9")).alias("inside"))


@query(r"""select id, regexp_matches(content_hash, '^[a-f0-9]{64}$') as hash_ok, substring(sha256(url), 1, 16) = id as id_ok,
 rtrim(array_to_string(list_filter([case when content_hash is null or not regexp_matches(content_hash, '^[a-f0-9]{64}$') then 'hash' end, case when size_bytes is null or size_bytes < 0 then 'size' end, case when synced_at is null or synced_at < scraped_at then 'synced' end], lambda x: x is not null), ','), ',') as violations from document_records""")
def validate_records(spark: SparkSession, root: str) -> DataFrame:
    rules = {"hash": T.is_sha256(F.col("content_hash")), "size": F.col("size_bytes") >= 0, "synced": F.col("synced_at") >= F.col("scraped_at")}
    rows = C.validate(table(spark, root, "document_records"), rules)
    return rows.select("id", T.is_sha256(F.col("content_hash")).alias("hash_ok"), (T.short_id(F.col("url")) == F.col("id")).alias("id_ok"), F.array_join("violations", ",").alias("violations"))


@query(r"""with u as (select distinct url from (select url from page_sections union all select url from document_records union all select url from documents) where url is not null)
select url, case when not regexp_matches(url, '^https?://') then '' else regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)', 1) || '://' || regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)', 2) || regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)', 3)
  || case when regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)', 3) not in ('') and regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)', 3) not like '%/' and regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)', 3) not like '%.%' then '/' else '' end end as normalized from u""")
def url_normalize(spark: SparkSession, root: str) -> DataFrame:
    urls = table(spark, root, "page_sections").select("url").unionByName(table(spark, root, "document_records").select("url")).unionByName(table(spark, root, "documents").select("url"))
    return urls.where("url is not null").distinct().select("url", U.normalize_url(F.col("url")).alias("normalized"))


@query(r"""with u as (select distinct url from document_records), p as (select url, regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 1) || '://' || regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 2) as host, regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 3) as path from u)
select url, host || case when path = '' then '' when contains(regexp_extract(path, '[^/]*$'), '.') then regexp_replace(path, '[^/]*$', '') when path like '%/' then path else path || '/' end as base,
  (regexp_matches(lower(path), '\.(pdf|zip|tar|gz|jar|png|jpg|jpeg|gif|svg|ico|css|js|woff|woff2|ttf|eot)$') or regexp_matches(url, 'github\.com|stackoverflow\.com|mailto:') or regexp_matches(url, '/api/|/javadoc/|/javadoc-api/')) as skip from p""")
def url_rules(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "document_records").select("url").distinct().select("url", U.base_path(F.col("url")).alias("base"), U.skip_url(F.col("url")).alias("skip"))


@query(r"""select id, module || coalesce('-' || nullif(submodule, ''), '') || '/' || major_version || '.' || minor_version || '.' || patch_version || '/' || substring(sha256(url), 1, 16) || '/document.md' as key,
 regexp_matches(file_path, '(^|/)document\.md$') as is_document from document_records""")
def object_keys(spark: SparkSession, root: str) -> DataFrame:
    version = V.version_string(F.col("major_version").cast("string"), F.col("minor_version").cast("string"), F.col("patch_version").cast("string"))
    return table(spark, root, "document_records").select("id", U.object_key(F.col("module"), F.col("submodule"), version, F.col("url")).alias("key"), F.col("file_path").rlike(r"(^|/)document\.md$").alias("is_document"))


@query(r"select path, regexp_matches(path, '^api/.*$') or regexp_matches(path, '^.*\.adoc$') as excluded from (select distinct path from file_changes)")
def glob_exclude(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "file_changes").select("path").distinct().select("path", T.matches_any_glob(F.col("path"), ["api/*", "*.adoc"]).alias("excluded"))


@query("select sync_id, path, change_type from (select distinct sync_id, path, change_type from file_changes) f where exists (select 1 from sync_history s where s.id = f.sync_id and s.status = 'completed')")
def changes_of_completed(spark: SparkSession, root: str) -> DataFrame:
    done = table(spark, root, "sync_history").where("status = 'completed'").select(F.col("id").alias("sync_id"))
    return table(spark, root, "file_changes").select("sync_id", "path", "change_type").distinct().join(done, "sync_id", "left_semi")


@query("select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), 0) as k from events")
def json_meta(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"))


@query("""with need as (select chunk_id, document_id from chunks group by all), log as (select document_id, max(chunk_count) as n from index_log where outcome = 'ok' group by document_id)
select document_id, count(*) as chunks, max(n) as expected, count(*) >= max(n) as complete from need join log using (document_id) group by document_id""")
def index_completion(spark: SparkSession, root: str) -> DataFrame:
    have = table(spark, root, "chunks").select("chunk_id", "document_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    log = table(spark, root, "index_log").where("outcome = 'ok'").groupBy("document_id").agg(F.max("chunk_count").alias("expected"))
    return have.join(log, "document_id").select("document_id", "chunks", "expected", (F.col("chunks") >= F.col("expected")).alias("complete"))


@query(f"with {_CURRENT} select id, synced_at is not null as synced, (select count(*) from index_log l where l.document_id = cur.id and l.outcome = 'ok') > 0 as tried from cur")
def record_progress(spark: SparkSession, root: str) -> DataFrame:
    rows = P.current_rows(table(spark, root, "document_records"))
    tried = table(spark, root, "index_log").where("outcome = 'ok'").select(F.col("document_id").alias("id")).distinct().withColumn("t", F.lit(True))
    return rows.join(tried, "id", "left").select("id", F.col("synced_at").isNotNull().alias("synced"), F.coalesce("t", F.lit(False)).alias("tried"))
