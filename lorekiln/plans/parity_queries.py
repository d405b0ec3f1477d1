"""Queries of single operators and functions: flags, vectors, listings, downloads, archives, versions, paths, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.functions import url as U
from lorekiln.functions import version as V
from lorekiln.operators import activation, catalog, chunking, discovery, embedding, lexical, manifests, pages, search
from lorekiln.plans.catalog_queries import _CURRENT, current
from lorekiln.plans.page_queries import html_pages
from lorekiln.plans.search_queries import _BM25, _DIST, _index
from lorekiln.session import fresh_path, ready
from lorekiln.sources import registry
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


# records, flags and vectors


@query("select substring(sha256(url), 1, 16) as id, sha256(text) as content_hash, cast(strlen(text) as bigint) as size_bytes, url from documents where url is not null")
def records_of_pages(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("url is not null").select("url", F.col("text").alias("markdown"))
    return catalog.page_records(rows).select("id", "content_hash", "size_bytes", "url")


@query(f"with {_CURRENT} select id, case when module = 'spring-boot' and submodule is null then false else is_indexed end as is_indexed from cur")
def reindexed_records(spark: SparkSession, root: str) -> DataFrame:
    return _reindexed(spark, root)[0].select("id", "is_indexed")


@query("select distinct chunk_id from chunks where not coalesce(module = 'spring-boot' and coalesce(submodule, '') = '', false)")
def reindexed_vectors(spark: SparkSession, root: str) -> DataFrame:
    return _reindexed(spark, root)[1].select("chunk_id").distinct()


def _reindexed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return catalog.reindex(current(spark, root), table(spark, root, "chunks").select("chunk_id", "module", "submodule", "version_major"), "spring-boot")


@query("select vec_id, case when label = 1 then 101 else label end as label from embeddings")
def vectors_upserted(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").select("vec_id", "label")
    new = rows.where("label = 1").withColumn("label", (F.col("label") + 100).cast(dict(rows.dtypes)["label"]))
    return embedding.upsert_vectors(rows, new, "vec_id")


@query("select d.doc_id as id, e.vec_id is not null as attached, case when e.vec_id is null then 'no vector' end as error from documents d left join (select distinct vec_id from embeddings where embedding is not null) e on e.vec_id = d.doc_id")
def vectors_attached(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return embedding.attach_vectors(table(spark, root, "documents").select(F.col("doc_id").alias("id")), vectors, "id").select("id", F.col("embedding").isNotNull().alias("attached"), "error")


@query("select id, module, submodule, version, status, started_at from sync_history union all select 99999999, 'spring-ai', null, '2.0.0', 'in_progress', timestamp '2026-01-02 03:04:05'")
def sync_started(spark: SparkSession, root: str) -> DataFrame:
    begun = catalog.start_run(table(spark, root, "sync_history"), 99999999, "spring-ai", "2.0.0", F.lit("2026-01-02 03:04:05"))
    return begun.select("id", "module", "submodule", "version", "status", "started_at")


@query("select started_at, id, error_message from (select distinct * from sync_history) where coalesce(error_message, '') <> ''")
def sync_errors(spark: SparkSession, root: str) -> DataFrame:
    return catalog.sync_errors(table(spark, root, "sync_history"))


@query("select count(*) filter (outcome = 'ok') as success, count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'error') as failed, count(*) as total from index_log")
def batch_counts(spark: SparkSession, root: str) -> DataFrame:
    status = F.when(F.col("outcome") == "ok", "success").when(F.col("outcome") == "error", "failed").otherwise(F.col("outcome"))
    return catalog.batch_counts(table(spark, root, "index_log").select(status.alias("status")))


@query(f"with {_CURRENT}, m as (select distinct on (url) url, title, module as submodule, fetched_at as scraped_at from documents where url is not null order by url, doc_id) "
       "select cur.id, coalesce(nullif(m.title, ''), cur.title) as title, coalesce(nullif(m.submodule, ''), cur.submodule) as submodule, coalesce(m.scraped_at, cur.scraped_at) as scraped_at from cur left join m on substring(sha256(m.url), 1, 16) = cur.id")
def records_with_metadata(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("url is not null")
    one = rows.groupBy("url").agg(F.min_by(F.struct("title", F.col("module").alias("submodule"), F.col("fetched_at").alias("scraped_at")), "doc_id").alias("m")).select(T.short_id(F.col("url")).alias("id"), "m.*")
    return catalog.with_metadata(current(spark, root).select("id", "title", "submodule", "scraped_at"), one)


@query("select id, title, cast(null as varchar) as summary, cast(null as int) as words from document_records")
def schema_widened(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "document_records").select("id", "title")
    return catalog.add_missing_columns(rows, spark.createDataFrame([], "id string, title string, summary string, words int"))


@query("select unnest(['manifest_cache', 'vectors']) as missing")
def tables_missing(spark: SparkSession, root: str) -> DataFrame:
    missing = catalog.missing_tables(["documents", "sync_history"], ["documents", "sync_history", "vectors", "manifest_cache"])
    return spark.createDataFrame([(m,) for m in missing], "missing string")


# manifests, listings, downloads, archives


@query("select module, submodule, version, manifest_hash from local_manifest where not (submodule is null and version in (select max(version) from local_manifest where submodule is null))")
def manifests_dropped(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "local_manifest")
    bare = rows.where("submodule is null")
    newest = bare.agg(F.max("version").alias("version"))
    targets = bare.join(newest, "version").select("module", "submodule", "version").distinct()
    return manifests.drop_manifests(rows, targets).select("module", "submodule", "version", "manifest_hash")


@query("""with m as (select distinct module, version, coalesce(submodule, '') as submodule from local_manifest)
select module, submodule, version, sha256(to_json({'module': module, 'submodule': submodule, 'version': version})) as hash from m""")
def manifest_hashes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "local_manifest").select("module", F.coalesce("submodule", F.lit("")).alias("submodule"), "version").distinct()
    return rows.select("module", "submodule", "version", manifests.manifest_hash(F.struct("module", "submodule", "version")).alias("hash"))


@query("select distinct manifest_hash, cast(json_array_length(json_extract(manifest_json, '$.files')) as int) as documents from local_manifest where json_valid(manifest_json)")
def pack_counts(spark: SparkSession, root: str) -> DataFrame:
    files = F.from_json("manifest_json", "files array<struct<path string>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = table(spark, root, "local_manifest").select("manifest_hash", files.alias("d")).where("d._bad is null and d.files is not null")
    return rows.select("manifest_hash", F.size("d.files").alias("documents")).distinct()


@query("""with o as (select distinct s3_key as key, size_bytes, 0 as n from document_records where s3_key < 's' or is_indexed union all select distinct s3_key, size_bytes + 1, 1 from document_records)
select key, min(size_bytes) as size_bytes from (select *, min(n) over (partition by key) as first from o) where n = first group by key""")
def objects_listed(spark: SparkSession, root: str) -> DataFrame:
    """Keys of two listings: what both have comes from the first."""
    rows = table(spark, root, "document_records").select(F.col("s3_key").alias("key"), "size_bytes", "is_indexed")
    first = rows.where("key < 's' or is_indexed").select("key", "size_bytes")
    return manifests.distinct_objects([first, rows.select("key", F.col("size_bytes") + 1).toDF("key", "size_bytes")])


@query("""with s as (select module as scope, max(version) as have from sync_history where status = 'completed' group by module), n as (select module as scope, max(version) as token from local_manifest group by module)
select coalesce(s.scope, n.scope) as scope, coalesce(token, have) as token, case when token is null then 'missing' when token is not distinct from have then 'skip' else 'refresh' end as action from n full join s on s.scope = n.scope""")
def snapshot_freshness(spark: SparkSession, root: str) -> DataFrame:
    stored = table(spark, root, "sync_history").where("status = 'completed'").groupBy(F.col("module").alias("scope")).agg(F.max("version").alias("token"))
    latest = table(spark, root, "local_manifest").select(F.col("module").alias("scope"), F.col("version").alias("token"))
    return manifests.freshness(stored, latest)


@query("""select doc_id as path, case when text is null then 'missing' when doc_id % 7 = 0 then 'hash mismatch' end is null as success, case when text is null then 'missing' when doc_id % 7 = 0 then 'hash mismatch' end as error from documents""")
def downloads_verified(spark: SparkSession, root: str) -> DataFrame:
    """Contents against their listed hashes: every seventh one damaged, null texts lost; each failure stays its own."""
    rows = table(spark, root, "documents")
    files = rows.where("text is not null").select(F.col("doc_id").alias("path"), F.encode(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "UTF-8").alias("content"))
    return manifests.verify_downloads(files, rows.select(F.col("doc_id").alias("path"), F.upper(T.sha256_hex(F.coalesce("text", F.lit("")))).alias("content_hash")))


_MEMBERS = "m as (select case when size_bytes % 5 = 0 then '/' else '' end || case when size_bytes % 7 = 0 then '../' else '' end || file_path as name, size_bytes, size_bytes % 11 = 0 as is_link from document_records)"
_PROBLEM = r"case when coalesce(name, '') = '' then 'no name' when regexp_matches(name, '^[/\\]|^[A-Za-z]:') then 'absolute path' when regexp_matches(name, '(^|[/\\])\.\.([/\\]|$)') then 'leaves the root' when coalesce(is_link, false) then 'link' end"


def _members(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("size_bytes")
    name = F.concat(F.when(n % 5 == 0, "/").otherwise(""), F.when(n % 7 == 0, "../").otherwise(""), "file_path")
    return table(spark, root, "document_records").select(name.alias("name"), "size_bytes", (n % 11 == 0).alias("is_link"))


@query(f"with {_MEMBERS} select name, size_bytes, {_PROBLEM} as problem from m")
def archive_members(spark: SparkSession, root: str) -> DataFrame:
    return _members(spark, root).select("name", "size_bytes", activation.member_problem(F.col("name"), F.col("is_link")).alias("problem"))


@query(f"with {_MEMBERS} select count(*) as members, cast(sum(size_bytes) as bigint) as bytes, count({_PROBLEM}) as problems, count({_PROBLEM}) = 0 as safe from m")
def archive_verdict(spark: SparkSession, root: str) -> DataFrame:
    return activation.archive_verdict(_members(spark, root))


@query("""select id, to_json({'id': id, 'module': module, 'major_version': major_version, 'size_bytes': size_bytes}) as json,
 sha256(to_json({'id': id, 'module': module, 'major_version': major_version, 'size_bytes': size_bytes})) as hash from document_records""")
def json_objects(spark: SparkSession, root: str) -> DataFrame:
    """Records as JSON objects in one canonical form, with their hash."""
    json = F.to_json(F.struct("id", "module", "major_version", "size_bytes"), {"ignoreNullFields": "false"})
    return table(spark, root, "document_records").select("id", json.alias("json"), T.sha256_hex(json).alias("hash"))


@query("""with m as (select distinct module, coalesce(submodule, '') as submodule, major_version || '.' || minor_version as version, url from document_records),
p as (select module, submodule, version, 'https://api.example/' || module as api, '' as repo, '' as pages, url from m)
select module, nullif(submodule, '') as submodule, version, 'reference' as lane, url, cast(null as varchar) as pages from p union all select module, nullif(submodule, ''), version, 'api', api, null from p
union all select module, nullif(submodule, ''), version, 'wiki', 'wiki/' || module, 'Home|Notes' from p where submodule <> ''""")
def matrix_jobs(spark: SparkSession, root: str) -> DataFrame:
    """A scrape matrix written as CSV and read as jobs."""
    rows = table(spark, root, "document_records").select("module", F.coalesce("submodule", F.lit("")).alias("submodule"), F.concat_ws(".", "major_version", "minor_version").alias("version"), F.col("url").alias("reference_url")).distinct()
    wiki = F.col("submodule") != ""
    full = rows.select("*", F.concat(F.lit("https://api.example/"), "module").alias("api_url"), F.when(wiki, F.concat(F.lit("wiki/"), "module")).otherwise("").alias("github_repo"), F.when(wiki, "Home|Notes").otherwise(" ").alias("github_wiki_pages"))
    path = fresh_path(spark, "matrix")
    full.write.option("header", True).option("quoteAll", True).csv(path)
    return registry.read_matrix(spark, path).withColumn("pages", F.array_join("pages", "|"))


@query("select distinct module as module_key, submodule as submodule_key, 'https://docs.example/' || module as base_url from document_records")
def registry_targets(spark: SparkSession, root: str) -> DataFrame:
    """A registry written as JSON and read as targets."""
    rows = table(spark, root, "document_records").select(F.col("module").alias("module_key"), F.col("submodule").alias("submodule_key"), F.concat(F.lit("https://docs.example/"), "module").alias("base_url")).distinct()
    path = fresh_path(spark, "registry")
    rows.agg(F.to_json(F.struct(F.collect_list(F.struct("module_key", "submodule_key", "base_url")).alias("targets"))).alias("value")).coalesce(1).write.text(path)
    return registry.read_registry(spark, path).select("module_key", "submodule_key", "base_url")


@query("select distinct path, regexp_matches(path, '(^|/)metadata\\.json$|/metadata/[^/]*\\.json$') as is_metadata, not regexp_matches(path, '(^/)|(^|/)\\.\\.(/|$)') as safe from (select path from file_changes union all select '../' || path from file_changes union all select '/metadata/' || path || '.json' from file_changes union all select path || '/metadata.json' from file_changes)")
def path_checks(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("path")
    forms = F.explode(F.array(p, F.concat(F.lit("../"), p), F.concat(F.lit("/metadata/"), p, F.lit(".json")), F.concat(p, F.lit("/metadata.json"))))
    rows = table(spark, root, "file_changes").select(forms.alias("path")).distinct()
    return rows.select("path", U.is_metadata_path(p).alias("is_metadata"), U.safe_path(p).alias("safe"))


# addresses, paths, names


@query("""select distinct url, starts_with(lower(url), 'http') as is_http, coalesce(url <> '' and starts_with(url, 'https://' || regexp_extract(url, '^https?://([^/]*)', 1) || '/guide'), false) as internal from page_sections where url is not null""")
def source_gates(spark: SparkSession, root: str) -> DataFrame:
    base = F.concat(F.lit("https://"), F.regexp_extract("url", r"^https?://([^/]*)", 1), F.lit("/guide"))
    return table(spark, root, "page_sections").where("url is not null").select("url").distinct().select("url", U.is_http(F.col("url")).alias("is_http"), U.is_internal(F.col("url"), base).alias("internal"))


@query("""select distinct path, list_contains(list_slice(string_split(lower(path), '/'), 1, -2), 'preview') as preview from (select path from file_changes union all select 'Preview/' || path from file_changes)""")
def preview_excluded(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "file_changes").select(F.explode(F.array("path", F.concat(F.lit("Preview/"), "path"))).alias("path")).distinct()
    return rows.select("path", U.in_preview_folder(F.col("path")).alias("preview"))


@query("""select s3_key as key, case when starts_with(s3_key, 'spring-boot/') then substring(s3_key, 13) when starts_with(s3_key, 'spring-') then substring(s3_key, 8) else string_split(s3_key, '/')[-1] end as relative,
 nullif(regexp_extract(s3_key, '(?:^|/)([0-9a-f]{16})/[^/]+$', 1), '') as url_hash from (select distinct s3_key from document_records)""")
def object_paths(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("s3_key")
    return table(spark, root, "document_records").select("s3_key").distinct().select(key.alias("key"), U.relative_path(key, ["spring-boot/", "spring-"]).alias("relative"), U.hash_in_path(key).alias("url_hash"))


@query("""with t as (select distinct module, submodule, version, fetched_at from local_manifest)
select module, submodule, version, fetched_at, module || coalesce('-' || nullif(submodule, ''), '') || '/' || version || '/' || coalesce(',' || module || '/' || nullif(submodule, '') || '/' || version || '/', '') as prefixes,
 'acme-embed-v-' || length(module) || '-slim/pack_' || strftime(fetched_at, '%Y_%m_%d') || '.zip' as snapshot from t""")
def object_prefixes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "local_manifest").select("module", "submodule", "version", "fetched_at").distinct()
    place = U.namespace(F.concat(F.lit("Acme/Embed_v."), F.length("module").cast("string")), F.lit("slim"))
    return rows.select("module", "submodule", "version", "fetched_at", F.array_join(U.target_prefixes(F.col("module"), F.col("submodule"), F.col("version")), ",").alias("prefixes"), U.snapshot_key(place, "pack", F.col("fetched_at")).alias("snapshot"))


@query(r"select doc_id, md5(trim(regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'), ' ')) as collapsed, array_to_string(list_transform(string_split(replace(module, '-', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') as shown from documents")
def text_forms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.md5(T.collapse_space(F.col("text"))).alias("collapsed"), T.display_name(F.col("module")).alias("shown"))


@query(r"""select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[\s\x0b\x{85}\p{Z}]+'), lambda w: w <> '')) as int) as words, cast(len(regexp_extract_all(text, '(?m)^#{1,6}[ \t]+\S')) as int) as sections,
 cast(len(regexp_extract_all(text, '(?m)^[ \t]*```')) // 2 as int) as code_examples from (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text from documents) where text is not null""")
def document_stats(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    return rows.select("doc_id", T.document_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(r"""select distinct chunk_id, coalesce(list_bool_or(list_transform(regexp_extract_all(content, '@(\w+)(?:\([^)]*\))?', 1), lambda m: contains(lower(m), 'deprecated'))), false) as deprecated, version_major >= 4 as removed from chunks""")
def deprecations(spark: SparkSession, root: str) -> DataFrame:
    removed = V.is_removed(F.lit("4.0"), F.concat(F.col("version_major").cast("string"), F.lit(".0")))
    return table(spark, root, "chunks").select("chunk_id", T.has_deprecations(T.annotations(F.col("content"))).alias("deprecated"), removed.alias("removed")).distinct()


@query("""with v as (select distinct upper(replace(content_type, '-', '_')) || ' ' as given from documents union select distinct content_type from documents union select 'nothing of it')
select given, case when lower(trim(replace(given, '_', '-'))) in ('guide', 'reference', 'release-notes', 'migration-guide', 'api-doc') then lower(trim(replace(given, '_', '-'))) end as name from v""")
def names_matched(spark: SparkSession, root: str) -> DataFrame:
    kinds = table(spark, root, "documents").select("content_type").distinct()
    forms = kinds.select(F.explode(F.array("content_type", F.concat(F.upper(F.replace("content_type", F.lit("-"), F.lit("_"))), F.lit(" ")), F.lit("nothing of it"))).alias("given")).distinct()
    return forms.select("given", T.matched_name(F.col("given"), ["guide", "reference", "release-notes", "migration-guide", "api-doc"]).alias("name"))


@query(r"""with q as (select distinct query || ' module=spring-boot version=' || rank || ' submodule=x version=no' as line from bm25_results), w as (select line, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') as w from q)
select line, array_to_string(list_filter(w, lambda x: not regexp_matches(x, '^(module|version|submodule)=')), ' ') as query, 'spring-boot' as module, regexp_extract(line, ' version=(\d+)', 1) as version, 'x' as submodule from w""")
def query_lines(spark: SparkSession, root: str) -> DataFrame:
    line = F.concat("query", F.lit(" module=spring-boot version="), F.col("rank").cast("string"), F.lit(" submodule=x version=no"))
    rows = table(spark, root, "bm25_results").where("query is not null").select(line.alias("line")).distinct()
    return rows.select("line", T.query_parts(F.col("line")).alias("p")).select("line", "p.*")


@query(r"""select distinct title, coalesce(case when contains(title, 'Release-Notes') then 'release-notes' when contains(title, 'Migration-Guide') then 'migration-guide' end, 'reference') as content_type, nullif(regexp_extract(title, '(\d+\.\d+(?:\.\d+)?)', 1), '') as version
 from (select replace(title, ' ', '-') || case when doc_id % 3 = 0 then '-Release-Notes-' || (doc_id % 9) || '.1.2.md' else '' end as title from documents where title is not null)""")
def wiki_names(spark: SparkSession, root: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("-Release-Notes-"), (F.col("doc_id") % 9).cast("string"), F.lit(".1.2.md"))).otherwise("")
    rows = table(spark, root, "documents").where("title is not null").select(F.concat(F.replace("title", F.lit(" "), F.lit("-")), more).alias("title")).distinct()
    return rows.select("title", T.wiki_content_type(F.col("title")).alias("content_type"), T.wiki_version(F.col("title")).alias("version"))


# versions


_V = "(major_version || '.' || minor_version || '.' || patch_version)"


@query(f"""select distinct module, {_V} as version, module || ':[' || {_V} || ', *]' as range, (major_version, minor_version, patch_version) >= (4, 0, 0) as inside,
 case when module = 'spring-boot' then case when (major_version, minor_version, patch_version) < (4, 1, 0) then -1 when (major_version, minor_version, patch_version) > (4, 1, 0) then 1 else 0 end end as "order",
 case when module <> 'spring-boot' then 'different modules' end as error from document_records""")
def version_order(spark: SparkSession, root: str) -> DataFrame:
    text = V.version_string(*[F.col(c).cast("string") for c in ("major_version", "minor_version", "patch_version")])
    rows = table(spark, root, "document_records").select("module", text.alias("version")).distinct()
    own = V.parse_version(F.col("version"))
    against = V.compare_versions(F.col("module"), own, F.lit("spring-boot"), V.parse_version(F.lit("4.1.0-RC1")))
    return rows.select("module", "version", V.range_string(F.col("module"), F.col("version"), F.lit(None)).alias("range"), V.in_range(own, V.parse_version(F.lit("4")), F.lit(None).cast("struct<major:int,minor:int,patch:int>")).alias("inside"), against.alias("c")).select("module", "version", "range", "inside", "c.*")


@query("""with p as (select distinct version as label, '4.0.0' as target, content_type from sync_history, (select distinct content_type from documents) union select distinct null, version, 'reference' from sync_history union select null, null, 'api-doc' union select null, null, 'reference' union select 'next', '4.0.0', 'reference'),
n as (select *, regexp_matches(label, '^\\d{1,9}(\\.\\d{1,9})?(\\.\\d{1,9})?([.-].+)?$') as fine, [coalesce(try_cast(nullif(regexp_extract(label, '^(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', 1), '') as int), 0), coalesce(try_cast(nullif(regexp_extract(label, '^(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', 2), '') as int), 0), coalesce(try_cast(nullif(regexp_extract(label, '^(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', 3), '') as int), 0)] as a, [coalesce(try_cast(nullif(regexp_extract(target, '^(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', 1), '') as int), 0), coalesce(try_cast(nullif(regexp_extract(target, '^(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', 2), '') as int), 0), coalesce(try_cast(nullif(regexp_extract(target, '^(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?', 3), '') as int), 0)] as b from p),
e as (select *, case when content_type = 'api-doc' and target is null then 'no target version' when label is null and not (content_type in ('api-doc', 'reference') and target is not null) then 'no version'
 when label is not null and not fine then 'unreadable version' when label is not null and target is not null and a <> b then 'version mismatch' end as error from n)
select label, target, content_type, case when error is null then coalesce(label, target) end as version, error from e""")
def page_versions(spark: SparkSession, root: str) -> DataFrame:
    labels = table(spark, root, "sync_history").select("version").distinct()
    kinds = table(spark, root, "documents").agg(F.collect_set("content_type")).scalar()  # a handful of names
    rows = labels.select(F.col("version").alias("label"), F.lit("4.0.0").alias("target"), F.explode(kinds).alias("content_type"))
    rows = rows.unionByName(labels.select(F.lit(None).cast("string").alias("label"), F.col("version").alias("target"), F.lit("reference").alias("content_type")))
    rows = rows.unionByName(spark.createDataFrame([(None, None, "api-doc"), (None, None, "reference"), ("next", "4.0.0", "reference")], "label string, target string, content_type string")).distinct()
    return rows.select("label", "target", "content_type", pages.reconciled_version(F.col("label"), F.col("target"), F.col("content_type")).alias("r")).select("label", "target", "content_type", "r.*")


@query("select tier, max_tokens, overlap_tokens from (values ('main', 2048, 200), ('slim', 512, 50), ('xslim', 384, 40)) t(tier, max_tokens, overlap_tokens)")
def tier_limits(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(t, *v) for t, v in chunking.TIERS.items()], "tier string, max_tokens int, overlap_tokens int")


# search and pages


@query("select m as module, m not in (select distinct module from chunks where module is not null) as unknown from (select unnest(['spring-boot', 'spring-data', 'no-such-module']) as m)")
def modules_unknown(spark: SparkSession, root: str) -> DataFrame:
    asked = spark.createDataFrame([("spring-boot",), ("spring-data",), ("no-such-module",)], "module string")
    return search.unknown_modules(table(spark, root, "chunks"), asked)


@query(f"with {_BM25} select (select count(*) from lens) as documents, (select count(*) from post) as postings, (select count(*) from terms) as terms, round((select avgdl from corpus), 6) as avgdl")
def index_reloaded(spark: SparkSession, root: str) -> DataFrame:
    """What the written index holds once it is read again."""
    index = _index(spark, root)
    sizes = index.postings.agg(F.count(F.lit(1)).alias("postings")), index.terms.agg(F.count(F.lit(1)).alias("terms"))
    return spark.range(1).select(F.lit(index.documents).cast("long").alias("documents"), sizes[0].scalar().alias("postings"), sizes[1].scalar().alias("terms"), F.round(F.lit(index.avgdl), 6).alias("avgdl"))


@query(f"""with {_DIST}, near as (select id, distance, row_number() over (order by distance, id) as place from dist order by distance, id limit 20),
r as (select place, coalesce(title, '') as title, coalesce(url, '') as url, coalesce(text, '') as content, round(1e0 / (1e0 + distance), 6) as score from near join documents on doc_id = id)
select cast(place as int) as place, '[' || place || '] ' || title || ' (' || printf('%.4f', score) || ')' || chr(10) || url || chr(10) || case when length(content) > 500 then substring(content, 1, 500) || '...' else content end as shown from r""")
def result_text(spark: SparkSession, root: str) -> DataFrame:
    from lorekiln.operators.dense import nearest
    from lorekiln.plans.search_queries import _documents, _vector

    near = nearest(table(spark, root, "embeddings"), _vector(spark, root), 20).select("id", F.col("rank").alias("place"), F.round(1 / (1 + F.col("distance")), 6).alias("score"))
    return _documents(spark, root).join(F.broadcast(near), "id").select("place", search.format_text().alias("shown"))


_PAGE_HTML = """s as (select * from (select *, row_number() over (partition by page_id, section_ord order by url desc nulls last, section_id desc nulls last, title desc nulls last, level desc nulls last, content desc nulls last) as r from page_sections) where r = 1),
x as (select page_id, section_ord, url, greatest(1, least(6, coalesce(level, 2))) as l, coalesce(section_id, 's' || section_ord) as n, replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as t,
  replace(replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as c from s),
core as (select page_id, regexp_replace(max(url), '[?#].*$', '') || '#p' || page_id as url, string_agg('<h' || l || ' id="' || n || '">' || t || '</h' || l || '><p>' || c || '</p>', '' order by section_ord) as main from x group by page_id),
hashed as (select page_id, coalesce(url, cast(page_id as varchar)) as url, sha256(trim(regexp_replace(main, '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g'), ' ')) as hash from core)"""


@query(f"with {_PAGE_HTML} select url, hash from hashed")
def core_hashes(spark: SparkSession, root: str) -> DataFrame:
    return html_pages(ready(spark), root).select("url", F.sha2(F.encode(pages.core_content(F.col("html")), "UTF-8"), 256).alias("hash"))


@query(f"with {_PAGE_HTML} select url, hash, page_id % 2 = 0 as unchanged from hashed")
def pages_unchanged(spark: SparkSession, root: str) -> DataFrame:
    """Every second page is stored with its hash, the others with that of another text or not at all."""
    html = html_pages(ready(spark), root)
    number = F.regexp_extract("url", r"(\d+)$", 1).cast("long")
    stored = html.select("url", F.sha2(F.encode(pages.core_content(F.col("html")), "UTF-8"), 256).alias("hash"), number.alias("n"))
    return pages.unchanged(html, stored.where("n % 3 <> 1 or n % 2 = 0").select("url", F.when(F.col("n") % 2 == 0, F.col("hash")).otherwise("old").alias("hash")))


@query(f"with {_CURRENT} select substring(sha256(url), 1, 16) as id, url, 'spring-boot' as module, cast(null as varchar) as submodule, '4.0.0' as version, 'reference' as content_type, 1 as depth from cur")
def scrape_targets(spark: SparkSession, root: str) -> DataFrame:
    return discovery.scrape_targets(current(spark, root).select("url", F.lit(1).alias("depth")), "spring-boot", "4.0.0")


@query(r"""with c as (select distinct document_id, chunk_index, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as content from chunks where content is not null),
b as (select document_id, chunk_index, trim(unnest(regexp_extract_all(content, '(?s)```[a-z]*\n(.*?)```', 1)), ' ' || chr(10) || chr(9)) as code from c)
select document_id, md5(code) as code, min(chunk_index) as chunk_index, count(*) as uses from b where code <> '' group by document_id, code""")
def code_places(spark: SparkSession, root: str) -> DataFrame:
    """Each code block of a document at the first chunk that holds it, blocks being equal without the space around them."""
    text = F.regexp_replace("content", r"\r\n?", "\n")
    rows = table(spark, root, "chunks").where("content is not null").select("document_id", "chunk_index", text.alias("content")).distinct()
    return chunking.code_places(rows).select("document_id", F.md5("code").alias("code"), "chunk_index", "uses")
