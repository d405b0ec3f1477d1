"""Queries over texts and vectors: chunking, keyword and vector search, fusion, rendering, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.operators import chunking as K
from lorekiln.operators import dense as D
from lorekiln.operators import fusion as R
from lorekiln.operators import lexical as L
from lorekiln.operators import search as S
from lorekiln.operators import wiki as W
from lorekiln.session import exists, fresh_path, ready
from lorekiln.sources.tables import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The question of the search queries and its vector, that of the first embedding.
ASKED = "connection pool default timeout"
_WORDS = r"[\p{L}\p{N}_]+"

_BM25 = rf"""words as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') as w from documents),
lens as (select doc_id, len(w) as dl from words), corpus as (select count(*) as n, avg(dl) as avgdl from lens),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from words) group by all),
raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post, corpus group by term),
terms as (select term, df, case when raw < 0 then (select avg(raw) from raw) * 0.25 else raw end as idf from raw),
part as (select p.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from post p join terms using (term) join lens using (doc_id), corpus
  where term in ('connection', 'pool', 'default', 'timeout') group by p.doc_id),
scores as (select lens.doc_id as id, round(coalesce(s, 0.0), 6) as score from lens left join part using (doc_id))"""


#: Where the index over the documents of a folder was written, by folder and state of its files.
_indexes: dict[tuple, str] = {}


def _index(spark: SparkSession, root: str) -> L.Index:
    """The written index of the folder's documents; built by the first query that asks for it, anew when the files change."""
    documents = table(spark, root, "documents").select("doc_id", "text")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in documents.inputFiles()]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in paths]
    key = (spark.sparkContext.applicationId, root, len(states), sum(s.getLen() for s in states), max((s.getModificationTime() for s in states), default=0))
    if not exists(_indexes.get(key)):
        path = fresh_path(spark, "index")
        L.build_index(spread(documents), "doc_id", "text").write(path)
        _indexes[key] = path
    return L.read_index(spark, _indexes[key])


def _vector(spark: SparkSession, root: str) -> list[float]:
    rows = table(spark, root, "embeddings")
    first = rows.agg(F.min_by("embedding", "vec_id").alias("e")).first()["e"]
    return [float(x) for x in first]


@query(f"with {_BM25} select id, score, cast(row_number() over (order by score desc, id) as int) as rank from scores order by score desc, id limit 20")
def bm25_search(spark: SparkSession, root: str) -> DataFrame:
    return L.bm25_top(_index(spark, root), ASKED, 20)


@query(f"with {_BM25}, f as (select scores.* from scores join documents d on d.doc_id = id where d.module = 'spring-boot') select id, score from f order by score desc, id limit 20")
def bm25_filtered(spark: SparkSession, root: str) -> DataFrame:
    """The filter comes after scoring, so the statistics stay those of the whole collection."""
    kept = table(spark, root, "documents").where("module = 'spring-boot'").select(F.col("doc_id").alias("id"))
    return L.bm25_top(_index(spark, root), ASKED, 20, kept).select("id", "score")


@query(f"with {_BM25} select term, df, round(idf, 9) as idf from terms")
def bm25_terms(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"with {_BM25} select doc_id as id, cast(dl as int) as dl from lens")
def token_lengths(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).lengths


_DIST = """q as (select embedding as e from embeddings where vec_id = (select min(vec_id) from embeddings)),
dist as (select vec_id as id, label, round(list_sum(list_transform(list_zip(embedding, (select e from q)), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double)))), 6) as distance from embeddings)"""


@query(f"with {_DIST} select id, distance, cast(row_number() over (order by distance, id) as int) as rank from dist order by distance, id limit 20")
def dense_topk(spark: SparkSession, root: str) -> DataFrame:
    return D.nearest(table(spark, root, "embeddings"), _vector(spark, root), 20)


@query(f"with {_DIST} select id, distance from dist where label = 1 order by distance, id limit 20")
def dense_filtered(spark: SparkSession, root: str) -> DataFrame:
    return D.nearest(table(spark, root, "embeddings").where("label = 1"), _vector(spark, root), 20).select("id", "distance")


@query()
def dense_indexed(spark: SparkSession, root: str) -> DataFrame:
    """The nearest rows by the index over cells; dense_topk is the exact scan."""
    cells = D.build_cells(table(spark, root, "embeddings"), fresh_path(spark, "cells"))
    return cells.nearest(spark, _vector(spark, root), 20)


_FUSED = f"""{_BM25}, {_DIST}, sp as (select id, row_number() over (order by score desc, id) as sr from scores order by score desc, id limit 20),
de as (select id, row_number() over (order by distance, id) as dr from dist order by distance, id limit 20),
fused as (select coalesce(sp.id, de.id) as id, round(coalesce(1e0 / (6e1 + dr), 0e0) + coalesce(1e0 / (6e1 + sr), 0e0), 9) as score, cast(dr as int) as dense_rank, cast(sr as int) as sparse_rank from sp full join de on sp.id = de.id)"""


def _fused(spark: SparkSession, root: str) -> DataFrame:
    return R.fuse(dense_topk(spark, root), bm25_search(spark, root))


@query(f"with {_FUSED} select * from fused")
def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    return _fused(spark, root)


_DOCS = "docs as (select doc_id as id, coalesce(title, '') as title, coalesce(url, '') as url, coalesce(module, 'unknown') as module, coalesce(text, '') as content from documents)"
_HYBRID = f"""{_FUSED}, {_DOCS}, rows as (select docs.*, score, dense_rank, sparse_rank from docs join fused using (id)),
dedup as (select * exclude (r) from (select *, row_number() over (partition by case when trim(url) = '' then '~' || id else url end order by score desc, dense_rank nulls last, sparse_rank nulls last, id) as r from rows) where r = 1)"""


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("module", F.lit("unknown")).alias("module"), F.coalesce("text", F.lit("")).alias("content"),
    )


def _found(spark: SparkSession, root: str, k: int = 10, threshold: float | None = None) -> DataFrame:
    return S.hybrid(_index(spark, root), table(spark, root, "embeddings"), _documents(spark, root), ASKED, _vector(spark, root), k, 20, threshold)


_ORDER = "order by score desc, dense_rank nulls last, sparse_rank nulls last, id"


@query(f"with {_HYBRID} select id, score, dense_rank, sparse_rank, cast(row_number() over ({_ORDER}) as int) as place from dedup {_ORDER} limit 10")
def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    return _found(spark, root).select("id", "score", "dense_rank", "sparse_rank", "place")


@query(f"with {_HYBRID} select id, score from dedup where score >= 0.0155 {_ORDER} limit 10")
def hybrid_threshold(spark: SparkSession, root: str) -> DataFrame:
    return _found(spark, root, threshold=0.0155).select("id", "score")


@query(f"with {_HYBRID}, kept as (select * from dedup where score >= 0.05) select case when (select count(*) from kept) > 0 then 'success' when count(*) > 0 then 'below_threshold' else 'no_results' end as status, count(*) as results_found, max(score) as max_score from dedup")
def response_status(spark: SparkSession, root: str) -> DataFrame:
    raw = R.one_per_url(_documents(spark, root).join(_fused(spark, root), "id"))
    return R.response_status(raw, R.finish(raw, 10, 0.05))


@query(f"""with {_BM25}, w as (select doc_id as id, term, round(tf * 1e0 / dl, 9) as weight, row_number() over (partition by doc_id order by round(tf * 1e0 / dl, 9) desc, term) as r from post join lens using (doc_id))
select id, term, weight from w where r <= 20""")
def sparse_prune(spark: SparkSession, root: str) -> DataFrame:
    return D.prune_weights(_weights(spark, root), 20)


def _weights(spark: SparkSession, root: str) -> DataFrame:
    index = _index(spark, root)
    return index.postings.select("id", "term", F.round(F.col("tf") * 1.0 / F.col("dl"), 9).alias("weight"))


@query(f"""with {_BM25}, {_DIST}, {_DOCS}, near as (select id, distance, row_number() over (order by distance, id) as rank from dist order by distance, id limit 20),
sp as (select doc_id as id, round(sum(round(tf * 1e0 / dl, 9) * case term when 'connection' then 1.0 else 0.5 end), 6) as s from post join lens using (doc_id) where term in ('connection', 'pool') group by doc_id),
r1 as (select near.id, coalesce(s, 0.0) as s, row_number() over (order by 1.0 / (1.0 + greatest(distance, 0.0)) desc, rank) as dr from near left join sp on sp.id = near.id),
r2 as (select *, row_number() over (order by s desc, dr) as sr from r1),
rows as (select docs.id, docs.url, round(1e0 / (6e1 + dr) + case when s > 0 then 1e0 / (6e1 + sr) else 0e0 end, 9) as score, cast(dr as int) as dense_rank, cast(case when s > 0 then sr end as int) as sparse_rank from r2 join docs on docs.id = r2.id),
dedup as (select * exclude (r) from (select *, row_number() over (partition by case when trim(url) = '' then '~' || id else url end {_ORDER}) as r from rows) where r = 1)
select id, score, dense_rank, sparse_rank from dedup {_ORDER} limit 10""")
def native_hybrid(spark: SparkSession, root: str) -> DataFrame:
    found = S.native_hybrid(table(spark, root, "embeddings"), _weights(spark, root), _documents(spark, root), _vector(spark, root), {"connection": 1.0, "pool": 0.5}, 10)
    return found.select("id", "score", "dense_rank", "sparse_rank")


_WITH_SCOPE = "documents_of as (select doc_id as id, coalesce(url, '') as url, module, content_type as submodule, extract('month' from fetched_at) as version_major from documents)"


def _tool_sql(k: int, module: str | None, version: int | None, submodule: str | None, threshold: float, tail: str) -> str:
    hit = " and ".join([f"module = '{module}'"] * (module is not None) + [f"version_major = {version}"] * (version is not None)) or "true"
    keep = f"score >= {threshold}" + (f" and lower(coalesce(submodule, '')) = '{submodule}'" if submodule else "")
    return f"""with {_BM25}, {_DIST}, {_WITH_SCOPE}, kept as (select * from documents_of where {hit}),
sp as (select id, row_number() over (order by score desc, id) as sr from scores where id in (select id from kept) order by score desc, id limit {5 * k}),
de as (select id, row_number() over (order by distance, id) as dr from dist where {"id in (select id from kept)" if hit != "true" else "true"} order by distance, id limit {5 * k}),
fused as (select coalesce(sp.id, de.id) as id, round(coalesce(1e0 / (6e1 + dr), 0e0) + coalesce(1e0 / (6e1 + sr), 0e0), 9) as score, cast(dr as int) as dense_rank, cast(sr as int) as sparse_rank from sp full join de on sp.id = de.id),
rows as (select d.*, score, dense_rank, sparse_rank from documents_of d join fused using (id)),
dedup as (select * exclude (r) from (select *, row_number() over (partition by case when trim(url) = '' then '~' || id else url end {_ORDER}) as r from rows) where r = 1),
wide as (select * from dedup {_ORDER} limit {5 * k}), items as (select * from wide where {keep} {_ORDER} limit {k}) {tail}"""


_ITEMS = f"select id, score, dense_rank, sparse_rank, cast(row_number() over ({_ORDER}) as int) as place from items"
_STATUS = """select case when (select count(*) from items) > 0 then 'success' when count(*) > 0 then 'below_threshold' else 'no_results' end as status, count(*) as results_found,
 (select count(*) from items) as results_returned, max(score) as max_score from wide"""


def _tool(spark: SparkSession, root: str, **arguments) -> S.Response:
    """Documents stand for chunks here: the content type for a submodule, the month for a version."""
    rows = table(spark, root, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"), "module", F.col("content_type").alias("submodule"), F.month("fetched_at").alias("version_major"),
    )
    return S.tool_search(_index(spark, root), table(spark, root, "embeddings"), rows, ASKED, _vector(spark, root), **arguments)


@query(_tool_sql(5, None, None, None, 0.01, _ITEMS))
def tool_search(spark: SparkSession, root: str) -> DataFrame:
    return _tool(spark, root, top_k=5).items.select("id", "score", "dense_rank", "sparse_rank", "place")


@query(_tool_sql(5, "spring-boot", 3, None, 0.01, _ITEMS))
def tool_search_scoped(spark: SparkSession, root: str) -> DataFrame:
    return _tool(spark, root, top_k=5, module="spring-boot", version=3).items.select("id", "score", "dense_rank", "sparse_rank", "place")


@query(_tool_sql(10, None, None, "guide", 0.012, _ITEMS))
def tool_search_submodule(spark: SparkSession, root: str) -> DataFrame:
    return _tool(spark, root, top_k=10, submodule="Guide", threshold=0.012).items.select("id", "score", "dense_rank", "sparse_rank", "place")


@query(" union all ".join(f"select * from ({_tool_sql(3, m, None, s, t, _STATUS)})" for m, s, t in ((None, None, 0.01), (None, None, 0.9), ("no-module", None, 0.01), (None, "none", 0.01))))
def tool_status(spark: SparkSession, root: str) -> DataFrame:
    cases = ({}, {"threshold": 0.9}, {"module": "no-module"}, {"submodule": "None"})
    rows = [_tool(spark, root, **c).status.drop("message") for c in cases]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(f"""with {_HYBRID}, top as (select *, cast(row_number() over ({_ORDER}) as int) as place from dedup {_ORDER} limit 10)
select place, '<doc_chunk module="' || module || '" version="v1.0" url="' || url || '" rank="' || place || '" score="' || printf('%.4f', score) || '">' || chr(10) || '  <breadcrumb>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
  || '</breadcrumb>' || chr(10) || '  <content>' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</content>' || chr(10) || '</doc_chunk>' as item,
  case when dense_rank is not null and sparse_rank is not null then 'dense: #' || dense_rank || ', sparse: #' || sparse_rank when dense_rank is not null then 'dense: #' || dense_rank else 'sparse: #' || sparse_rank end as breakdown from top""")
def result_render(spark: SparkSession, root: str) -> DataFrame:
    rows = _found(spark, root).withColumns({"submodule": F.lit(""), "section_path": F.lit(""), "version_major": F.lit(1), "version_minor": F.lit(0)})
    return rows.select("place", R.render_item().alias("item"), R.score_breakdown().alias("breakdown"))


@query(f"""with {_HYBRID}, top as (select *, row_number() over ({_ORDER}) as place from dedup {_ORDER} limit 3)
select trim('## Search Results' || chr(10) || chr(10) || '**Query:** {ASKED}' || chr(10) || chr(10) || string_agg('### ' || place || '. ' || title || chr(10) || '- **URL:** ' || url || chr(10) || '- **Module:** ' || module || chr(10) || '- **Version:** v1.0' || chr(10)
  || '- **Score:** ' || printf('%.4f', score) || chr(10) || '- **Section:** ' || chr(10) || chr(10) || trim(content, ' ') || chr(10), chr(10) order by place), ' ') as prompt from top""")
def prompt_context(spark: SparkSession, root: str) -> DataFrame:
    rows = _found(spark, root, 3).withColumns({"submodule": F.lit(""), "section_path": F.lit(""), "version_major": F.lit(1), "version_minor": F.lit(0)})
    return R.prompt(rows, ASKED)


@query(r"select doc_id, trim(regexp_replace(regexp_replace(title, '[^\x00-\x7F]', '-', 'g'), '-{2,}', '-', 'g'), ' ') as clean_title, substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50) as slug, sha256(text) as hash, cast(strlen(text) as bigint) as bytes from documents")
def text_columns(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(
        "doc_id", T.sanitize_title(F.col("title")).alias("clean_title"), T.slug(F.col("title")).alias("slug"), T.sha256_hex(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("bytes"),
    )


@query(r"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda w: w <> '')) as int) as words, sha256(text) is not distinct from sha256(coalesce(text, '')) as has_text from documents where text is not null")
def doc_stats(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("text is not null")
    words = F.size(F.filter(F.split("text", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"), lambda w: w != ""))
    return rows.select("doc_id", words.alias("words"), T.content_matches(F.col("text"), T.sha256_hex(F.coalesce("text", F.lit("")))).alias("has_text"))


_ONE_END = r"replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    """(chunk_id, content) of all chunks, each line end a line feed; null contents stay."""
    return table(spark, root, "chunks").select("chunk_id", F.regexp_replace("content", r"\r\n?", "\n").alias("content")).distinct()


@query(rf"""with c as (select distinct chunk_id, {_ONE_END} as content from chunks)
select distinct chunk_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?m)Copied!$', '', 'g'), 'Copied!\s*```', '```', 'g'), '```\s*Copied!', '```', 'g'), 'Copied!(\s|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{0b}}\x{{85}}\x{{a0}}]+|[\s\x{{0b}}\x{{85}}\x{{a0}}]+$', '', 'g') as content from c""")
def md_clean(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root).select("chunk_id", T.clean_content(F.col("content")).alias("content")).distinct()


_SECTIONS = r"""e as (select distinct chunk_id, regexp_replace(content, '\r\n|[\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g') as content from chunks where content is not null),
c as (select chunk_id, case when ends_with(content, chr(10)) then left(content, -1) else content end as content from e),
l as (select chunk_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as i from c),
h as (select *, trim(line, ' ' || chr(9)) as t, regexp_matches(trim(line, ' ' || chr(9)), '^#{1,6}\s+\S') as head from l),
s as (select *, sum(case when head then 1 else 0 end) over (partition by chunk_id order by i) as sec, case when head then len(regexp_extract(t, '^(#{1,6})', 1)) end as lvl,
  case when head then trim(regexp_replace(t, '^#{1,6}\s+', ''), ' ' || chr(9)) end as title from h),
p as (select *, case when head then least(sec, sec + min(case when head then lvl - sec end) over (partition by chunk_id order by i)) end as pos from s),
k as (select *, """ + ", ".join(f"last_value(case when pos = {j} then title end ignore nulls) over (partition by chunk_id order by i) as t{j}" for j in range(1, 7)) + r""",
  last_value(pos ignore nulls) over (partition by chunk_id order by i) as depth from p),
g as (select chunk_id, sec, coalesce(array_to_string(list_slice([""" + ", ".join(f"any_value(t{j})" for j in range(1, 7)) + r"""], 1, any_value(depth)), ' > '), '') as path, string_agg(line, chr(10) order by i) as content from k group by chunk_id, sec)"""


@query(f"with {_SECTIONS} " + r"select chunk_id, path, md5(content) as section from g where not regexp_matches(content, '^[\s\x{85}\x{a0}]*$')")
def heading_split(spark: SparkSession, root: str) -> DataFrame:
    rows = table(ready(spark), root, "chunks").select("chunk_id", "content").distinct()
    return K.heading_sections(rows, "chunk_id", "content").select("chunk_id", "path", F.md5("content").alias("section"))


@query(r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents where text is not null), p as (select doc_id, unnest(range(0, greatest(1, len(w) - 20), 80)) as pos, w from w where len(w) > 0)
select doc_id as document_id, cast(pos // 80 as int) as "window", md5(array_to_string(w[pos + 1 : pos + 100], ' ')) as tokens from p""")
def chunk_fixed(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.col("text").alias("markdown"))
    return K.fixed_windows(rows, 100, 20).withColumn("tokens", F.md5("tokens"))


@query()
def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    rows = table(ready(spark), root, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.col("text").alias("markdown"))
    return K.chunk_markdown(spread(rows), "xslim")


@query("""select distinct chunk_id, document_id, chunk_index, module, coalesce(submodule, '') as submodule, version_major, version_minor, content_type, section_path, has_code, false as has_deprecation,
 array_to_string(list_sort(list_distinct([module, content_type])), ',') as tags from chunks""")
def chunk_metadata(spark: SparkSession, root: str) -> DataFrame:
    meta = K.chunk_metadata(table(spark, root, "chunks").distinct())
    return meta.withColumn("chunk_id", F.concat_ws("-", "document_id", F.col("chunk_index").cast("string"))).distinct()


@query(rf"""with c as (select distinct chunk_id, {_ONE_END} as content from chunks)
select chunk_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(content, '@(\w+)(?:\([^)]*\))?', 1))), ','), '') as annotations,
 coalesce(nullif(trim(regexp_extract(content, '(?m)^\s*# (.*)$', 1), ' '), ''), '') as heading from c""")
def chunk_marks(spark: SparkSession, root: str) -> DataFrame:
    rows = _chunks(spark, root)
    return rows.select("chunk_id", F.coalesce(F.array_join(T.annotations(F.col("content")), ","), F.lit("")).alias("annotations"), T.first_heading(F.col("content"), F.lit("")).alias("heading"))


_LANGUAGE = r"""case when regexp_matches(css, '(?i)java') then 'java' when regexp_matches(css, '(?i)kotlin|kt') then 'kotlin' when regexp_matches(css, '(?i)groovy') then 'groovy' when regexp_matches(css, '(?i)xml') then 'xml' when regexp_matches(css, '(?i)ya?ml') then 'yaml'
 when regexp_matches(css, '(?i)properties|props') then 'properties' when regexp_matches(css, '(?i)json') then 'json' when regexp_matches(css, '(?i)sh|bash|shell|zsh') then 'shell' when regexp_matches(css, '(?i)sql') then 'sql' else 'java' end"""


@query(rf"""with c as (select distinct chunk_id, {_ONE_END} as content from chunks where content is not null),
b as (select distinct chunk_id, unnest(regexp_extract_all(content, '(?m)^(?:```|~~~)([A-Za-z]+)$', 1)) as css from c)
select chunk_id, css, {_LANGUAGE} as language from b""")
def code_languages(spark: SparkSession, root: str) -> DataFrame:
    """Every fence of every chunk that names a language."""
    css = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^(?:```|~~~)([A-Za-z]+)$"), F.lit(1)))
    rows = _chunks(spark, root).select("chunk_id", css.alias("css")).distinct()
    return rows.select("chunk_id", "css", T.code_language(F.col("css")).alias("language"))


_STRIP = r"regexp_replace({0}, '^[\s\x0b\x{{85}}\x{{a0}}]+|[\s\x0b\x{{85}}\x{{a0}}]+$', '', 'g')"
_NOISE = "text"
for _pattern, _keep in ((r"(?is)<!--\s*nav\s*-->.*?<!--\s*/nav\s*-->", ""), (r"(?is)##?\s+See\s+also.*?(\n##?|\z)", r"\1"), (r"(?i)---\s*\n.*?Back\s+to\s+top.*?\n", ""), (r"(?m)^\[\[.*?\]\]\s*$", ""), (r"(?i)\[Edit this page\].*?\n", "")):
    _NOISE = f"regexp_replace({_NOISE}, '{_pattern}', '{_keep}', 'g')"
_NOISE = _STRIP.format(f"regexp_replace({_NOISE}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(rf"""with d as (select doc_id, replace(content_type, '-', '_') as tag, regexp_replace(text, '\r\n?|[\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') as text from documents where text is not null),
c as (select doc_id, tag, {_NOISE} as md from d),
p as (select doc_id, unnest(string_split(regexp_replace(md, '(?m)^(##\s+.*)$', chr(1) || '\1', 'g'), chr(1))) as p, generate_subscripts(string_split(regexp_replace(md, '(?m)^(##\s+.*)$', chr(1) || '\1', 'g'), chr(1)), 1) as i from c),
h as (select doc_id, i, p, regexp_matches(p, '\A##\s+.*') as is_head, regexp_extract(p, '\A(##\s+[^\n]*)', 1) as head, trim(regexp_replace(regexp_replace(p, '\A##\s+[^\n]*', ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g'), ' ') as body from p),
x as (select doc_id, i, is_head, case when is_head then '  <section name="' || regexp_replace(replace(lower(trim(replace(head, '##', ''), ' ')), ' ', '_'), '[()]', '', 'g') || '" title="' || trim(replace(head, '##', ''), ' ') || '">' || chr(10) || '    ' || head || chr(10) || '    ' || body || chr(10) || '  </section>'
  else regexp_replace(p, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') end as piece from h),
j as (select doc_id, bool_or(is_head) as headed, coalesce(string_agg(piece, chr(10) order by i) filter (piece <> ''), '') as pieces from x group by doc_id)
select doc_id, '<' || tag || ' version="1.0.0">' || chr(10) || case when headed then pieces else md end || chr(10) || '</' || tag || '>' as tagged from c join j using (doc_id)""")
def wiki_tagged(spark: SparkSession, root: str) -> DataFrame:
    """All documents as wiki pages, every line end a line feed."""
    rows = table(spark, root, "documents").where("text is not null").select("doc_id", "content_type", F.regexp_replace("text", r"\r\n?|[\x{85}\x{2028}\x{2029}]", "\n").alias("text"))
    return rows.select("doc_id", W.tag_sections(T.clean_wiki_noise(F.col("text")), F.col("content_type"), F.lit("1.0.0")).alias("tagged"))


@query(r"""with b as (select query_id, lower(query) as query, doc_id, max(score) as score from bm25_results group by all)
select query_id, doc_id, cast(row_number() over (partition by query_id order by score desc nulls last, doc_id) as int) as place from b""")
def logged_ranking(spark: SparkSession, root: str) -> DataFrame:
    """The log of keyword searches as one ranking a query: repeats once, missing scores last."""
    from lorekiln.operators.ranks import rank_in_buckets

    one = table(spark, root, "bm25_results").groupBy("query_id", F.lower("query").alias("query"), "doc_id").agg(F.max("score").alias("score"))
    bucket = -F.floor(F.coalesce(F.col("score"), F.lit(-1e9)))
    ranked = rank_in_buckets(one, ["query_id"], bucket, [F.col("score").desc_nulls_last(), F.col("doc_id")], "place")
    return ranked.select("query_id", "doc_id", F.col("place").cast("int").alias("place"))


@query()
def embedded_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of all chunks by the deterministic stand-in strategy."""
    from lorekiln.operators.embedding import embed, hashing_strategy

    rows = table(ready(spark), root, "chunks").select("chunk_id", "content").distinct()
    return embed(rows, "chunk_id", "content", hashing_strategy(32))


@query("""with one as (select chunk_id, module, coalesce(submodule, '') as submodule, version_major from chunks group by all)
select chunk_id from one where not (module = 'spring-boot' and submodule = '' and version_major = 4)""")
def vectors_deleted(spark: SparkSession, root: str) -> DataFrame:
    from lorekiln.operators.embedding import delete_vectors

    rows = table(spark, root, "chunks").select("chunk_id", "module", F.coalesce("submodule", F.lit("")).alias("submodule"), "version_major").distinct()
    return delete_vectors(rows, module="spring-boot", major=4).select("chunk_id")
