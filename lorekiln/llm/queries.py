"""The named queries of this sub-package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import boilerplate, distinctive, markup, packing, reading, residue, score_fusion, splitting, tokenizing
from lorekiln.session import ready
from lorekiln.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return markup.marked_chunks(spread(table(ready(spark), root, "chunks").select("chunk_id", "content")))


def p1_clean(spark: SparkSession, root: str) -> DataFrame:
    return markup.clean_chunks(spread(table(ready(spark), root, "chunks").select("chunk_id", "content"))).distinct().select("chunk_id", "clean", "has_code")


def p1_shared(spark: SparkSession, root: str) -> DataFrame:
    """Lines of chunks that the nearest pages share: the page differencing, for comparison with p1_found."""
    return residue.shared_chunk_lines(table(ready(spark), root, "chunks"), table(spark, root, "document_records"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return score_fusion.head_candidates(table(spark, root, "search_candidates"))


def p2_ranking(spark: SparkSession, root: str) -> DataFrame:
    ranked = score_fusion.rank_fused(table(spark, root, "search_candidates"))
    return ranked.select("query_id", "chunk_id", F.round("fused", 6).alias("fused"), "rank")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return distinctive.shared_rare_terms(table(spark, root, "chunks"))


def p3_top_terms(spark: SparkSession, root: str) -> DataFrame:
    """The five most characteristic terms of each chunk; ties by the term."""
    return distinctive.top_terms(table(spark, root, "chunks"))


def p3_logged_terms(spark: SparkSession, root: str) -> DataFrame:
    """The weight, in the chunk found, of each term of the logged keyword searches; 0 where the chunk lacks the term."""
    log = table(spark, root, "bm25_results").where("doc_id is not null")
    token = F.explode(F.regexp_extract_all(F.lower("query"), F.lit(distinctive.TOKEN), F.lit(0)))
    asked = log.groupBy("query_id", F.lower("query").alias("query"), "doc_id").agg(F.max("score").alias("score")).select("query_id", "doc_id", "score", token.alias("asked")).distinct()
    weights = distinctive.term_weights(table(spark, root, "chunks")).groupBy("chunk_id", "term").agg(F.max("weight").alias("weight"))
    joined = asked.join(weights, (F.col("doc_id") == F.col("chunk_id")) & (F.col("asked") == F.col("term")), "left")
    return joined.select("query_id", "doc_id", F.col("asked").alias("term"), "score", F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(ready(spark), root, "page_sections"))


def p5_body(spark: SparkSession, root: str) -> DataFrame:
    return boilerplate.page_bodies(table(ready(spark), root, "page_sections"))


def _chunk_texts(spark: SparkSession, root: str) -> DataFrame:
    return table(ready(spark), root, "chunks").select("chunk_id", "document_id", "section_path", "tier", "content")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    pieces = splitting.split_oversized(spread(_chunk_texts(spark, root)), table(spark, root, "vector_config"), only_oversized=True)
    return pieces.where("pieces > 1").select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(spread(_chunk_texts(spark, root)), table(spark, root, "vector_config"))


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(ready(spark), root, "documents").select("doc_id", "source", "text"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizing.encode_texts(_texts(spark, root))


def p8_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, same): whether the decoded ids give the text back, null and empty texts both as an empty one."""
    ids = tokenizing.encode_texts(_texts(spark, root))
    back = tokenizing.decode_ids(ids).withColumnRenamed("text", "back")
    given = table(spark, root, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return given.join(back, "doc_id").select("doc_id", (F.xxhash64("text") == F.xxhash64("back")).alias("same"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return packing.divided(packing.packed(_texts(spark, root), table(spark, root, "pack_limits")))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    """(container, texts, tokens) of every container."""
    placed = packing.packed(_texts(spark, root), table(spark, root, "pack_limits"))
    return placed.where("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return reading.reading_levels(_texts(spark, root), table(spark, root, "reading_labels")).where("level = 4").select("doc_id")


def p10_levels(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, language, level) of each document with prose."""
    return reading.reading_levels(_texts(spark, root), table(spark, root, "reading_labels")).select("doc_id", "language", "level")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p1_clean, p1_shared, p2_found, p2_ranking, p3_found, p3_top_terms, p3_logged_terms, p5_found, p5_body, p7_found, p7_pieces,
        p8_ids, p8_roundtrip, p9_found, p9_containers, p10_found, p10_levels,
    )}


_TOKENS = r"[\p{L}\p{N}_]+"

_TERMS = rf"""
with once as (select distinct chunk_id, document_id, content from chunks where content is not null),
words as (select chunk_id, document_id, lower(unnest(regexp_extract_all(content, '{_TOKENS}'))) as term from once),
counts as (select chunk_id, document_id, term, count(*) as n from words group by all),
stats as (select term, sum(n) as total, count(distinct document_id) as documents from counts group by term)
"""

SQL = {
    "p2_found": """
with clean as (
  select query_id, chunk_id, scored_at, case when isnan(dense_score) then null else dense_score end as d,
         case when isnan(sparse_score) then null else sparse_score end as s from search_candidates),
latest as (select *, row_number() over (partition by query_id, chunk_id order by scored_at desc nulls last, d desc nulls last, s desc nulls last) as r from clean),
ranked as (select query_id, chunk_id, d, s, rank() over (partition by query_id order by d desc nulls last) as rd,
         rank() over (partition by query_id order by s desc nulls last) as rs from latest where r = 1)
select query_id, chunk_id from ranked where d is not null and s is not null and rd <= 3 and rs <= 3""",
    "p2_ranking": """
with clean as (
  select query_id, chunk_id, scored_at, case when isnan(dense_score) then null else dense_score end as d,
         case when isnan(sparse_score) then null else sparse_score end as s from search_candidates),
latest as (select query_id, chunk_id, d, s from (select *, row_number() over (partition by query_id, chunk_id order by scored_at desc nulls last, d desc nulls last, s desc nulls last) as r from clean) where r = 1),
mid as (select query_id, quantile_disc(d, 0.5) as dm, quantile_disc(s, 0.5) as sm from latest group by query_id),
spread as (select query_id, any_value(dm) as dm, any_value(sm) as sm, quantile_disc(abs(d - dm), 0.5) as dd, avg(abs(d - dm)) as da, quantile_disc(abs(s - sm), 0.5) as sd, avg(abs(s - sm)) as sa
  from latest join mid using (query_id) group by query_id),
z as (select query_id, chunk_id, d, s, (d - dm) / nullif(case when dd > 0 then dd * 1.4826 else da end, 0) as zd, (s - sm) / nullif(case when sd > 0 then sd * 1.4826 else sa end, 0) as zs, dm, sm from latest join spread using (query_id)),
unit as (select query_id, chunk_id,
  case when d is null then 0.0 when zd is null then case when d > dm then 1.0 when d < dm then 0.0 else 0.5 end else 1.0 / (1.0 + exp(-zd)) end as ud,
  case when s is null then 0.0 when zs is null then case when s > sm then 1.0 when s < sm then 0.0 else 0.5 end else 1.0 / (1.0 + exp(-zs)) end as us from z),
fused as (select query_id, chunk_id, case when ud <= 0 or us <= 0 then 0.0 else round(exp(0.5 * ln(ud) + 0.5 * ln(us)), 12) end as f from unit)
select query_id, chunk_id, round(f, 6) as fused, row_number() over (partition by query_id order by f desc, chunk_id) as rank from fused""",
    "p3_logged_terms": _TERMS + rf"""
, lengths as (select chunk_id, document_id, sum(n) as length from counts group by all),
whole as (select sum(length) as tokens, sum(pow(length, 0.75)) as contexts from lengths),
weights as (select chunk_id, term, max(greatest(0.0, ln((n / tokens) / ((total / tokens) * (pow(length, 0.75) / contexts))))) as weight
  from counts join stats using (term) join lengths using (chunk_id, document_id), whole group by all),
asked as (select distinct query_id, doc_id, score, unnest(regexp_extract_all(query, '{_TOKENS}')) as term
  from (select query_id, lower(query) as query, doc_id, max(score) as score from bm25_results where doc_id is not null group by all))
select query_id, doc_id, a.term, score, round(coalesce(weight, 0.0), 6) as weight from asked a left join weights w on w.chunk_id = a.doc_id and w.term = a.term""",
    "p3_top_terms": _TERMS + r"""
, lengths as (select chunk_id, document_id, sum(n) as length from counts group by all),
whole as (select sum(length) as tokens, sum(pow(length, 0.75)) as contexts from lengths),
weights as (select chunk_id, document_id, term, round(greatest(0.0, ln((n / tokens) / ((total / tokens) * (pow(length, 0.75) / contexts)))), 6) as weight
  from counts join stats using (term) join lengths using (chunk_id, document_id), whole),
placed as (select *, row_number() over (partition by chunk_id, document_id order by weight desc, term) as place from weights)
select chunk_id, document_id, cast(place as int) as place, term, weight from placed where place <= 5""",
    "p3_found": _TERMS + r"""
select distinct chunk_id, term from counts join stats using (term)
where n >= 3 and documents between 2 and 6 and length(term) >= 6 and regexp_full_match(term, '\p{L}+')""",
    "p8_roundtrip": "select doc_id, true as same from documents",
    "p7_found": r"""
select distinct chunk_id from chunks join vector_config using (tier)
where len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\t\n\x{0b}\f\r\x{85}]')) > max_tokens""",
}
