"""Queries over HTML pages and links. The tables hold sections of pages; their HTML is put together from these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.functions.text import xml_escape
from lorekiln.functions.url import base_path
from lorekiln.operators import discovery, pages
from lorekiln.session import ready
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


def html_pages(spark: SparkSession, root: str) -> DataFrame:
    """(url, html): each page's sections under headings in a main element, with links to the sections in a side bar."""
    rows = table(spark, root, "page_sections").groupBy("page_id", "section_ord").agg(F.max(F.struct("url", "section_id", "title", "level", "content")).alias("r")).select("page_id", "section_ord", "r.*")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2)))).cast("string")
    title = xml_escape(F.coalesce("title", F.lit("")))
    name = F.coalesce("section_id", F.concat(F.lit("s"), F.col("section_ord").cast("string")))
    body = F.concat(F.lit("<h"), level, F.lit(' id="'), name, F.lit('">'), title, F.lit("</h"), level, F.lit("><p>"), xml_escape(F.coalesce("content", F.lit(""))), F.lit("</p>"))
    link = F.concat(F.lit('<li><a href="section-'), F.col("section_ord").cast("string"), F.lit('.html">'), title, F.lit("</a></li>"))
    part = F.struct("section_ord", body.alias("body"), link.alias("link"), title.alias("title"))
    one = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.max("url").alias("url"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    html = F.concat(
        F.lit("<html><head><title>"), F.col("p")[0]["title"], F.lit('</title></head><body><nav class="toc"><ul>'), joined("link"), F.lit("</ul></nav><main>"), joined("body"),
        F.lit("</main><footer>end</footer></body></html>"),
    )
    return one.select(F.concat_ws("#p", F.regexp_replace("url", "[?#].*$", ""), F.col("page_id").cast("string")).alias("url"), html.alias("html"))


@query()
def page_titles(spark: SparkSession, root: str) -> DataFrame:
    return pages.page_titles(html_pages(ready(spark), root))


@query()
def page_markdown(spark: SparkSession, root: str) -> DataFrame:
    return pages.page_markdowns(html_pages(ready(spark), root))


@query(r"""select count(*) as sections, count(distinct page_id) as pages from (select distinct page_id, section_ord from page_sections)""")
def section_counts(spark: SparkSession, root: str) -> DataFrame:
    found = pages.page_sections(html_pages(ready(spark), root))
    return found.agg(F.count(F.lit(1)).alias("sections"), F.count_distinct("url").alias("pages"))


@query()
def parsed_pages(spark: SparkSession, root: str) -> DataFrame:
    return pages.parse_pages(html_pages(ready(spark), root))


@query(r"""with s as (select page_id, section_ord, max(url) as url, arg_max(coalesce(title, ''), (coalesce(url, ''), coalesce(section_id, ''), coalesce(title, ''))) as title from page_sections group by page_id, section_ord),
u as (select page_id, regexp_replace(max(url), '[?#].*$', '') as url from s group by page_id),
l as (select u.url || '#p' || u.page_id as source, regexp_replace(case when regexp_matches(u.url, '^https?://[^/]*$') then u.url || '/' else u.url end, '[^/]*$', '') || 'section-' || section_ord || '.html' as target,
  trim(regexp_replace(title, '\s+', ' ', 'g')) as text, section_ord, s.page_id from s join u using (page_id) where u.url is not null and trim(title) <> ''),
n as (select *, row_number() over (partition by page_id order by section_ord) - 1 as ord from l)
select source, target, text, cast(ord as int) as ord from n where not regexp_matches(target, 'github\.com|stackoverflow\.com|mailto:') and not regexp_matches(target, '/api/|/javadoc/|/javadoc-api/')""")
def page_links(spark: SparkSession, root: str) -> DataFrame:
    return pages.page_links(html_pages(ready(spark), root))


_EDGES = "edges as (select distinct source, target from (select o_custkey as source, (o_orderkey * 7) % (select max(o_custkey) from orders) + 1 as target from orders) where source <> target)"


@query(f"""with recursive {_EDGES}, walk(url, depth) as (select 1::bigint, 0 union select e.target, w.depth + 1 from walk w join edges e on e.source = w.url where w.depth < 10)
select url, min(depth) as depth from walk group by url""")
def bfs_depth(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders")
    nodes = orders.agg(F.max("o_custkey")).scalar()
    edges = orders.select(F.col("o_custkey").alias("source"), ((F.col("o_orderkey") * 7) % nodes + 1).alias("target"))
    entry = spark.range(1, 2).select(F.col("id").alias("url"))
    return discovery.discover(edges, entry).select("url", "depth")


@query("""with f as (select url from documents where url is not null), n as (select count(distinct url) as d from f)
select count(*) as total, count(*) - count(distinct url) as duplicates, any_value(d) as discovered, greatest(0, count(*) - any_value(d) - (count(*) - count(distinct url))) as filtered from f, n""")
def discovery_counters(spark: SparkSession, root: str) -> DataFrame:
    found = table(spark, root, "documents").where("url is not null").select("url")
    return discovery.discovery_counters(found, found.distinct())


@query(r"""select base, count(*) as pages from (select regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as base from (select distinct url from documents where url is not null and regexp_matches(url, '\.html$'))) group by base""")
def base_paths(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where(F.col("url").rlike(r"\.html$")).select("url").distinct()
    return rows.groupBy(base_path(F.col("url")).alias("base")).agg(F.count(F.lit(1)).alias("pages"))
