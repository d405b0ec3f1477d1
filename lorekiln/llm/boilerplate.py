"""Telling page boilerplate from the body of web pages.

Method: nearest-URL page differencing. Within each host, pages are ordered by URL path and each is compared with its nearest
neighbours; their lines are aligned by longest common subsequence, and shared lines are candidates for deletion. A shared
line may still be body (a stock phrase, a line of code), and a page may have no neighbour at all. So what the comparisons
find is gathered over the corpus by line form: a form that is shared, and lies outside the body in nearly all pages that
have it, is template, wherever it stands. Lists of page titles under a form that usually heads such lists go with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekiln.llm.differencing import shared_with_nearest
from lorekiln.session import discard, settled

#: A template form occurs on at least LEAST_PAGES pages and outside the body on nearly all of them: outside / (pages + 1).
LEAST_PAGES, OUTSIDE = 3, 0.66
#: A form heads lists when so many of its pages go on with a title line.
HEADS_LIST = 0.5
#: Words of a line that may be a sentence of the body.
SENTENCE_WORDS = 5
#: A table of fewer rows is broadcast; a larger one is joined by shuffle, with the same result.
BROADCAST_ROWS = 200_000

_BULLET = re.compile(r"^(?:[•·▪‣◦»›*+\-–—]\s+)+")
# these begin with the character they look for, which lets the search skip to it
_CAMEL = re.compile(r"[A-Z](?<!\w[A-Z])[a-z0-9]+(?:[A-Z][a-z0-9]*)+\b")
_DIGITS = re.compile(r"\d+")
_SEPARATOR = re.compile(r"[·|»›>/—–](?<=\s.)(?=\s)")
_COLON = re.compile(r"^([^:.!?]+?)\s?:\s+\S")
_SENTENCE = re.compile(r"[.!?…](?=\s+\S)")


def _masked(text: str) -> str:
    """Lower case, class names and numbers masked."""
    return _DIGITS.sub("#", _CAMEL.sub("~", text).lower())


def line_facts(line: str) -> tuple[str, str, list[str]]:
    """(form, title, parts) of a stripped line: all masked, without bullet.

    The form is the whole line, or of a line of several parts the first one: the start of a path or menu with its separator,
    the label before a colon, the first sentence. The title is the whole line as a title is masked. The parts are those that
    separators divide, as of a menu or path; none of another line.
    """
    text = _BULLET.sub("", line)
    separator = _SEPARATOR.search(text)
    sentence = _SENTENCE.search(text, 1)
    title = _masked(text)
    if sentence and not (separator and separator.start() < sentence.end()):
        form = _masked(text[: sentence.end()])
    elif separator:
        form = _masked(text[: separator.start()].rstrip() + " " + separator.group(0))
    elif ":" in text and (colon := _COLON.match(text)):
        form = _masked(colon.group(1) + ":")
    else:
        form = title
    return form, title, [_masked(_BULLET.sub("", p.strip())) for p in _SEPARATOR.split(text)] if separator else []


def title_form(text: str) -> str:
    """A title in lower case, class names and numbers masked, without bullet."""
    return _masked(_BULLET.sub("", text.strip()))


def line_form(line: str, brand: str) -> str:
    """What a line has in common with its counterparts on other pages: its form, the site's name masked as well."""
    return _branded(line_facts(line.strip())[0], brand)


def _branded(form: str, brand: str) -> str:
    return form.replace(brand, "*") if len(brand) >= 3 else form


def line_parts(line: str) -> list[str]:
    """The masked parts of a line that separators divide; none for another line."""
    return line_facts(line.strip())[2]


def site_name(host: str) -> str:
    """The label of a host that names the site: the one before the last."""
    parts = [p for p in host.lower().split(":")[0].split(".") if p]
    return parts[-2] if len(parts) > 1 else (parts[0] if parts else "")


def hashed(text: str) -> int:
    """A 64-bit hash of a form, as a signed number."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


#: The form of a part that is one class name.
NAME = hashed("~")

_FORMS = (
    "page bigint, page_id bigint, site bigint, path string, query string, same string, section array<int>, line array<int>, form array<bigint>, title array<bigint>, "
    "words array<boolean>, menus array<struct<at int, parts array<bigint>>>, titles array<bigint>"
)


def _place(sections: DataFrame) -> DataFrame:
    """The sections with host, path and query of their url; a null url is a host of its own. Rows without page_id are left out."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:\w+:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:\w+:)?(?://[^/?#]*)?([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    rows = sections.where("page_id is not null")
    return rows.select("page_id", "section_ord", "scraped_at", "title", "content", host.alias("host"), path.alias("path"), query.alias("query"))


def _latest(*columns: str) -> Column:
    """The latest row of a group by scraped_at, a null being the latest; ties go to the larger values."""
    return F.max(F.struct(F.col("scraped_at").isNull().alias("n"), "scraped_at", *columns))


def page_forms(sections: DataFrame) -> DataFrame:
    """One row a page, an id at one address: the forms of its non-blank lines as hashes, in reading order.

    Of repeated rows of a section the latest counts (ties: the larger title and content), folded on the map side; a page's
    sections then meet in one row. `same` is a digest of its text.
    """
    once = _place(sections).groupBy("host", "path", "page_id", "section_ord").agg(_latest("title", "content", "query").alias("r"))
    part = F.struct("section_ord", "r.title", "r.content")
    pages = once.groupBy("host", "path", "page_id").agg(F.array_sort(F.collect_list(part)).alias("s"), F.min("r.query").alias("query"))
    source = pages.select(F.xxhash64("host", "path", "page_id").alias("page"), "page_id", F.xxhash64("host").alias("site"), "host", "path", "query", "s")
    target = T._parse_datatype_string(_FORMS)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        titles: dict[str, int | None] = {}

        def facts(line: str, brand: str) -> tuple:
            got = known.get(line)
            if got is None:
                form, whole, parts = line_facts(line)
                got = form, hashed(form), hashed(whole), len(form.split()) >= SENTENCE_WORDS, [hashed(p) for p in parts]
                if len(known) > 100_000:  # a cache only
                    known.clear()
                known[line] = got
            form = got[0]
            return (hashed(_branded(form, brand)) if len(brand) >= 3 and brand in form else got[1], *got[2:])

        def title(text: str) -> int | None:
            """Null for a title of one word, which is no list item to be told from other lines."""
            if text not in titles:
                if len(titles) > 100_000:
                    titles.clear()
                form = title_form(text)
                titles[text] = hashed(form) if " " in form else None
            return titles[text]

        def page(row: dict) -> tuple:
            brand = site_name(row["host"])
            section, number, form, titled, words, menus, names = [], [], [], [], [], [], set()
            digest = xxhash.xxh3_128()
            for s in row["s"]:
                digest.update(repr((s["section_ord"], s["title"], s["content"])).encode("utf-8", "surrogatepass"))
                if s["title"] is not None:
                    names.add(title(s["title"]))
                for i, line in enumerate((s["content"] or "").split("\n"), 1):
                    if line.strip():
                        f, t, w, parts = facts(line.strip(), brand)
                        if parts:
                            menus.append({"at": len(form), "parts": parts})
                        section.append(s["section_ord"])
                        number.append(i)
                        form.append(f)
                        titled.append(t)
                        words.append(w)
            names.discard(None)
            return row["page"], row["page_id"], row["site"], row["path"], row["query"], digest.hexdigest(), section, number, form, titled, words, menus, sorted(names)

        for b in batches:
            for k in range(0, b.num_rows, 128):
                columns = zip(*map(page, b.slice(k, 128).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

    return source.mapInArrow(run, target)


def _look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join that broadcasts the table where it is small for certain; beyond, the shuffle join splits hot keys."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, key, "left")


def compared_pages(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages with `shared` and `neighbours`, and (page_id, other): the pages that are copies of one of them, by its page_id.

    Pages of one path and equal text are one page: one of them is compared, and the others get its lines. All others are
    different pages, also where they share a path or have no url, next to each other by query and text.
    """
    forms = settled(page_forms(sections), "forms")
    short = forms.groupBy("site", "path", "same").agg(F.min_by("page", "page_id").alias("page"), F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = settled(short.drop("n"), "groups")
    names = ["site", "path", "same"]
    marked = forms.select("page", "page_id", *names).withColumnsRenamed({"page": "p", "page_id": "other"})
    small = groups.count() <= BROADCAST_ROWS
    others = settled(marked.join(F.broadcast(groups) if small else groups, names).where("p <> page").select("page_id", "p", "other"), "others")
    gone = others.select(F.col("p").alias("page"))
    once = forms.join(F.broadcast(gone) if others.count() <= BROADCAST_ROWS else gone, "page", "left_anti")
    compared = shared_with_nearest(once, ["site", "path", "query", "same", "page"], "compared")
    discard(forms, groups)
    return compared, others.select("page_id", "other")


def marked_lines(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """The lines of the pages, one row each, with what their page says about them; written down.

    `titles` has the hashes of all titles, by themselves and with their site. `heads`: a title of the site follows and none
    precedes. `outside`: before the first or after the last sentence of the page, an unshared line of SENTENCE_WORDS words
    that is no title of the site and whose form few pages have; null on a page without one, from which nothing is learned.
    `anchor` and `run`: form and place of the last line above that is no title at all.
    """
    zipped = F.arrays_zip("section", "line", "form", "title", "words", "shared")
    lines = pages.select("site", "page", "page_id", (F.col("neighbours") > 0).alias("learn"), F.posexplode(zipped).alias("ord", "l")).select("site", "page", "page_id", "learn", "ord", "l.*")
    lines = lines.withColumn("own", F.xxhash64("site", "title")).drop("site")
    often = settled(pages.select(F.explode(F.array_distinct("form")).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES).select("form", F.lit(True).alias("often")), "often")
    known = _look_up(_look_up(lines, often, "form"), titles, "title")
    known = _look_up(known, titles.withColumnsRenamed({"title": "own", "is_title": "is_own"}), "own")
    sentence = F.col("words") & ~F.col("shared") & F.col("often").isNull() & F.col("is_own").isNull()
    flat = known.select("page", "page_id", "learn", "ord", "section", "line", "form", "shared", F.col("is_title").isNotNull().alias("is_title"), F.col("is_own").isNotNull().alias("is_own"), sentence.alias("sentence"))
    page = Window.partitionBy("page")
    row = page.orderBy("ord")
    body = F.when(F.col("sentence"), F.col("ord"))
    heads = F.lead("is_own", 1, False).over(row) & ~F.lag("is_own", 1, False).over(row)
    above = F.last(F.when(~F.col("is_title"), F.struct("form", "ord")), ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, -1))
    spans = flat.withColumns({"heads": heads, "above": above, "__lo": F.min(body).over(page), "__hi": F.max(body).over(page)})
    outside = (F.col("ord") < F.col("__lo")) | (F.col("ord") > F.col("__hi"))
    out = settled(spans.select("page", "page_id", "learn", "ord", "section", "line", "form", "shared", "is_title", "heads", F.col("above.form").alias("anchor"), F.coalesce("above.ord", F.lit(-1)).alias("run"), outside.alias("outside")), "lines")
    discard(often)
    return out


def template_forms(lines: DataFrame) -> DataFrame:
    """(form, heads_list): the forms that are template, learned from all pages that had a neighbour.

    A form is template when two neighbours share it, LEAST_PAGES pages have it, and it is outside the body on nearly all of
    them or heads lists.
    """
    rows = lines.where(F.col("learn") & F.col("outside").isNotNull())
    flag = lambda c: F.col(c).cast("int").alias(c)
    per_page = rows.select("form", "page", flag("shared"), flag("outside"), flag("heads")).groupBy("form", "page").agg(F.max("shared").alias("shared"), F.min("outside").alias("outside"), F.max("heads").alias("heads"))
    forms = per_page.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.sum("shared").alias("s"), F.sum("outside").alias("o"), F.sum("heads").alias("t"))
    outside = F.col("o") / (F.col("n") + 1) >= OUTSIDE
    heads = F.col("t") / (F.col("n") + 1) >= HEADS_LIST
    return forms.where((F.col("n") >= LEAST_PAGES) & (F.col("s") >= 1) & (outside | heads)).select("form", heads.alias("heads_list"))


def boilerplate_lines(sections: DataFrame) -> DataFrame:
    """(page_id, section_ord, line_no) of the lines that are not body, lines counted from 1 with the blank ones.

    A line is boilerplate when its form is template, when it is a menu or path of template forms and titles, or when it is a
    title standing in a list under a form that heads lists. Blank lines never are. Null contents have no lines, pages
    without neighbours are judged by the forms alone.
    """
    pages, others = compared_pages(sections)
    given = pages.select("site", F.explode("titles").alias("title"))
    titles = settled(given.select(F.explode(F.array("title", F.xxhash64("site", "title"))).alias("title")).distinct().withColumn("is_title", F.lit(True)), "titles")
    lines = marked_lines(pages, titles)
    forms = settled(template_forms(lines), "templates")
    lists = forms.where("heads_list").select(F.col("form").alias("anchor"), F.lit(True).alias("under"))
    judged = _look_up(_look_up(lines, forms.withColumn("template", F.lit(True)), "form"), lists, "anchor")
    # a run of title lines is a list below the line above it, and below a title in it, where these head lists
    head = F.col("is_title") & F.coalesce("heads_list", F.lit(False))
    runs = settled(judged.where(head).groupBy("page", "run").agg(F.min("ord").alias("first")), "runs")
    items = judged.where(F.col("is_title") & F.col("template").isNull()).join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, ["page", "run"], "left")
    listed = items.where(F.col("under").isNotNull() | (F.col("ord") > F.col("first")))
    found = judged.where("template is not null").unionByName(listed, allowMissingColumns=True).select("page_id", "section", "line").unionByName(menu_lines(pages, forms, titles))
    copies = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    repeated = found.join(copies, "page_id").select(F.col("other").alias("page_id"), "section", "line")
    return found.unionByName(repeated).distinct().select("page_id", F.col("section").alias("section_ord"), F.col("line").alias("line_no"))


def menu_lines(pages: DataFrame, forms: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines of several parts of which one at least is a template form of its own, and half are such forms or titles."""
    menus = pages.select("page_id", "section", "line", F.explode("menus").alias("m")).select("page_id", F.get("section", F.col("m.at")).alias("section"), F.get("line", F.col("m.at")).alias("line"), F.size("m.parts").alias("n"), "m.parts")
    parts = menus.select("page_id", "section", "line", "n", F.explode("parts").alias("form"))
    known = _look_up(parts, forms.where("not heads_list").select("form", F.lit(1).alias("t")), "form")
    known = _look_up(known.withColumn("title", F.col("form")), titles, "title")
    title = F.when(F.col("t").isNull() & (F.col("is_title").isNotNull() | (F.col("form") == NAME)), 1)
    counted = known.groupBy("page_id", "section", "line", "n").agg(F.count("t").alias("t"), F.count(title).alias("p"))
    return counted.where("t >= 1 and 2 * (t + p) >= n").select("page_id", "section", "line")


def page_bodies(sections: DataFrame) -> DataFrame:
    """(page_id, section_ord, body): the text of each section without its boilerplate lines; blank lines stay."""
    bad = boilerplate_lines(sections).groupBy("page_id", "section_ord").agg(F.collect_set("line_no").alias("bad"))
    rows = sections.where("page_id is not null").groupBy("page_id", "section_ord").agg(_latest("title", "content").alias("r")).select("page_id", "section_ord", "r.content")
    lines = F.split(F.col("content"), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    kept = F.filter(numbered, lambda s: ~F.coalesce(F.array_contains("bad", s["i"]), F.lit(False)))
    joined = rows.join(bad, ["page_id", "section_ord"], "left")
    return joined.select("page_id", "section_ord", F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("body"))
