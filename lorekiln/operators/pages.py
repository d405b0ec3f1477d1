"""HTML pages: titles, versions, links, sections, code, markdown. Parsing runs in Arrow batches, one row a page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorekiln.functions.text import LANGUAGES, collapse_space, sanitize_title
from lorekiln.functions.url import is_internal, normalize_url, resolve_url, skip_url
from lorekiln.functions.version import parse_version, version_key
from lorekiln.operators.dom import Node, first, parse, select

# Where titles, contents, side bars, code and versions stand, in order of preference.
TITLE = ["h1.title", "article h1", "main h1", "#content h1", "title"]
MAIN = ["article.doc", "main.content", "#content", "article", "main", ".doc-content"]
SIDEBAR = ["nav.toc", "aside.toc", ".book-toc", "#toc", ".nav-toc", "nav[role='navigation']", ".nav-list"]
CODE = ["pre code", ".listingblock pre", ".highlight pre", "pre.programlisting", "pre.code"]
VERSION = ["span.version"]
NO_TEXT = ["script", "style", "noscript", "iframe"]
NOISE = [
    "nav", "footer", "aside", ".toc", ".book-toc", "#toc", ".nav-toc", ".edit-link", ".edit-page-link", ".pagination", ".pager", ".pagination-controls",
    "a[rel='next']", "a[rel='prev']", ".next-page", ".prev-page", ".pagination-next", ".pagination-prev", "button.next", "button.prev",
    "button[aria-label='Next']", "button[aria-label='Previous']",
]


def clean_tree(html: str) -> Node:
    """The tree without scripts and noise; what stands in code is kept, as are version labels of removed parts."""
    root = parse(html)
    for n in select(root, ", ".join(NO_TEXT)):
        n.remove()
    for n in select(root, ", ".join(NOISE)):
        if n.tag in ("pre", "code") or n.inside("pre", "code"):
            continue
        for v in select(n, ", ".join(VERSION)):
            v.remove()
            (root.children[0] if root.children and root.children[0].tag else root).add(v)
        n.remove()
    return root


def title_of(root: Node, url: str | None) -> str | None:
    for m in select(root, "meta[property='og:title']"):
        if m.attrs.get("content", "").strip():
            return m.attrs["content"].strip()
    for s in TITLE:
        for n in select(root, s):
            if t := re.sub(r"\s+", " ", n.content()).strip():
                return t
    last = (url or "").split("#")[0].split("?")[0].rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return last.replace("-", " ").title() or None


def language_of(n: Node) -> str:
    for c in [*n.classes(), n.attrs.get("data-lang", ""), *(n.parent.classes() if n.parent and n.parent.tag == "pre" else [])]:
        name = re.sub(r"^(?:language-|lang-|highlight-source-)", "", c)
        for pattern, language in LANGUAGES:
            if name and re.search(pattern, name, re.I):
                return language
    return "java"


def _inline(n: Node) -> str:
    if not n.tag:
        return re.sub(r"\s+", " ", n.text)
    inner = "".join(_inline(c) for c in n.children)
    if n.tag == "br":
        return "\n"
    if n.tag in ("strong", "b"):
        return f"**{inner.strip()}**" if inner.strip() else inner
    if n.tag in ("em", "i"):
        return f"*{inner.strip()}*" if inner.strip() else inner
    if n.tag == "code":
        return f"`{n.content()}`"
    if n.tag == "a":
        href, title = n.attrs.get("href", ""), n.attrs.get("title", "")
        shown = inner.strip()
        return f"[{shown}]({href}" + (f' "{title}"' if title else "") + ")" if href and shown else inner
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})"
    return inner


_BLOCKS = frozenset("p div section article main ul ol li pre table h1 h2 h3 h4 h5 h6 blockquote dl dt dd tr header footer body html #root".split())


def markdown_of(n: Node, depth: int = 0) -> str:
    """Markdown of an element: `#` headings, `-` items, fenced code with its language, tables with a separator row."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = "".join(run).strip()
        run.clear()
        if text:
            out.append(text)

    for c in n.children:
        if c.tag not in _BLOCKS:
            run.append(_inline(c))
            continue
        flush()
        if len(c.tag) == 2 and c.tag[0] == "h":
            out.append("#" * int(c.tag[1]) + " " + re.sub(r"\s+", " ", "".join(map(_inline, c.children))).strip())
        elif c.tag == "pre":
            code = next(iter(select(c, "code")), c)
            out.append(f"```{language_of(code)}\n" + c.content().strip("\n") + "\n```")
        elif c.tag in ("ul", "ol"):
            items = [x for x in c.children if x.tag == "li"]
            lines = []
            for i, item in enumerate(items, 1):
                text = markdown_of(item, depth + 1).strip().replace("\n\n", "\n")
                lines.append(("- " if c.tag == "ul" else f"{i}. ") + text.replace("\n", "\n  "))
            out.append("\n".join(lines))
        elif c.tag == "table":
            rows = [[re.sub(r"\s+", " ", "".join(map(_inline, d.children))).strip().replace("|", "\\|") for d in r.children if d.tag in ("td", "th")] for r in select(c, "tr")]
            rows = [r for r in rows if r]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                out.append("\n".join([lines[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *lines[1:]]))
        elif c.tag == "blockquote":
            out.append("\n".join("> " + x for x in markdown_of(c, depth).splitlines()))
        else:
            if text := markdown_of(c, depth):
                out.append(text)
    flush()
    return "\n\n".join(out)


def page_markdown(html: str) -> str:
    root = clean_tree(html)
    main = first(root, MAIN) or first(root, ["body"]) or root
    text = re.sub(r"Copied!(?=\s|$)", "", markdown_of(main))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +", " ", text)).strip()


def sections_of(html: str) -> list[tuple[int, int | None, int, str, str, str]]:
    """(ord, parent_ord, level, id, title, markdown) of each headed section; what stands before the first heading has none."""
    root = clean_tree(html)
    main = first(root, MAIN) or root
    out: list[tuple] = []
    open_: list[tuple[int, int]] = []
    for h in [n for n in main.walk() if re.fullmatch(r"h[1-6]", n.tag)]:
        level = int(h.tag[1])
        title = re.sub(r"\s+", " ", h.content()).strip()
        body = Node("div")
        around = h.parent.children
        for s in around[around.index(h) + 1 :]:
            if re.fullmatch(r"h[1-6]", s.tag):
                break
            if s.tag:
                body.children.append(s)
        while open_ and open_[-1][1] >= level:
            open_.pop()
        name = re.sub(r"[^a-z0-9]+", "-", (h.attrs.get("id") or title).lower()).strip("-")[:50]
        out.append((len(out), open_[-1][0] if open_ else None, level, name, title, markdown_of(body)))
        open_.append((len(out) - 1, level))
    return out


def code_of(html: str) -> list[tuple[int, str, str, str | None, list[str]]]:
    """(ord, language, code, title, annotations) of each code block once; the title is a short paragraph right before it."""
    root = clean_tree(html)
    seen: list[Node] = []
    for s in CODE:
        for n in select(root, s):
            if not any(n is x or n.parent is x or x.parent is n for x in seen):
                seen.append(n)
    out = []
    for n in seen:
        code = n.content().strip("\n")
        if not code.strip():
            continue
        block = n.parent if n.parent and n.parent.tag == "pre" else n
        before = [x for x in (block.parent.children if block.parent else []) if x.tag]
        at = before.index(block)
        prev = before[at - 1] if at else None
        title = prev.content().strip() if prev is not None and prev.tag in ("p", "div") else ""
        language = language_of(n)
        marks = sorted(set(re.findall(r"@(\w+)(?:\([^)]*\))?", code))) if language in ("java", "kotlin") else []
        out.append((len(out), language, code, title if 0 < len(title) < 100 else None, marks))
    return out


def links_of(html: str) -> list[tuple[int, str, str, bool]]:
    """(ord, href, text, in_sidebar) of the side bar's links, then of the content's; the first of equal addresses."""
    raw = parse(html)
    side = first(raw, SIDEBAR)
    main = first(raw, MAIN) or first(raw, ["body"]) or raw
    out, seen = [], set()
    for part, where in ((side, True), (main, False)):
        for a in select(part, "a[href]") if part is not None else []:
            href, text = a.attrs["href"].strip(), re.sub(r"\s+", " ", a.content()).strip()
            if href and (text or not where) and href not in seen:
                seen.add(href)
                out.append((len(out), href, text, where))
    return out


def _explode(df: DataFrame, f, schema: str, key: str = "url") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r",(?![^<]*>)", schema)]
        for b in batches:
            rows = [(k, *r) for k, h in b.itertuples(index=False) if h is not None for r in f(h)]
            yield pd.DataFrame(rows, columns=names)

    return df.select(key, "html").mapInPandas(run, schema)


def page_titles(pages: DataFrame) -> DataFrame:
    """(url, title): Open Graph title, else the first title element, else the last segment of the address; ASCII only."""

    @F.pandas_udf("string")
    def title(url: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else title_of(parse(h), u) for u, h in zip(url, html)])

    return pages.select("url", sanitize_title(title("url", "html")).alias("title"))


def page_markdowns(pages: DataFrame) -> DataFrame:
    """(url, markdown) of each page; null for a null page."""

    @F.pandas_udf("string")
    def convert(html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else page_markdown(h) for h in html])

    return pages.select("url", convert("html").alias("markdown"))


def page_sections(pages: DataFrame) -> DataFrame:
    return _explode(pages, sections_of, "url string, ord int, parent_ord int, level int, section_id string, title string, markdown string")


def page_code(pages: DataFrame) -> DataFrame:
    return _explode(pages, code_of, "url string, ord int, language string, code string, title string, annotations array<string>")


def page_links(pages: DataFrame, base: str | None = None, content_type: str = "reference") -> DataFrame:
    """(source, target, text, ord): links of each page, resolved and normalised, inside `base`, to pages only."""
    raw = _explode(pages, links_of, "url string, ord int, href string, text string, sidebar boolean")
    target = normalize_url(resolve_url(F.col("href"), F.col("url")))
    links = raw.select(F.col("url").alias("source"), target.alias("target"), "text", "ord").where("target <> ''")
    if base is not None:
        links = links.where(is_internal(F.col("target"), F.lit(base)))
    return links.where(~skip_url(F.col("target"), F.lit(content_type))).groupBy("source", "target").agg(F.min(F.struct("ord", "text")).alias("l")).select("source", "target", "l.text", "l.ord")


# Where a page's core stands when neither pattern fits.
CORE = "main, div.doc, article.doc, main.content, #content"


@F.pandas_udf(StringType())
def _core_by_selector(html: pd.Series) -> pd.Series:
    """Text of the first core element, else of the body; null for a page that either pattern has settled (given as null)."""
    out = []
    for h in html:
        root = parse(h) if h is not None else None
        nodes = [*select(root, CORE)[:1], first(root, ["body"]) or root] if root is not None else []
        out.append(next((t for n in nodes if (t := re.sub(r"\s+", " ", n.content()).strip())), None))
    return pd.Series(out, dtype="object")


def core_content(html: Column) -> Column:
    """The page's main part, white space collapsed: a main element or a doc division by pattern alone, else by selectors, else
    the text of the body or, without one, of all; null where there is none. Only pages that no pattern fits are parsed."""
    main = F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*?)</main>", 1)
    doc = F.regexp_extract(html, r"""(?is)<div\b[^>]*class=(['"])[^'"]*\bdoc\b[^'"]*\1[^>]*>(.*?)</div>""", 2)
    quick = F.coalesce(F.nullif(collapse_space(main), F.lit("")), F.nullif(collapse_space(doc), F.lit("")))
    return F.coalesce(quick, _core_by_selector(F.when(quick.isNull(), html)))


def unchanged(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, hash, unchanged): whether a page's core has the hash stored for its url; false where none is stored or it has no core."""
    now = pages.select("url", F.sha2(F.encode(core_content(F.col("html")), "UTF-8"), 256).alias("hash"))
    joined = now.join(stored.select(F.col("url").alias("__url"), F.col("hash").alias("__hash")), F.col("url") == F.col("__url"), "left")
    return joined.select("url", "hash", F.coalesce(F.col("hash") == F.col("__hash"), F.lit(False)).alias("unchanged"))


def reconciled_version(label: Column, target: Column, content_type: Column) -> Column:
    """struct(version, error) of a page by its version label and the version it was fetched for.

    A label has to parse and to equal the target's numbers; without a label API and reference pages take the target, other
    pages are in error, as are API pages without a target.
    """
    found, wanted = parse_version(label), parse_version(target)
    takes = content_type.isin("api-doc", "reference") & target.isNotNull()
    error = (
        F.when((content_type == "api-doc") & target.isNull(), "no target version")
        .when(label.isNull() & ~F.coalesce(takes, F.lit(False)), "no version")
        .when(label.isNotNull() & found.isNull(), "unreadable version")
        .when(label.isNotNull() & target.isNotNull() & (version_key(found) != version_key(wanted)), "version mismatch")
    )
    return F.struct(F.when(error.isNull(), F.coalesce(label, target)).alias("version"), error.alias("error"))


def sufficient(html: Column) -> Column:
    """Whether a static page has text in one of the places where contents stand."""

    @F.pandas_udf("boolean")
    def check(pages: pd.Series) -> pd.Series:
        return pd.Series([h is not None and any(n.content().strip() for n in select(parse(h), ", ".join(MAIN))) for h in pages])

    return check(html)


_PARSED = "url string, title string, version string, markdown string, error string"


def parse_pages(pages: DataFrame) -> DataFrame:
    """(url, title, version, markdown, content_hash, error) of each page; what is missing is named in `error`, never raised.

    The version is that of a version label, else of a `/x.y.z/` segment of the address. A page without content has an error
    and a null markdown; a null page likewise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, html in b.itertuples(index=False):
                if html is None or not html.strip():
                    rows.append((url, None, None, None, "empty page"))
                    continue
                root = parse(html)
                label = next((n.content().strip() for s in VERSION for n in select(root, s) if n.content().strip()), None)
                found = re.search(r"/(\d+\.\d+(?:\.\d+)?[^/]*)/", url or "")
                version = label or (found.group(1) if found else None)
                markdown = page_markdown(html) or None
                error = "no content" if markdown is None else "no version" if version is None else None
                rows.append((url, title_of(root, url), version, markdown, error))
            yield pd.DataFrame(rows, columns=["url", "title", "version", "markdown", "error"])

    parsed = pages.select("url", "html").mapInPandas(run, _PARSED)
    return parsed.withColumn("title", sanitize_title(F.col("title"))).withColumn("content_hash", F.sha2(F.encode("markdown", "UTF-8"), 256))
