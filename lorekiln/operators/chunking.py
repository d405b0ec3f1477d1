"""Markdown to chunks: cleaning, heading sections, token windows with natural breaks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import clean_content, sha256_hex

# Window and overlap in tokens by tier.
TIERS = {"main": (2048, 200), "slim": (512, 50), "xslim": (384, 40)}
# Where a window is cut by preference, each looked for from the half of the window on.
BREAKS = ("\n\n", "\n- ", "\n* ", ". ", "! ", "? ", "; ")
_FENCE = re.compile("```")
_HEADING = re.compile(r"(#{1,6})\s+(.+)$")
_WORD = re.compile(r"\w+|[^\w\s]")


def text_sections(markdown: str) -> list[tuple[str, str]]:
    """(path, content) of the sections of a markdown text, split at ATX headings (also inside code fences), in one pass.

    A heading opens a section and stays in it; its path is the titles above it joined by ` > `. Text before the first
    heading has path ''. Sections without lines do not occur; blank ones stay.
    """
    out: list[tuple[str, list[str]]] = []
    titles: list[str] = []
    for line in markdown.splitlines():
        head = _HEADING.match(line.strip())
        if head:
            titles = [*titles[: len(head[1]) - 1], head[2].strip()]
        if head or not out:
            out.append((" > ".join(titles), []))
        out[-1][1].append(line)
    return [(path, "\n".join(lines)) for path, lines in out]


def _each_row(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Run a generator over each row in Arrow batches; its tuples become rows of `schema`."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for r in b.itertuples(index=False) for x in rows(*r)], columns=names)

    return df.mapInPandas(run, schema)


def heading_sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, path, content): the non-blank sections of each text in order; a null text has none. A narrow pass."""

    def rows(k, t):
        for i, (path, content) in enumerate(text_sections(t) if t is not None else []):
            if content.strip():
                yield k, i, path, content

    return _each_row(documents.select(key, text), rows, f"{key} {dict(documents.dtypes)[key]}, section int, path string, content string")


def word_spans(text: str) -> list[tuple[int, int]]:
    """The default tokenizer: spans of words and of single other characters."""
    return [m.span() for m in _WORD.finditer(text)]


def natural_end(text: str) -> str:
    """A window without its last, incomplete part: cut before an open fence late in it, else after the preferred break."""
    fences = [m.start() for m in _FENCE.finditer(text)]
    if len(fences) % 2 and fences[-1] > len(text) * 0.4 and (before := text[: fences[-1]].strip()):
        return before
    for mark in BREAKS:
        at = text.rfind(mark, len(text) // 2)
        if at >= 0:
            return text[: at + len(mark)].strip()
    return text.strip()


def token_windows(text: str, limit: int, overlap: int, spans: Callable[[str], list[tuple[int, int]]] = word_spans) -> Iterator[str]:
    """Windows of at most `limit` tokens; each but the last ends at a natural break, the next begins `overlap` tokens before it.

    A window that a break would leave empty is taken whole.
    """
    found = spans(text)
    if len(found) <= limit:
        yield text
        return
    first = 0
    while first < len(found):
        last = min(first + limit, len(found))
        whole = text[found[first][0] : found[last - 1][1]].strip()
        window = whole if last == len(found) else natural_end(whole) or whole
        yield window
        if last == len(found):
            return
        first += max(1, len(spans(window)) - overlap)


def chunk_markdown(documents: DataFrame, tier: str = "main", spans: Callable[[str], list[tuple[int, int]]] = word_spans) -> DataFrame:
    """chunk_id, document_id, chunk_index, section_path, content, content_hash, has_code of documents (document_id, markdown).

    Cleaning and hashing stay in the JVM; sections and windows, whose step depends on where they were cut, are one linear
    pass in Arrow batches. A document's chunks leave numbered, so nothing is shuffled. Contents have no white space at
    their ends and blank chunks are left out; a null or empty text has none.
    """
    limit, overlap = TIERS[tier]

    def rows(d, text):
        pieces = (
            (path, content)
            for path, section in (text_sections(text) if text is not None else [])
            for w in token_windows(section, limit, overlap, spans)
            if (content := w.strip())
        )
        for i, (path, content) in enumerate(pieces):
            yield d, i, path, content

    kind = dict(documents.dtypes)["document_id"]
    out = _each_row(documents.select("document_id", clean_content(F.col("markdown")).alias("markdown")), rows, f"document_id {kind}, chunk_index int, section_path string, content string")
    return out.select(
        F.concat_ws("-", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "chunk_index",
        "section_path", "content", sha256_hex(F.col("content")).alias("content_hash"), F.col("content").contains("`").alias("has_code"),
    )


def fixed_windows(documents: DataFrame, limit: int, overlap: int) -> DataFrame:
    """document_id, window, tokens: windows of a fixed step over the words of a text, all in the JVM."""
    words = documents.select("document_id", F.filter(F.split("markdown", r"\s+"), lambda w: w != "").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(limit - overlap))
    cut = words.where("size(w) > 0").select("document_id", F.posexplode(starts).alias("window", "at"), "w")
    return cut.select("document_id", "window", F.array_join(F.slice("w", F.col("at") + 1, F.lit(limit)), " ").alias("tokens"))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Metadata in primitives only: a null submodule becomes '', tags a comma-joined text."""
    tags = F.array_join(F.array_sort(F.array_distinct(F.array("module", "content_type"))), ",")
    return chunks.select(
        "document_id", "chunk_index", "module", F.coalesce("submodule", F.lit("")).alias("submodule"), "version_major", "version_minor", "content_type",
        "section_path", "has_code", F.lit(False).alias("has_deprecation"), tags.alias("tags"),
    )


def code_places(chunks: DataFrame) -> DataFrame:
    """document_id, code, chunk_index, uses: each fenced block of a document, trimmed, at the first chunk that holds it."""
    blocks = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)```[a-z]*\n(.*?)```"), F.lit(1)))
    rows = chunks.select("document_id", "chunk_index", blocks.alias("b")).select("document_id", "chunk_index", F.regexp_replace("b", r"^[ \n\t]+|[ \n\t]+$", "").alias("code"))
    return rows.where("code <> ''").groupBy("document_id", "code").agg(F.min("chunk_index").alias("chunk_index"), F.count(F.lit(1)).alias("uses"))
