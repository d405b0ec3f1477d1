"""Wiki pages: semantic tags around sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_sections(markdown: Column, content_type: Column, version: Column) -> Column:
    """The text in an element named by its type, each `##` section in a section element; nothing is escaped."""
    tag = F.replace(content_type, F.lit("-"), F.lit("_"))
    opened = F.concat(F.lit("<"), tag, F.lit(' version="'), version, F.lit('">'))
    closed = F.concat(F.lit("</"), tag, F.lit(">"))
    parts = F.split(markdown, r"(?m)(?=^##\s+.*$)")
    is_head = lambda p: p.rlike(r"\A##\s+.*")

    def section(p: Column) -> Column:
        head = F.regexp_extract(p, r"\A(##\s+[^\n]*)", 1)
        body = F.trim(F.regexp_replace(F.regexp_replace(p, r"\A##\s+[^\n]*", ""), r"^\s+|\s+$", ""))
        title = F.trim(F.replace(head, F.lit("##"), F.lit("")))
        slug = F.regexp_replace(F.replace(F.lower(title), F.lit(" "), F.lit("_")), "[()]", "")
        return F.concat(F.lit('  <section name="'), slug, F.lit('" title="'), title, F.lit('">\n    '), head, F.lit("\n    "), body, F.lit("\n  </section>"))

    pieces = F.transform(parts, lambda p: F.when(is_head(p), section(p)).otherwise(F.regexp_replace(p, r"^\s+|\s+$", "")))
    tagged = F.concat_ws("\n", opened, F.array_join(F.filter(pieces, lambda p: p != ""), "\n"), closed)
    return F.when(F.exists(parts, is_head), tagged).otherwise(F.concat(opened, F.lit("\n"), markdown, F.lit("\n"), closed))
