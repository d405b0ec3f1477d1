"""Text expressions: hashes, titles, slugs, escapes, patterns of code and residue. A null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the keyword index: runs of letters, digits and underscores, whatever the script.
WORD = r"[\p{L}\p{N}_]+"

# Language names by pattern, tried in this order as substrings without regard to case.
LANGUAGES = (
    ("java", "java"), ("kotlin|kt", "kotlin"), ("groovy", "groovy"), ("xml", "xml"), ("ya?ml", "yaml"),
    ("properties|props", "properties"), ("json", "json"), ("sh|bash|shell|zsh", "shell"), ("sql", "sql"),
)

# What is left of a copy button, in the order in which it is removed.
COPY_RESIDUE = (r"(?m)Copied!$", r"Copied!\s*```", r"```\s*Copied!", r"Copied!(?=\s|$)")


# An annotation in code, its name captured.
ANNOTATION = r"@(\w+)(?:\([^)]*\))?"

# Noise of wiki pages, in the order in which it is removed.
WIKI_NOISE = (
    (r"(?is)<!--\s*nav\s*-->.*?<!--\s*/nav\s*-->", ""),
    (r"(?is)##?\s+See\s+also.*?(?=\n##?|\z)", ""),
    (r"(?i)---\s*\n.*?Back\s+to\s+top.*?\n", ""),
    (r"(?m)^\[\[.*?\]\]\s*$", ""),
    (r"(?i)\[Edit this page\].*?\n", ""),
    (r"\n{3,}", "\n\n"),
)


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def short_id(url: Column) -> Column:
    """The catalog id of a page: the first 16 digits of the hash of its url."""
    return F.substring(sha256_hex(url), 1, 16)


def is_sha256(value: Column) -> Column:
    return value.rlike(r"^[a-f0-9]{64}$")


def content_matches(content: Column, stored: Column) -> Column:
    """Whether a content has its stored hash; true where none is stored."""
    return stored.isNull() | (sha256_hex(content) == stored)


def sanitize_title(title: Column) -> Column:
    """Characters beyond ASCII become dashes, runs of dashes one."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"[^\x00-\x7F]", "-"), "-{2,}", "-"))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(text: Column, length: int = 50) -> Column:
    """Lower case, anything but ASCII letters and digits as one dash, none at either end, at most `length` characters."""
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, length)


def display_name(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("-"), F.lit(" ")))


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def xml_attribute(text: Column) -> Column:
    """The text as a quoted attribute value; double quotes unless only they occur in it."""
    safe = xml_escape(text)
    for raw, ref in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        safe = F.replace(safe, F.lit(raw), F.lit(ref))
    single = F.concat(F.lit("'"), safe, F.lit("'"))
    double = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.when(safe.contains('"') & ~safe.contains("'"), single).otherwise(double)


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression for the whole string; `*` also crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inside = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]")
            i = close
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]/" else c)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def matches_any_glob(value: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | value.rlike(glob_regex(g))
    return hit


def code_language(css_class: Column, default: str = "java") -> Column:
    """Language of a code block by its class: the first pattern found in it without its language- or lang- prefix."""
    name = F.regexp_replace(F.coalesce(css_class, F.lit("")), r"^(?:language-|lang-|highlight-source-)", "")
    found = None
    for pattern, language in LANGUAGES:
        hit = name.rlike(f"(?i){pattern}")
        found = F.when(hit, language) if found is None else found.when(hit, language)
    return found.otherwise(default)


def annotations(code: Column) -> Column:
    """Distinct names after an at sign, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(ANNOTATION), F.lit(1))))


def clean_content(markdown: Column) -> Column:
    """Markdown without the residue of copy buttons, at most one blank line in a row, no white space at the ends."""
    for pattern in COPY_RESIDUE:
        keep = "```" if "```" in pattern else ""
        markdown = F.regexp_replace(markdown, pattern, keep)
    return strip(F.regexp_replace(markdown, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")


def clean_wiki_noise(markdown: Column) -> Column:
    """Wiki pages without navigation comments, see-also sections, back-to-top rules, lone link lines and edit links."""
    for pattern, keep in WIKI_NOISE:
        markdown = F.regexp_replace(markdown, pattern, keep)
    return strip(markdown)


def wiki_content_type(name: Column) -> Column:
    return F.when(name.contains("Release-Notes"), "release-notes").when(name.contains("Migration-Guide"), "migration-guide").otherwise("reference")


def first_heading(markdown: Column, file_name: Column) -> Column:
    """The first `# ` heading of a page, else its file name in title case."""
    found = F.nullif(F.trim(F.regexp_extract(markdown, r"(?m)^\s*# (.*)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(found, F.initcap(F.regexp_replace(stem, "[-_]", " ")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def document_stats(text: Column) -> Column:
    """struct(words, sections, code_examples): words between white space, ATX headings and fenced blocks of a text."""
    count = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    fences = count(r"(?m)^[ \t]*```")
    return F.struct(word_count(text).alias("words"), count(r"(?m)^#{1,6}[ \t]+\S").alias("sections"), F.floor(fences / 2).cast("int").alias("code_examples"))


def has_deprecations(marks: Column) -> Column:
    """Whether annotations or notes (an array) name a deprecation; null and empty arrays do not."""
    return F.coalesce(F.exists(marks, lambda m: F.lower(m).contains("deprecated")), F.lit(False))


def matched_name(value: Column, names: list[str]) -> Column:
    """The name a value means, letter case, blanks, dashes and underscores aside; null for none of them."""
    form = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "-")
    found = F.lit(None).cast("string")
    for n in reversed(names):
        found = F.when(form(value) == form(F.lit(n)), n).otherwise(found)
    return found


def query_parts(line: Column) -> Column:
    """struct(query, module, version, submodule): a search line without its `key=value` words, and the last value of each.

    A version that is no number is dropped.
    """
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    is_filter = lambda w: w.rlike("^(module|version|submodule)=")
    value = lambda k: F.try_element_at(F.transform(F.filter(words, lambda w: w.startswith(f"{k}=")), lambda w: F.substr(w, F.lit(len(k) + 2))), F.lit(-1))
    number = F.try_element_at(F.filter(F.transform(F.filter(words, lambda w: w.startswith("version=")), lambda w: F.substr(w, F.lit(9))), lambda v: v.rlike(r"^\d+$")), F.lit(-1))
    return F.struct(F.array_join(F.filter(words, lambda w: ~is_filter(w)), " ").alias("query"), value("module").alias("module"), number.alias("version"), value("submodule").alias("submodule"))


def wiki_version(name: Column) -> Column:
    """The version in a wiki file's name; null without one."""
    return F.nullif(F.regexp_extract(name, r"(\d+\.\d+(?:\.\d+)?)", 1), F.lit(""))
