"""Markup, splitting, boilerplate: by hand, by properties and on awkward input."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekiln.llm.boilerplate import boilerplate_lines, line_form, page_bodies
from lorekiln.llm.differencing import shared_lines
from lorekiln.llm.markup import clean_chunks, clean_markup, marked_chunks
from lorekiln.llm.splitting import TOKEN, count_tokens, split_oversized, split_text

CASES = [
    ("# Title\n\nText", ["markdown"]), ("Title\n=====\ntext", ["markdown"]), ("a **b** c", ["markdown"]), ("- one\n- two", ["markdown"]), ("see [a](http://x.y/z)", ["markdown"]),
    ("| a | b |\n|---|:-:|\n| 1 | 2 |", ["markdown"]), ("use `code` here", ["markdown"]), ("```java\nList<b> x = **y**;\n```", ["markdown"]), ("note[^1]\n\n[^1]: text", ["markdown"]), ("> quoted", ["markdown"]),
    ("<p>text</p>", ["html"]), ("it&#8217;s", ["html"]), ("a<!-- note -->b", ["html"]), ("<PRE>if (a &lt; 3)</PRE>", ["html"]), ("x &amp; y", ["html"]), ('see <a\n  href="x"\n class=y>z</a>', ["html"]),
    ("== Head ==\ntext", ["wiki"]), ("'''bold''' text", ["wiki"]), ("see [[Page|label]]", ["wiki"]), ("{| class=grid\n|-\n| a || b\n|}", ["wiki"]), ("{{Notice|level=2}} x", ["wiki"]), ("[https://x.y label]", ["wiki"]), ("__TOC__", ["wiki"]),
    ("\\section{One}", ["latex"]), ("cost $n^2$ grows", ["latex"]), ("\\(n \\le 3\\)", ["latex"]), ("as in~\\cite{x}", ["latex"]), ("\\begin{verbatim}\n**x** <b>\n\\end{verbatim}", ["latex"]), ("$$ a = b $$", ["latex"]),
    ("Map<String, List<Foo>> and never null", []), ("between $29 and $168 per month", []), ("Only *.yml and *.properties files", []), ("Copy to C:\\lumen\\bin\\tools first", []), ("a < 70 and b > 3", []),
    ("The window is 4 * 29 * 60 seconds", []), ("max_pool_size and min_pool_size", []), ("#6402 is fixed", []), ("Replace <your-host> now", []), ("${a.b.c} is resolved", []), ("mode == strict and depth == 2.", []),
    ("the order [first, last] matters", []), ("read & write", []), ("", []), ("{{ name }} is replaced", []), ("a[i][j] = 3", []), ("x && y || z", []),
]


@pytest.mark.parametrize("text,families", CASES)
def test_families(text, families):
    assert clean_markup(text)[2] == families


def test_structure_is_kept():
    clean, code, _ = clean_markup("Title\r\n=====\r\n\r\n* **a** [x](http://y)\r\n1. b\r\n\r\n```sql\r\nselect *\r\n```\r\nCopied!\r\n")
    assert clean == "# Title\n\n- a x\n1. b\n\n```\nselect *\n```" and code
    clean, code, _ = clean_markup("\\subsection*{H}\n\\begin{itemize}\n\\item \\textbf{A}\n\\end{itemize}\nCost \\(n^2\\).\n\\begin{equation}\nr = x\n\\end{equation}")
    assert clean == "## H\n\n- A\n\nCost $n^2$.\n\n$$ r = x $$" and not code
    clean, code, _ = clean_markup("<h2>H</h2><ul><li>a<li>b</ul><pre>x &lt; y</pre>t&nbsp;u<br/>v")
    assert re.sub(r"\s+", " ", clean) == "## H - a - b ``` x < y ``` t u v" and code
    assert clean_markup("= A =\n[[Category:X]]''i'' [[File:a.png|thumb|cap]]")[0] == "# A\ni cap"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n<>/&;#*_`~[](){}|=-+'$\\:.!^0x\t\"")), max_size=80))
def test_markup_never_fails(text):
    clean, _, families = clean_markup(text)
    assert isinstance(clean, str) and set(families) <= {"html", "markdown", "wiki", "latex"}


def test_markup_is_fast_on_long_lines():
    for piece in ("word ", "*", "[", "<a '", "`", "$x", "_a", "{{", "|", "''", "=", "- a\n", "\\("):
        clean_markup(piece * (200_000 // len(piece)))


def test_markup_tables(spark):
    rows = [("a", "**x**", True, 1), ("a", "**x**", False, 1), ("b", None, None, 1), ("c", "", None, 1), (None, "<b>y</b>", None, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, has_code boolean, markup int")
    assert {tuple(r) for r in marked_chunks(df).collect()} == {("a", "markdown"), (None, "html")}
    assert {(r.chunk_id, r.clean, r.has_code) for r in clean_chunks(df).collect()} == {("a", "x", False), ("b", None, False), ("c", "", False), (None, "y", False)}
    assert marked_chunks(df.limit(0)).count() == 0


# splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abc é漢.!?,\n\r\t `#-_~\x1c")), max_size=400), st.integers(1, 20), st.integers(0, 25))
def test_pieces(text, limit, overlap):
    tokens = TOKEN.findall(text)
    pieces = split_text(text, limit, overlap)
    got = [TOKEN.findall(text[a:b]) for a, b, _ in pieces]
    if len(tokens) <= limit:
        assert pieces == [(0, len(text), len(tokens))]
        return
    shared = min(overlap, limit - 1)
    joined = list(got[0])
    for left, right in zip(got, got[1:]):
        assert left[len(left) - shared :] == right[:shared]
        joined += right[shared:]
    assert joined == tokens and all(0 < len(g) <= limit for g in got) and [len(g) for g in got] == [n for *_, n in pieces]


def test_cut_at_change_of_topic():
    a = " ".join(f"The pool keeps the connection number {i} of the pool open." for i in range(6))
    b = " ".join(f"Every parser reads the syntax tree node {i} of the parser." for i in range(6))
    text = a + " " + b
    pieces = split_text(text, count_tokens(a) + 20, 0)
    assert text[pieces[0][0] : pieces[0][1]] == a


def test_natural_ends_are_preferred():
    text = "\n\n".join(" ".join(["word"] * 30) + "." for _ in range(20))
    for a, b, _ in split_text(text, 100, 10)[:-1]:
        assert text[b - 1] == "."
    assert split_text("x" * 5 + " y" * 50, 10, 3)[0][2] == 10  # no boundary at all: the full limit


def test_split_tables(spark):
    rows = [("a", "d", "S", "t", " ".join(["w."] * 50), 9), ("a", "d", "S", "t", " ".join(["w."] * 50), 9), ("b", "d", "S", "t", "short", 9), ("n", "d", "S", "t", None, 9), ("u", "d", "S", "other", "w " * 500, 9), ("z", None, None, None, "", 9)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, section_path string, tier string, content string, piece int")
    config = spark.createDataFrame([("t", 30, 5), ("t", 30, 5)], "tier string, max_tokens int, overlap_tokens int")
    got = split_oversized(df, config).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append(r)
    assert len(by["a"]) == by["a"][0].pieces > 1 and all(r.tokens <= 30 and r.section_path == "S" for r in by["a"])
    assert all(len(by[k]) == 1 and by[k][0].pieces == 1 for k in "bnuz") and by["n"][0].tokens == 0
    only = split_oversized(df, config, only_oversized=True).collect()
    assert {r.chunk_id for r in only} == {"a"} and len(only) == len(by["a"])
    assert split_oversized(df.limit(0), config).count() == 0 and split_oversized(df, config.limit(0)).count() == 5


# boilerplate


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=10), st.lists(st.sampled_from("abcd"), max_size=10))
def test_shared_lines_are_a_common_subsequence(a, b):
    left, right = shared_lines(a, b)
    one, two = [a[i] for i in sorted(left)], [b[i] for i in sorted(right)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert one == two and len(one) == best[-1][-1]


def test_forms():
    assert line_form("© 2009–2025 Acme Works", "acme") == "© #–# * works"
    assert line_form("Previous: How uploads work", "acme") == "previous:"
    assert line_form("Home › FooBar › Uploads", "acme") == "home ›"
    assert line_form("We use cookies to measure visits. Accept all | Reject all", "acme") == "we use cookies to measure visits."
    assert line_form("", "") == ""


def site(n, host="docs.acme.example", start=0):
    rows = []
    for i in range(start, start + n):
        url = f"https://{host}/guide/page-{i:03d}.html?x=1"
        body = f"The unique sentence number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} tells something about this page alone.\nUse the following form:\nAnother sentence {'uvwxyzabcd'[i % 10]} with words {'efghijklmn'[i // 10]} that nobody else has."
        rows.append((i, url, 1, f"How part {i} works", f"Skip to main content\n\nHome / Docs / How part {i} works\n{body}"))
        rows.append((i, url, 2, None, f"On this page\nHow part {i} works\nHow part {i} works\nThe closing words {'opqrstuvwx'[i % 10]} of page {'yzabcdefgh'[i // 10]} are its own too.\nPrevious: x{i}\nAll rights reserved.\r"))
    return rows


SECTIONS = "page_id bigint, url string, section_ord int, title string, content string, scraped_at int, form string"


def test_boilerplate(spark):
    rows = [(*r, 1, None) for r in site(30)]
    rows += rows[:4]  # delivered twice
    rows += [(900, "https://lone.example/x", 1, "T", "Skip to main content\nA body that stands on its own and is long.\nAll rights reserved.", 1, None)]
    rows += [(901, None, 1, None, None, None, None), (902, "https://empty.example/", 1, "", "", 1, None)]
    df = spark.createDataFrame(rows, SECTIONS)
    got = {tuple(r) for r in boilerplate_lines(df).collect()}
    for i in range(30):
        assert {(i, 1, 1), (i, 1, 3), (i, 2, 1), (i, 2, 2), (i, 2, 3), (i, 2, 5), (i, 2, 6)} == {g for g in got if g[0] == i}
    assert {g for g in got if g[0] == 900} == {(900, 1, 1), (900, 1, 3)}
    bodies = {(r.page_id, r.section_ord): r.body for r in page_bodies(df).collect()}
    assert bodies[900, 1] == "A body that stands on its own and is long." and bodies[901, 1] is None and bodies[0, 1].startswith("\nThe unique")


def test_boilerplate_large_host_and_empty(spark):
    df = spark.createDataFrame([(*r, 1, None) for r in site(60)], SECTIONS)
    assert {(i, 1, 1) for i in range(60)} <= {tuple(r) for r in boilerplate_lines(df).collect()}
    assert boilerplate_lines(df.limit(0)).count() == 0
