"""Pages, API pages, wiki pages, chunking, search, catalog rules and sources on small fixtures."""

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekiln.functions import text as T
from lorekiln.functions import url as U
from lorekiln.functions import version as V
from lorekiln.operators import activation, apidoc, catalog, chunking, dense, fusion, lexical, manifests, pages, search, wiki
from lorekiln.operators.discovery import discover
from lorekiln.operators.embedding import delete_vectors, embed, hashing_strategy, upsert_vectors
from lorekiln.operators.dom import parse, select
from lorekiln.sources import registry
from lorekiln.streaming.indexing import latest_chunks, stream_chunks

PAGE = """<html><head><meta property="og:title" content="Exämple Guide"><title>x</title><script>var a = "<p>";</script></head><body>
<nav class="toc"><ul><li><a href="one.html#a">One</a></li><li><a href="/two">Two</a></li><li><a href="">none</a></li></ul></nav>
<article class="doc"><h1>Guide</h1><p>Intro <b>bold</b> and <a href="three" title="t">link</a>.<aside>side</aside>
<h2 id="config.main">Configure</h2><p>Add a bean:</p><pre><code class="language-java">@Bean
Foo foo() { return <span>new</span> Foo(); }</code></pre>Copied!
<h3>Deep</h3><ul><li>a<li>b</ul><h2>Table</h2><table><tr><th>K<th>V</tr><tr><td>a|b<td>1</tr></table>
<pre class="code">kotlin stuff</pre><div class="pagination">Next page</div><a rel="next" href="n">next</a></article><footer>foot</footer></body></html>"""

API = """<div class="header"><div class="sub-title">Package <a>org.sample.client</a></div></div><section class="class-description"><div class="type-signature">public class <b>RestThing</b> extends <a>Accessor</a> implements <a>Ops</a>, Map&lt;K, V&gt;</div></section>
<section class="method-details"><ul><li><section class="detail"><h3>exchange</h3><div class="member-signature">@Nullable public &lt;T&gt; Entity&lt;T&gt; exchange(String url, Map&lt;String, ?&gt; args) throws Bad, Worse</div>
<dl class="notes"><dt>Parameters:</dt><dd>url - the address</dd><dd>args - values</dd><dt>Returns:</dt><dd>the entity</dd></dl></section></li>
<li><section class="detail"><div class="member-signature">public &lt;T&gt; Entity&lt;T&gt; exchange(String url, Map&lt;String, ?&gt; args)</div></section></li></ul></section>"""


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr).first()[0]


def test_selectors():
    root = parse('<div id="a" class="x y"><p>t<p>u<ul><li rel="next">1<li>2</ul></div><img src=q>')
    assert len(select(root, "p")) == 2 and len(select(root, "div.x.y > p")) == 2 and len(select(root, "#a li[rel='next'], img")) == 2
    assert len(select(root, "ul li")) == 2 and not select(root, "div > li") and len(select(root, "[src$='q']")) == 1


def test_page(spark):
    df = spark.createDataFrame([("https://d.x/ref/guide", PAGE), ("https://d.x/ref/my-page.html", "<p>no title"), ("https://d.x/null", None)], "url string, html string")
    titles = {r.url: r.title for r in pages.page_titles(df).collect()}
    assert titles == {"https://d.x/ref/guide": "Ex-mple Guide", "https://d.x/ref/my-page.html": "My Page", "https://d.x/null": None}
    md = {r.url: r.markdown for r in pages.page_markdowns(df).collect()}["https://d.x/ref/guide"]
    for part in ("# Guide", "Intro **bold** and [link](three \"t\").", "```java\n@Bean\nFoo foo() { return new Foo(); }\n```", "- a\n- b", "| K | V |\n| --- | --- |\n| a\\|b | 1 |"):
        assert part in md
    for gone in ("foot", "side", "Next page", "Copied", "One", "var a"):
        assert gone not in md
    sections = {r.title: r for r in pages.page_sections(df).collect()}
    assert list(sections) == ["Guide", "Configure", "Deep", "Table"] and sections["Deep"].parent_ord == 1 and sections["Table"].parent_ord == 0
    assert sections["Configure"].section_id == "config-main"
    code = pages.page_code(df).collect()
    assert [(c.language, c.title, c.annotations) for c in code] == [("java", "Add a bean:", ["Bean"]), ("java", None, [])]
    links = {r.target for r in pages.page_links(df, "https://d.x/").collect()}
    assert links == {"https://d.x/ref/one.html", "https://d.x/two/", "https://d.x/ref/three/", "https://d.x/ref/n/"}
    assert [r.s for r in df.select(pages.sufficient(F.col("html")).alias("s")).collect()] == [True, False, False]


def test_core_content(spark):
    assert one(spark, pages.core_content(F.col("h")), h="<main id=a> x\n <b>y</b></main>") == "x <b>y</b>"
    assert one(spark, pages.core_content(F.col("h")), h="<div class='a doc b'>z </div>") == "z"
    assert one(spark, pages.core_content(F.col("h")), h="<p>q") == "q"


def test_signature(spark):
    s = apidoc.class_signature(API)
    assert (s["package"], s["name"], s["kind"], s["extends"], s["implements"]) == ("org.sample.client", "RestThing", "class", "Accessor", ["Ops", "Map<K, V>"])
    (m,) = s["methods"]
    assert m["name"] == "exchange" and m["return_type"] == "Entity<T>" and [(p["name"], p["type"], p["description"]) for p in m["parameters"]] == [("url", "String", "the address"), ("args", "Map<String, ?>", "values")]
    assert m["annotations"] == ["@Nullable"] and m["throws"] == ["Bad", "Worse"] and m["return_description"] == "the entity"
    assert "Entity<T> exchange(String url, Map<String, ?> args)" in apidoc.signature_markdown(s)
    got = apidoc.page_signatures(spark.createDataFrame([("u", API), ("v", "<p>"), ("w", None)], "url string, html string")).collect()
    assert len(got) == 1 and got[0].signature.methods[0].parameters[1].type == "Map<String, ?>"
    assert apidoc.split_top_level("a, Map<b, c>, d(e, f),,") == ["a", "Map<b, c>", "d(e, f)"]


@pytest.mark.parametrize("css,language", [("language-java", "java"), ("lang-kt", "kotlin"), ("highlight-source-yaml", "yaml"), ("yml", "yaml"), ("bash", "shell"), ("zsh", "shell"), ("json", "json"), ("sql", "sql"), ("props", "properties"), ("xml", "xml"), ("groovy", "groovy"), ("", "java"), ("javascript", "java")])
def test_code_language(spark, css, language):
    assert one(spark, T.code_language(F.col("c")), c=css) == language


def test_text_functions(spark):
    assert one(spark, T.sanitize_title(F.col("t")), t="Größe — 😀 x") == "Gr-e - - x"
    assert one(spark, T.slug(F.col("t")), t="--Hello, World! ä x--") == "hello-world-x"
    assert one(spark, T.xml_attribute(F.col("t")), t='a<b & "c"') == "'a&lt;b &amp; \"c\"'"
    assert one(spark, T.xml_attribute(F.col("t")), t="""it's "x\"""") == '"it\'s &quot;x&quot;"'
    assert one(spark, T.clean_content(F.col("t")), t="a\n```\nx\n```\nCopied!\n\n\n\nb Copied! c\n") == "a\n```\nx\n```\n\nb  c"
    assert one(spark, T.matches_any_glob(F.col("t"), ["*.adoc", "api/[!x]?z"]), t="api/ayz") and not one(spark, T.matches_any_glob(F.col("t"), ["api/[!x]?z"]), t="api/xyz")
    assert one(spark, T.clean_wiki_noise(F.col("t")), t="a\n## See also\nx\n## B\nb [Edit this page](x)\n[[l]]\n") == "a\n\n## B\nb"
    assert one(spark, T.first_heading(F.col("t"), F.lit("d/my-file.md")), t="x\n# Head \ny") == "Head" and one(spark, T.first_heading(F.col("t"), F.lit("d/my-file.md")), t="x") == "My File"
    tagged = one(spark, wiki.tag_sections(F.col("t"), F.lit("release-notes"), F.lit("4.0")), t="pre\n## New (x) Y\nbody\n## Z\n")
    assert tagged.startswith('<release_notes version="4.0">\npre\n  <section name="new_x_y" title="New (x) Y">\n    ## New (x) Y\n    body\n  </section>') and tagged.endswith("</release_notes>")


@pytest.mark.parametrize("url,want", [("https://a.b/c", "https://a.b/c/"), ("https://a.b/c.html?x#y", "https://a.b/c.html"), ("#x", ""), ("", ""), (None, ""), ("mailto:x@y", ""), ("http://a.b", "http://a.b"), ("https://a.b/c/", "https://a.b/c/")])
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.col("u")), u=url) == want
    assert one(spark, U.normalize_url(U.normalize_url(F.col("u"))), u=url) == want


def test_url_rules(spark):
    assert one(spark, U.base_path(F.col("u")), u="https://a.b/r/index.html") == "https://a.b/r/" and one(spark, U.base_path(F.col("u")), u="https://a.b/r") == "https://a.b/r/"
    skip = {"https://a.b/x.PDF": True, "https://github.com/x": True, "https://a.b/api/x": True, "https://a.b/x.html": False, "": True, None: True}
    for u, want in skip.items():
        assert one(spark, U.skip_url(F.col("u")), u=u) is want
    assert one(spark, U.skip_url(F.col("u"), F.lit("api-doc")), u="https://a.b/api/x") is False
    assert [one(spark, U.safe_path(F.col("p")), p=p) for p in ("a/b.md", "/a", "a/../b", "..", None)] == [True, False, False, False, False]


def test_versions(spark):
    rows = [("4.0.5", (4, 0, 5, None)), ("7", (7, 0, 0, None)), ("6.1-RC1", (6, 1, 0, "RC1")), ("4.0.0.M2", (4, 0, 0, "M2")), ("x", None), (None, None)]
    for text, want in rows:
        got = one(spark, V.parse_version(F.col("v")), v=text)
        assert (tuple(got) if got else None) == want
    assert one(spark, V.range_string(F.col("m"), F.col("a"), F.lit(None)), m="boot", a="4.0") == "boot:[4.0, *]"


def test_chunking(spark):
    text = "# Title\nintro\n## Section One\ntext\n```java\n@Bean\n```\nCopied!\n## Section Two\ntext"
    df = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "document_id string, markdown string")
    got = chunking.chunk_markdown(df).orderBy("chunk_index").collect()
    assert [r.section_path for r in got] == ["Title", "Title > Section One", "Title > Section Two"] and [r.has_code for r in got] == [False, True, False]
    assert not any("Copied!" in r.content for r in got) and got[1].chunk_id == "d-1"
    long = "\n".join(f"## Section {i}\n" + "word " * 200 for i in range(5))
    parts = list(chunking.token_windows(long, 100, 10))
    assert len(parts) > 5 and all(len(chunking.word_spans(p)) <= 100 for p in parts)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab. \n`-*;")), max_size=300), st.integers(1, 30), st.integers(0, 40))
def test_windows_end(text, limit, overlap):
    assert all(len(chunking.word_spans(p)) <= limit for p in chunking.token_windows(text, limit, overlap))


def test_fusion_example(spark):
    d = spark.createDataFrame([("doc1-0", 1), ("doc2-0", 2), ("doc3-0", 3)], "id string, rank int")
    s = spark.createDataFrame([("doc2-0", 1), ("doc1-0", 2), ("doc3-0", 3)], "id string, rank int")
    urls = spark.createDataFrame([("doc1-0", "a"), ("doc2-0", "a"), ("doc3-0", "c")], "id string, url string")
    rows = fusion.fuse(d, s).join(urls, "id")
    assert {r.id: r.score for r in rows.collect()} == {"doc1-0": round(1 / 61 + 1 / 62, 9), "doc2-0": round(1 / 61 + 1 / 62, 9), "doc3-0": round(2 / 63, 9)}
    assert [r.id for r in fusion.finish(fusion.one_per_url(rows), 3).orderBy("place").collect()] == ["doc1-0", "doc3-0"]
    assert [r.id for r in fusion.finish(rows, 3).orderBy("place").collect()] == ["doc1-0", "doc2-0", "doc3-0"]
    blank = spark.createDataFrame([("doc1-0", ""), ("doc2-0", " "), ("doc3-0", None)], "id string, url string")
    assert fusion.one_per_url(fusion.fuse(d, s).join(blank, "id")).count() == 3
    assert fusion.response_status(rows, rows.where("score > 9")).first().status == "below_threshold" and fusion.response_status(rows.limit(0), rows.limit(0)).first().status == "no_results"


def test_bm25_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the pool pool"), (2, "The connection"), (3, None), (4, ""), (5, "connection pool")], "doc_id bigint, text string")
    index = lexical.build_index(docs, "doc_id", "text")
    index.write(str(tmp_path / "i"))
    again = lexical.read_index(spark, str(tmp_path / "i"))
    a, b = (sorted(map(tuple, lexical.bm25_scores(i, "pool POOL unknown").collect())) for i in (index, again))
    assert a == b and len(a) == 5 and dict(a)[1] > dict(a)[5] > dict(a)[2] == 0
    assert lexical.bm25_scores(index, "").count() == 5
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.5), (2, "a", 1.0)], "id bigint, term string, weight double")
    assert {tuple(r) for r in dense.prune_weights(w, 2).collect()} == {(1, "b", 0.9), (1, "a", 0.5), (2, "a", 1.0)}
    assert {tuple(r) for r in dense.sparse_scores(w, {"a": 2.0, "c": 1.0}).collect()} == {(1, 1.5), (2, 2.0)}


def test_arguments():
    search.check_arguments("abc")
    for bad in ({"query": "ab"}, {"query": "abc", "top_k": 11}, {"query": "abc", "version": 0}, {"query": "abc", "threshold": 2}):
        with pytest.raises(ValueError):
            search.check_arguments(**bad)
    assert search.parse_interactive("how to module=boot x version=q submodule=r") == ("how to x", {"module": "boot", "submodule": "r"})


def test_snapshots_and_downloads(spark):
    ts = dt.datetime(2026, 4, 8)
    keys = ["chroma_db_2026_04_06.zip", "chroma_db_2026_04_07.zip", "sqlite_metadata_2026_04_06.zip", "x/chroma_db_2026_04_09.zip", "other_2026_04_09.zip"]
    df = spark.createDataFrame([(k, ts) for k in keys], "key string, last_modified timestamp")
    assert {r.token for r in manifests.latest_pair(df, ["x", ""]).collect()} == {"2026_04_06"}
    ns = df.unionByName(spark.createDataFrame([("x/sqlite_metadata_2026_04_09.zip", ts)], df.schema))
    assert {(r.scope, r.token) for r in manifests.latest_pair(ns, ["x", ""]).collect()} == {("x", "2026_04_09")}
    assert manifests.latest_pair(df.limit(0), [""]).count() == 0
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")
    import hashlib

    listing = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest().upper()), ("b", "0"), ("c", "0")], "path string, content_hash string")
    assert {tuple(r) for r in manifests.verify_downloads(files, listing).collect()} == {("a", True, None), ("b", False, "hash mismatch"), ("c", False, "missing")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcde"), st.sampled_from("12")), st.dictionaries(st.sampled_from("abcde"), st.sampled_from("12")))
def test_delta_leads_from_old_to_new(spark, old, new):
    o, n = (spark.createDataFrame([(k, v, 1) for k, v in x.items()], "path string, content_hash string, size_bytes bigint") for x in (old, new))
    delta = manifests.manifest_delta(o, n)
    assert {tuple(r) for r in manifests.apply_delta(o, delta).collect()} == set(new.items())
    assert manifests.manifest_delta(o, o).count() == 0


def test_upsert_rules(spark):
    schema = "id string, url string, title string, module string, submodule string, major_version int, minor_version int, patch_version int, content_hash string, file_path string, s3_key string, size_bytes bigint, scraped_at timestamp, synced_at timestamp, schema_version string, is_indexed boolean"
    row = lambda i, t, h, m=4, ix=True, d=1: (i, "u", t, "boot", None, m, 0, 0, h, "f", "k", 1, dt.datetime(2025, 1, d), None, "1", ix)
    old = spark.createDataFrame([row("a", "A", "1"), row("b", "B", "1"), row("c", "C", "1")], schema)
    new = spark.createDataFrame([row("a", "A2", "2", 9, d=2), row("a", "A1", "3", 9, d=1), row("b", "B2", "1", ix=False), row("d", "D", "1")], schema)
    got = {r.id: (r.title, r.content_hash, r.major_version, r.is_indexed) for r in catalog.upsert(old, new).collect()}
    assert got == {"a": ("A2", "2", 4, False), "b": ("B2", "1", 4, True), "c": ("C", "1", 4, True), "d": ("D", "1", 4, True)}
    assert {r.id: r.major_version for r in catalog.upsert(old, new, update_keys=True).collect()}["a"] == 9
    assert catalog.upsert(old.limit(0), new.limit(0)).count() == 0
    assert {r.id for r in catalog.duplicate_ids(old, new).collect()} == {"a", "b"}
    assert catalog.by_version(old, "boot", 4, submodule="redis").count() == 0 and catalog.by_version(old, "boot", 4).count() == 3
    older = old.drop("submodule")
    assert catalog.add_missing_columns(older, old).schema == old.schema


def test_discover(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("c", "d"), ("x", "y"), (None, "z")], "source string, target string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in discover(e, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(r) for r in discover(e, start, 1).collect()} == {("a", 0), ("b", 1)} and discover(e, start, max_links=3).count() == 3
    assert discover(e.limit(0), start).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"targets": [{"module_key": "data", "submodule_key": "redis", "base_url": "b"}, {"module_key": "boot"}]}))
    assert [(r.module_key, r.submodule_key) for r in registry.read_registry(spark, str(tmp_path / "r.json")).collect()] == [("data", "redis"), ("boot", None)]
    (tmp_path / "m.csv").write_text("module,submodule,reference_url,api_url,version,github_repo,github_wiki_pages\nboot,,https://r,https://a,4,o/r,A|B\ndata,redis,https://r2,,4,,\n")
    jobs = registry.read_matrix(spark, str(tmp_path / "m.csv")).collect()
    assert {(j.module, j.lane) for j in jobs} == {("boot", "reference"), ("boot", "api"), ("boot", "wiki"), ("data", "reference")} and [j.pages for j in jobs if j.lane == "wiki"] == [["A", "B"]]
    d = tmp_path / "docs" / "boot"
    (d / "metadata").mkdir(parents=True)
    (d / "document.md").write_text("# A\n\ntext")
    (d / "metadata.json").write_text(json.dumps({"title": "T"}, indent=1))
    (d / "old.md").write_text("# B")
    (d / "metadata" / "old.json").write_text("{broken")
    read = registry.read_pages(spark, str(tmp_path / "docs")).collect()
    assert {r.path: r.markdown for r in read} == {"boot/document.md": "# A\n\ntext", "boot/old.md": "# B"}
    got = {r.path: r.metadata for r in read}
    assert set(got) == {"boot/document.md", "boot/old.md"} and got["boot/document.md"].title == "T" and (got["boot/old.md"] is None or got["boot/old.md"].title is None)
    assert {r.key for r in registry.list_objects(spark, str(tmp_path / "docs")).collect()} >= {"boot/document.md", "boot/metadata.json"}


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "document_id string, markdown string"
    spark.createDataFrame([("a", "# A\none"), ("b", "# B\ntwo")], schema).write.parquet(src)
    stream_chunks(spark, src, out, ck, schema)
    assert latest_chunks(spark, out).count() == 2
    spark.createDataFrame([("a", "# A\nnew\n## C\nmore")], schema).write.mode("append").parquet(src)
    stream_chunks(spark, src, out, ck, schema)
    stream_chunks(spark, src, out, ck, schema)
    assert {(r.document_id, r.section_path) for r in latest_chunks(spark, out).collect()} == {("a", "A"), ("a", "A > C"), ("b", "B")}


def test_vectors(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "x y")], "id string, text string")
    got = {r.id: list(r.embedding) for r in embed(df, "id", "text", hashing_strategy(8), batch=2).collect()}
    assert got["a"] == got["c"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and got["b"] == [0.0] * 8
    v = spark.createDataFrame([("a", "m", "", 1), ("b", "m", "s", 1), ("c", None, None, None)], "id string, module string, submodule string, version_major int")
    new = spark.createDataFrame([("a", "m", "", 2), ("z", "m", "", 2)], v.schema)
    assert {tuple(r) for r in upsert_vectors(v, new, "id").collect()} == {("a", "m", "", 2), ("z", "m", "", 2), ("b", "m", "s", 1), ("c", None, None, None)}
    assert {r.id for r in delete_vectors(v, module="m").collect()} == {"b", "c"} and delete_vectors(v, v.select("id")).count() == 0
    assert search.unknown_module(v, "q") and not search.unknown_module(v, "m") and not search.unknown_module(v.limit(0), "q")


def test_activation(spark, tmp_path):
    new, now = str(tmp_path / "new"), str(tmp_path / "now")
    for path, n in ((new, 2), (now, 1)):
        spark.range(n).write.parquet(path)
    activation.activate(spark, new, now)
    assert spark.read.parquet(now).count() == 2 and not (tmp_path / "new").exists() and not (tmp_path / "now.before").exists()
    with pytest.raises(FileNotFoundError):
        activation.activate(spark, new, now)
    assert spark.read.parquet(now).count() == 2
    m = spark.createDataFrame([("a/b", 1, False), ("/x", 1, False), ("a/../../b", 1, False), ("l", 1, True), (None, None, None)], "name string, size_bytes bigint, is_link boolean")
    bad, good = activation.archive_verdict(m).first(), activation.archive_verdict(m.limit(1)).first()
    assert (bad.problems, bad.safe) == (4, False) and good.safe


def test_parse_pages(spark):
    df = spark.createDataFrame([("https://d.x/4.0.1/g", "<main>x <span class=version>4.0.5</span></main>"), ("https://d.x/4.1/g.html", "<main>y</main>"), ("u", None), ("v", "<main> </main>"), ("w", "<main>z</main>")], "url string, html string")
    got = {r.url: (r.version, r.error) for r in pages.parse_pages(df).collect()}
    assert got == {"https://d.x/4.0.1/g": ("4.0.5", None), "https://d.x/4.1/g.html": ("4.1", None), "u": (None, "empty page"), "v": (None, "no content"), "w": (None, "no version")}
    assert one(spark, U.relative_path(F.col("k"), ["a/b/", "a/"]), k="a/b/c/d") == "c/d" and one(spark, U.relative_path(F.col("k"), ["z/"]), k="a/b/c") == "c"
    assert one(spark, manifests.manifest_hash(F.struct(F.col("k"))), k="x") == one(spark, F.sha2(F.lit('{"k":"x"}'), 256), k="x")
