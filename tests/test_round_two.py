"""Chunk windows against brute force, written indexes, tool searches, ranks in ranges, scratch folders, catalog rules, versions."""

import hashlib
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lorekiln import session
from lorekiln.functions import text as T
from lorekiln.functions import url as U
from lorekiln.functions import version as V
from lorekiln.operators import apidoc, catalog, chunking, dense, embedding, lexical, manifests, pages, search
from lorekiln.operators.ranks import rank_in_ranges
from lorekiln.streaming.indexing import latest_chunks, stream_chunks


def brute_chunks(text, limit, overlap):
    """Sections and windows written out plainly: every position is looked at, nothing is remembered."""
    for pattern, keep in ((r"(?m)Copied!$", ""), (r"Copied!\s*```", "```"), (r"```\s*Copied!", "```"), (r"Copied!(?=\s|$)", ""), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, keep, text)
    lines, out, path, part = text.strip().splitlines(), [], [], []
    for line in [*lines, None]:
        level = 0 if line is None else len(line.strip()) - len(line.strip().lstrip("#"))
        heading = line is not None and 1 <= level <= 6 and line.strip()[level : level + 1].isspace() and line.strip()[level:].strip()
        if (heading or line is None) and part:
            out.append((" > ".join(path), "\n".join(part)))
            part = []
        if heading:
            path = path[: level - 1] + [line.strip()[level:].strip()]
        part.append(line)
    chunks = []
    for where, section in out:
        spans = [m.span() for m in re.finditer(r"\w+|[^\w\s]", section)]
        if len(spans) <= limit:
            pieces = [section]
        else:
            pieces, at = [], 0
            while True:
                end = min(at + limit, len(spans))
                raw = section[spans[at][0] : spans[end - 1][1]].strip()
                cut = raw
                if end < len(spans):
                    if raw.count("```") % 2 and raw.rfind("```") > len(raw) * 0.4 and raw[: raw.rfind("```")].strip():
                        cut = raw[: raw.rfind("```")].strip()
                    else:
                        for mark in ("\n\n", "\n- ", "\n* ", ". ", "! ", "? ", "; "):
                            if mark in raw[len(raw) // 2 :]:
                                cut = raw[: raw.rfind(mark) + len(mark)].strip()
                                break
                cut = cut or raw
                pieces.append(cut)
                if end == len(spans):
                    break
                at += max(1, len(re.findall(r"\w+|[^\w\s]", cut)) - overlap)
        chunks += [(where, p.strip()) for p in pieces if p.strip()]
    return chunks


def test_chunks_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setitem(chunking.TIERS, "tiny", (40, 6))
    rng = random.Random(7)
    bits = ["# A", "## B", "### C d", "#nope", "", "", "one two three. four five; six!", "- item a", "* item b", "```", "```java", "x = y;", "Copied!", " text  ", "ünï céde?", "\x0b", "word " * 30]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["# A\n\ntext one\n\n## B\nmore", "```\n" + "a b c. " * 60, "", None, "\r\n# X\r\ny\r\n", "``` " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id bigint, markdown string")
    got = {}
    for r in chunking.chunk_markdown(df, "tiny").orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append((r.section_path, r.content))
        assert r.content_hash == hashlib.sha256(r.content.encode()).hexdigest() and r.chunk_id == f"{r.document_id}-{r.chunk_index}" and r.has_code == ("`" in r.content)
    assert got == {i: c for i, t in enumerate(texts) if t is not None and (c := brute_chunks(t, 40, 6))}


def test_sections_take_linear_time():
    text = "\n".join("# t" if i % 10 == 0 else "line" for i in range(200_000))
    began = time.time()
    assert len(chunking.text_sections(text)) == 20_000 and time.time() - began < 5


def test_bm25_top_equals_all_scores(spark, tmp_path):
    texts = ["pool pool size", "pool", "", None, "size of a thing", "other", "pool", "nothing", "a b c", "d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    lexical.build_index(df, "id", "text").write(str(tmp_path / "i"))
    index = lexical.read_index(spark, str(tmp_path / "i"))
    ids = df.where("id % 2 = 0").select("id")
    for asked in ("pool", "pool pool size", "unknown", "", "a thing"):
        full = sorted(((-r.score, r.id) for r in lexical.bm25_scores(index, asked).collect()))
        for k in (1, 3, 20):
            assert [(-r.score, r.id) for r in lexical.bm25_top(index, asked, k).orderBy("rank").collect()] == full[:k]
            assert [(-r.score, r.id) for r in lexical.bm25_top(index, asked, k, ids).orderBy("rank").collect()] == [x for x in full if x[1] % 2 == 0][:k]


def test_a_term_that_counts_against_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "pool"), (2, "pool"), (3, "x")], "id bigint, text string")
    index = lexical.build_index(df.where("id < 3"), "id", "text")
    full = sorted(((-r.score, r.id) for r in lexical.bm25_scores(index, "pool").collect()))
    assert [(-r.score, r.id) for r in lexical.bm25_top(index, "pool", 2).orderBy("rank").collect()] == full


def test_tool_search(spark):
    docs = spark.createDataFrame([(i, f"u{i % 4}", "m" if i < 6 else None, "Guide" if i % 2 else None, 1 + i % 2) for i in range(8)], "id bigint, url string, module string, submodule string, version_major int")
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(8)], "vec_id bigint, embedding array<float>")
    index = lexical.build_index(spark.createDataFrame([(i, "pool " * (i + 1)) for i in range(8)], "id bigint, text string"), "id", "text")
    found = search.tool_search(index, vectors, docs, "pool", [0.0, 0.0], 3)
    rows = found.items.orderBy("place").collect()
    assert len(rows) == 3 and len({r.url for r in rows}) == 3 and [r.place for r in rows] == [1, 2, 3]
    status = found.status.first()
    assert (status.status, status.results_found, status.results_returned) == ("success", 4, 3) and status.message == "Found 3 relevant results"
    assert {r.id % 2 for r in search.tool_search(index, vectors, docs, "pool", [0.0, 0.0], 3, submodule="gUIDE").items.collect()} == {1}
    assert {r.id for r in search.tool_search(index, vectors, docs, "pool", [0.0, 0.0], 10, module="m", version=1).items.collect()} <= {0, 2, 4}
    none = search.tool_search(index, vectors, docs, "pool", [0.0, 0.0], 3, module="zz")
    assert none.status.first().status == "no_results" and none.items.count() == 0
    assert search.tool_search(index, vectors, docs, "pool", [0.0, 0.0], 3, threshold=0.9).status.first().status == "below_threshold"
    for bad in ({"top_k": 11}, {"version": 21}, {"version": 0}, {"threshold": 2.0}):
        with pytest.raises(ValueError):
            search.tool_search(index, vectors, docs, "pool", [0.0, 0.0], **bad)


def test_ranks_in_ranges(spark):
    rows = [(g, v, k) for g, v, k in [(None, 0.0, f"k{i:03d}") for i in range(300)] + [("a", float(i % 3), f"k{i:03d}") for i in range(50)]]
    df = spark.createDataFrame(rows, "g string, v double, k string")
    got = rank_in_ranges(df, ["g"], [F.col("v").desc(), F.col("k").asc()]).collect()
    for g in (None, "a"):
        assert [(r.v, r.k) for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == sorted(((v, k) for h, v, k in rows if h == g), key=lambda x: (-x[0], x[1]))
    assert rank_in_ranges(df.limit(0), ["g"], [F.col("v"), F.col("k")]).count() == 0


def test_scratch_folders_go(spark):
    df = session.settled(spark.range(3), "some")
    other = session.settled(spark.range(4), "other")
    paths = [p for p in session._made if "/some-" in p or "/other-" in p]
    session.discard(df)
    assert sum(session.exists(p) for p in paths) == len(paths) - 1 and other.count() == 4
    assert session.release(spark) >= 1 and not session._made


def test_stream_takes_the_newest_and_ends_documents(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "document_id string, markdown string, at int"
    spark.createDataFrame([("a", "# Z\nold", 1), ("a", "# A\nnew", 2), ("b", "# B\ntwo", 1), ("c", None, 1), (None, "x", 1)], schema).coalesce(1).write.parquet(src)
    stream_chunks(spark, src, out, ck, schema, order="at")
    assert {(r.document_id, r.content) for r in latest_chunks(spark, out).collect()} == {("a", "# A\nnew"), ("b", "# B\ntwo")}
    spark.createDataFrame([("b", "  \n", 5)], schema).write.mode("append").parquet(src)
    stream_chunks(spark, src, out, ck, schema, order="at")
    assert {r.document_id for r in latest_chunks(spark, out).collect()} == {"a"}
    spark.createDataFrame([("b", "# B\nback", 6)], schema).write.mode("append").parquet(src)
    stream_chunks(spark, src, out, ck, schema)  # by the arrival of files
    assert {r.document_id for r in latest_chunks(spark, out).collect()} == {"a", "b"}


def test_listings_freshness_and_uploads(spark):
    one = spark.createDataFrame([("k", 1), ("a/manifest.json", 2)], "key string, size_bytes int")
    two = spark.createDataFrame([("k", 9), ("l", 3), ("l", 3)], "key string, size_bytes int")
    assert sorted(tuple(r) for r in manifests.distinct_objects([one, two]).collect()) == [("k", 1), ("l", 3)]
    stored = spark.createDataFrame([("x", "1"), ("y", "1"), ("w", "1")], "scope string, token string")
    latest = spark.createDataFrame([("x", "1"), ("x", "0"), ("y", "2"), ("z", "1")], "scope string, token string")
    assert {tuple(r) for r in manifests.freshness(stored, latest).collect()} == {("x", "1", "skip"), ("y", "2", "refresh"), ("z", "1", "refresh"), ("w", "1", "missing")}
    have = spark.createDataFrame([("k", "h2", 2), ("k", "h1", 1)], "key string, content_hash string, last_modified int")
    target = spark.createDataFrame([("k", "h1"), ("n", "h"), ("m", None)], "key string, content_hash string")
    assert {tuple(r) for r in manifests.upload_status(target, have).collect()} == {("k", "skipped"), ("n", "uploaded"), ("m", "uploaded")}
    assert manifests.upload_status(target, have, force=True).where("status = 'skipped'").count() == 0


def test_missing_manifest_is_empty(spark, tmp_path):
    assert manifests.read_manifest(spark, str(tmp_path / "none.json"), "version string").count() == 0
    (tmp_path / "m.json").write_text('{"version":\n "1"}')
    assert manifests.read_manifest(spark, str(tmp_path / "m.json"), "version string").first().version == "1"


def test_reindex_and_runs(spark):
    records = spark.createDataFrame([("a", "m", None, 1, True), ("b", "m", "s", 1, True)], "id string, module string, submodule string, major_version int, is_indexed boolean")
    vectors = spark.createDataFrame([("a", "m", "", 1), ("n", "m", None, 1), ("b", "m", "s", 1), ("c", None, None, None)], "id string, module string, submodule string, version_major int")
    r, v = catalog.reindex(records, vectors, "m")
    assert {x.id for x in r.where("is_indexed").collect()} == {"b"} and {x.id for x in v.collect()} == {"b", "c"}
    assert catalog.reindex(records, vectors)[1].count() == 0
    history = spark.createDataFrame([(1, "m", None, "1", "failed", None, "bad")], "id bigint, module string, submodule string, version string, status string, started_at timestamp, error_message string")
    assert catalog.start_run(history, 2, "m", "1", F.current_timestamp()).where("status = 'in_progress'").count() == 1
    with pytest.raises(ValueError):
        catalog.start_run(history, 1, "m", "1", F.current_timestamp())
    assert [r.error_message for r in catalog.sync_errors(history).collect()] == ["bad"]


def test_vectors_are_attached_by_key(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "id string")
    vectors = spark.createDataFrame([("b", [1.0]), ("b", [1.0]), ("a", None)], "id string, embedding array<double>")
    assert {(r.id, r.error) for r in embedding.attach_vectors(chunks, vectors, "id").collect()} == {("a", "no vector"), ("b", None)}


OLD = """<header><div class="subTitle">org.old.api</div></header><pre class="x"></pre><div class="description"><pre>@Deprecated(since="3") public interface Shop extends Base&lt;K&gt;, More</pre></div>
<section class="methodDetails"><ul><li class="blockList"><pre>@Get("/a(b)") default &lt;T extends X&gt; List&lt;T&gt; all(@Nullable final String name, int[] n) throws Bad;</pre>
<dl><dt>Parameters:</dt><dd><code>name</code> - its name</dd><dt>Returns:</dt><dd>all of them</dd><dt>Throws:</dt><dd><code>Worse</code> - never</dd></dl><div>Deprecated. Use one.</div></li>
<li class="blockList"><pre>default &lt;U&gt; List&lt;T&gt; all(String other, int[] m)</pre></li><li class="blockList"><pre>Shop()</pre></li></ul></section>"""


def test_older_api_pages():
    s = apidoc.class_signature(OLD)
    assert (s["package"], s["name"], s["kind"], s["extends"], s["implements"], s["annotations"], s["is_deprecated"]) == ("org.old.api", "Shop", "interface", "Base<K>, More", ["Base<K>", "More"], ['@Deprecated(since="3")'], True)
    (m,) = s["methods"]  # the second one has the same name, types and result; a constructor is no method
    assert m["return_type"] == "List<T>" and m["modifiers"] == ["default"] and m["annotations"] == ['@Get("/a(b)")']
    assert [(p["name"], p["type"], p["description"]) for p in m["parameters"]] == [("name", "String", "its name"), ("n", "int[]", None)]
    assert m["throws"] == ["Worse", "Bad"] and m["is_deprecated"] and m["return_description"] == "all of them"
    lines = apidoc.signature_markdown(s).split("\n")
    assert lines[0] == "# org.old.api.Shop" and "- `Base<K>`" in lines and "  - `@param name`: its name" in lines and "  - `@throws Bad`" in lines and "  - `@return`: all of them" in lines
    assert apidoc.class_signature("<div class='type-signature'>nothing here</div>") is None


def test_core_content_falls_back(spark):
    rows = [("<div id=content>a <b>b</b></div>",), ("<body><p>only  body</p></body>",), ("<main> </main><article class='doc'>z</article>",), (None,), ("",)]
    got = [r.c for r in spark.createDataFrame(rows, "h string").select(pages.core_content(F.col("h")).alias("c")).collect()]
    assert got == ["a b", "only body", "z", None, None]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(T.matched_name(F.lit(" Release_Notes"), ["guide", "release-notes"])) == "release-notes" and one(T.matched_name(F.lit(None), ["a"])) is None
    assert one(U.in_preview_folder(F.lit("a/Preview/b"))) and not one(U.in_preview_folder(F.lit("a/preview")))
    assert one(U.target_prefixes(F.lit("m"), F.lit(""), F.lit("1"))) == ["m/1/"] and one(U.target_prefixes(F.lit("m"), F.lit("s"), F.lit("1"))) == ["m-s/1/", "m/s/1/"]
    assert one(V.compare_versions(F.lit("m"), V.parse_version(F.lit("1.2")), F.lit("m"), V.parse_version(F.lit("1.10")))) == (-1, None)
    assert one(V.compare_versions(F.lit("m"), V.parse_version(F.lit("1.2")), F.lit("n"), V.parse_version(F.lit("1.2")))).error == "different modules"
    assert not one(V.is_removed(F.lit(None).cast("string"), F.lit("1")))
    assert tuple(one(T.query_parts(F.lit(" a module=x  b version=y version=3")))) == ("a b", "x", "3", None)
    assert not one(T.has_deprecations(F.lit(None).cast("array<string>"))) and one(U.is_http(F.lit(None).cast("string"))) is False


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_index_over_cells_recalls(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    cells = dense.build_cells(rows, str(tmp_path / "cells"))
    assert spark.read.parquet(f"{cells.path}/vectors").count() == rows.where("embedding is not null").count()
    assert dense.recall(rows, cells, every=200) >= 0.9
    assert dense.build_cells(rows.limit(0), str(tmp_path / "none")).centres == []
