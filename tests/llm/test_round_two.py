"""Counts over several contents, exact medians of large groups, cleaned texts by hand, packing by shards."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

import lorekiln.llm.packing as packing
from lorekiln.llm.distinctive import shared_rare_terms, term_counts, term_weights, top_terms
from lorekiln.llm.markup import clean_markup
from lorekiln.llm.packing import pack_queues
from lorekiln.llm.score_fusion import fuse_scores, head_candidates, medians, rank_fused

CHUNKS = "chunk_id string, document_id string, content string, term string, n int"


def test_contents_of_one_chunk_add_up(spark):
    rows = [("a-0", "a", "Rarest rarest one", None, 1), ("a-0", "a", "rarest and RAREST", None, 1), ("a-0", "a", "Rarest rarest one", None, 1), ("b-0", "b", "rarest", None, 1)]
    rows += [(None, "c", "rarest rarest rarest", None, 1), (None, "c", "nothing else", None, 1), ("n-0", "n", None, None, 1), ("e-0", "e", "", None, 1)]
    df = spark.createDataFrame(rows, CHUNKS)
    got = {(r.chunk_id, r.term): (r.n, r.length) for r in term_counts(df).where("chunk_id is not null").collect()}
    assert got["a-0", "rarest"] == (4, 6) and got["b-0", "rarest"] == (1, 1)
    assert {tuple(r) for r in shared_rare_terms(df).collect()} == {("a-0", "rarest"), (None, "rarest")}
    assert shared_rare_terms(df.limit(0)).count() == 0 and top_terms(df.limit(0)).count() == 0


def test_top_terms_are_those_of_all_weights(spark, monkeypatch):
    import lorekiln.llm.distinctive as D

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"d{i % 7}-{i}", f"d{i % 7}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 30))), None, 1) for i in range(60)]
    rows += [rows[0]] * 100  # a third of all rows and more is one chunk
    df = spark.createDataFrame(rows, CHUNKS)
    every = {}
    for r in term_weights(df).collect():
        every.setdefault(r.chunk_id, []).append((-round(r.weight, 6), r.term))
    want = {(c, t, i) for c, x in every.items() for i, (_, t) in enumerate(sorted(x)[:5], 1)}
    for frequent in (1, 30, 20_000):  # the share from which a term is looked up by broadcast changes nothing
        monkeypatch.setattr(D, "FREQUENT", frequent)
        assert {(r.chunk_id, r.term, r.place) for r in top_terms(df).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3, 10, 25_001])
def test_medians_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), 0.25, 1e300, -5.0]) for _ in range(n)]
    rows = [(7, v) for v in values] + [(8, None), (None, 3.0), (9, float("inf"))]
    got = {r.query_id: r.m for r in medians(spark.createDataFrame(rows, "query_id bigint, v double").repartition(5), {"m": F.col("v")}).collect()}
    assert got[7] == statistics.median_low(values) and got.get(8) is None and got[None] == 3.0 and got[9] == math.inf


def test_a_hot_query_of_ties_is_ranked(spark):
    rows = [(1, f"c{i:05d}", None if i % 2 else 1.0, 2.0, i) for i in range(3000)] + [(2, "x", float("nan"), None, 1), (None, "y", 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "query_id bigint, chunk_id string, dense_score double, sparse_score double, scored_at int")
    got = [r.chunk_id for r in rank_fused(df).where("query_id = 1").orderBy("rank").collect()]
    assert got == [f"c{i:05d}" for i in range(0, 3000, 2)] + [f"c{i:05d}" for i in range(1, 3000, 2)]
    assert head_candidates(df).where("query_id = 1").count() == 1500
    assert fuse_scores(df.limit(0)).count() == 0


CLEAN = [
    (r"\begin{tabular}{lr}Key & Value \\ a & b\end{tabular} but read \& write & go on", "Key | Value \\\\ a | b but read \\& write & go on"),
    (r"See Figure~\ref{fig:one} and \cite[p. 2]{knuth}, then cd ~/x \textbf{now}", "See Figure [fig:one] and [knuth], then cd ~/x now"),
    ("{{Warning|text=Back up first}} then {{Reflist|2}} go [[A|b]]", "Warning: Back up first then  go b"),
    ("{{Note|Keep {{key|x|a b}} safe now}} [[x]]", "Note: Keep key: a b safe now x"),
    (r"\textbf{a \emph{b \texttt{c \underline{d}}}}", "a b c d"),
    ("x\n                * deep item\n1234. fourth\n", "x\n                - deep item\n1234. fourth"),
    ("**a __b *c ~~d~~ e* f__ g**", "a b c d e f g"),
    ("Title\n=====\n\ntext <b>x</b> &amp; `a<b`", "# Title\n\ntext x & a<b"),
    ("# H\n\n- one\n  - two\n\n```java\nx && y\n```\n$a^2$ done", "# H\n\n- one\n  - two\n\n```\nx && y\n```\n\n$a^2$ done"),
]


@pytest.mark.parametrize("given,want", CLEAN)
def test_cleaned_by_hand(given, want):
    clean, code, _ = clean_markup(given)
    assert clean == want
    assert code == ("`" in given)


def test_shards_cost_little(spark):
    rng = random.Random(5)
    items = [(i, f"s{min(3, int(rng.expovariate(1)))}", int(rng.lognormvariate(5, 1)) + 1) for i in range(20_000)]
    shares = {s: sum(n for _, t, n in items if t == s) / sum(n for *_, n in items) for s in {t for _, t, _ in items}}
    fill = {}
    for shards in (1, 8, 64):
        boxes = 0
        for k in range(shards):
            boxes += len({(x[3]) for x in pack_queues([i for i in items if i[0] * 2654435761 % shards == k], shares, 2048) if x[3] is not None})
        fill[shards] = sum(n for *_, n in items) / (boxes * 2048)
    assert fill[1] > 0.99 and fill[8] > 0.985 and fill[64] > 0.97


def test_each_shard_is_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "TEXTS_PER_SHARD", 5)
    df = spark.createDataFrame([(i, "s", "word " * (i % 50)) for i in range(60)], "doc_id bigint, source string, text string")
    out = packing.pack_texts(df, 64)
    assert out.rdd.getNumPartitions() == 12 and out.select("doc_id").distinct().count() == 60
