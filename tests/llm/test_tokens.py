"""Tokenizer, packing, reading level."""

import codecs
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekiln.llm.packing import divided, pack_queues, pack_texts
from lorekiln.llm.reading import fit_ordinal, prose_sentences, reading_levels, sentence_features
from lorekiln.llm.tokenizing import FOLDER, PATTERN, count_tokens, decode_ids, encode_texts
from lorekiln.llm.transducer import ByteBPE, MergeTransducer, Utf8Machine, read_ranks

FILE = os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


@pytest.fixture(scope="module")
def bpe():
    with open(FILE, "rb") as f:
        return ByteBPE(read_ranks(f.read()), PATTERN)


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(FILE, "rb") as f:
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})


@needs_file
@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=("Cs",)), st.sampled_from(list("theining 漢字😀éß\n\t  '’s"))), max_size=60))
def test_ids_equal_the_public_library(bpe, public, text):
    ids = bpe.encode(text)
    assert ids == public.encode_ordinary(text) and bpe.decode(ids) == text


@needs_file
def test_long_and_special(bpe, public):
    for text in ("a" * 3000, " " * 2000 + "x", "=" * 999, "<|endoftext|>", "", "ab" * 1500, "\n\n\n  x"):
        assert bpe.encode(text) == public.encode_ordinary(text)
    assert bpe.encode(None) == []


@needs_file
def test_tables_may_be_emptied(bpe, public, monkeypatch):
    monkeypatch.setattr(MergeTransducer, "MAX_STATES", 50)
    monkeypatch.setattr(MergeTransducer, "MAX_PAIRS", 20)
    monkeypatch.setattr(ByteBPE, "MAX_WORDS", 3)
    text = "The incremental transducer forgets its states and makes them again, whatever the text is."
    assert bpe.encode(text) == public.encode_ordinary(text)


def test_small_vocabulary_by_definition():
    ranks = {bytes([i]): i for i in range(256)}
    for i, t in enumerate([b"ab", b"bc", b"abc", b"aa", b"aaa", b"bcd", b"cd", b"abcd"]):
        ranks[t] = 256 + i
    t = MergeTransducer(ranks)
    rng = np.random.default_rng(5)
    for _ in range(800):
        s = bytes(rng.choice(list(b"abcd"), rng.integers(1, 14)).astype(np.uint8))
        assert t.encode_piece(s) == t.merged(s)
    with pytest.raises(ValueError):
        MergeTransducer({b"a": 0})


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=24), st.integers(1, 5))
def test_utf8_machine(data, step):
    m = Utf8Machine()
    got = "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.finish()
    assert got == codecs.decode(data, "utf-8", "replace")


@needs_file
def test_token_tables(spark):
    df = spark.createDataFrame([(1, "a b", 7, "s"), (2, "", 7, None), (3, None, 7, "s"), (4, "漢 " * 3000, 7, "s")], "doc_id bigint, text string, ids int, source string")
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    assert got[2] == [] and got[3] == [] and len(got[1]) == 2
    assert {r.doc_id: r.tokens for r in count_tokens(df, ["doc_id"]).collect()} == {k: len(v) for k, v in got.items()}
    assert {r.doc_id: r.text for r in decode_ids(encode_texts(df)).collect()} == {1: "a b", 2: "", 3: "", 4: "漢 " * 3000}
    assert encode_texts(df.limit(0)).count() == 0


# packing

items = st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 40)), max_size=60)


@settings(max_examples=150, deadline=None)
@given(items)
def test_packing_properties(given_items):
    rows = [(i, s, n) for i, (s, n) in enumerate(given_items)]
    total = sum(n for *_, n in rows) or 1
    shares = {s: sum(n for _, k, n in rows if k == s) / total for s in {k for _, k, _ in rows}}
    out = pack_queues(rows, shares, 16)
    assert pack_queues(rows[::-1], shares, 16) == out
    fill, sizes = Counter(), Counter()
    for key, part, parts, box, start, n in out:
        sizes[key] += n
        if box is not None:
            assert start == fill[box] or n == 16
            fill[box] += n
    assert sizes == Counter({i: n for i, _, n in rows}) and all(v <= 16 for v in fill.values())
    for i, _, n in rows:
        mine = [o for o in out if o[0] == i]
        assert len(mine) == (1 if n <= 16 else -(-n // 16)) == mine[0][2]


def test_proportions_hold_in_every_window():
    rows = [(i, "a" if i % 4 else "b", 3 + i % 5) for i in range(4000)]
    total = sum(r[2] for r in rows)
    shares = {s: sum(n for _, k, n in rows if k == s) / total for s in "ab"}
    source = {i: s for i, s, _ in rows}
    boxes: dict = {}
    for key, _, _, box, _, n in pack_queues(rows, shares, 200):
        boxes.setdefault(box, Counter())[source[key]] += n
    early = list(boxes.values())[: len(boxes) * 3 // 4]
    assert all(abs(c["b"] / sum(c.values()) - shares["b"]) < 0.08 for c in early)
    assert sum(sum(c.values()) for c in boxes.values()) / (200 * len(boxes)) > 0.98


@needs_file
def test_pack_tables(spark, monkeypatch):
    import lorekiln.llm.packing as p

    monkeypatch.setattr(p, "TEXTS_PER_SHARD", 40)
    rows = [(i, "word " * (i % 30), "hot" if i % 3 else f"s{i % 7}", None) for i in range(150)] + [(900, "word " * 450, None, None), (901, None, None, None), (902, "", "hot", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    placed = pack_texts(df, 100).collect()
    fill = Counter()
    for r in placed:
        if r.container is not None:
            fill[r.container] += r.tokens
    assert max(fill.values()) <= 100 and {r.doc_id for r in placed} == {r[0] for r in rows} and {r.doc_id for r in divided(pack_texts(df, 100)).collect()} == {900}
    assert all((r.container is None) == (r.tokens == 0) for r in placed)
    assert pack_texts(df.limit(0), 100).count() == 0


# reading level


def test_prose_only():
    text = "# Head\n\nA short line here.\n\n```java\nx = 1;\n```\n\n    indented = code;\na.b.c = 3\n> quoted words stand here.\n\n\"A whole quoted sentence that is rather long and hard.\"\n- An item is prose too.\n"
    assert [s.strip() for s in prose_sentences(text)] == ["A short line here.", "An item is prose too."]
    assert sentence_features("```\ncode only\n```") is None and sentence_features("") is None and sentence_features(None) is None


def test_one_odd_sentence_changes_little():
    easy = " ".join(["The cat sees a dog."] * 12)
    odd = easy + " Notwithstanding incommensurable epistemological presuppositions, interdisciplinary reconceptualisation necessitates methodological circumspection."
    assert sentence_features(easy)[1][:3] == sentence_features(odd)[1][:3]


def test_ordinal_regression_orders_levels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    level = 1 + (x[:, 0] > -1).astype(int) + (x[:, 0] > 0) + (x[:, 0] > 1)
    y = np.stack([(level > k) for k in (1, 2, 3)], 1).astype(float)
    m = fit_ordinal(x, y)
    z = (x - m["mean"]) / m["scale"] @ m["slopes"]
    assert ((1 + (z[:, None] > m["thresholds"]).sum(1)) == level).mean() > 0.9 and list(m["thresholds"]) == sorted(m["thresholds"])


def test_levels(spark):
    easy, hard = "The cat sees a dog. A dog runs. It is fun.", "Notwithstanding the epistemological incommensurability of heterogeneous presuppositions, the reconceptualisation of methodological contingencies necessitates circumspection, whereas interdisciplinary instrumentation circumscribes paradigmatic interpolation. "
    rows = [(i, (easy if i % 2 else hard) * (1 + i % 3), 9, "x") for i in range(60)] + [(100, None, 9, None), (101, "", 9, None), (102, "```\ncode\n```", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, level int, rarity string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 4, "r") for i in range(20)] + [(0, 3, "s"), (None, 1, "r"), (5, None, "r")], "doc_id bigint, level int, rater string")
    got = {r.doc_id: r.level for r in reading_levels(docs, labels).collect()}
    assert set(got) == set(range(60)) and all((got[i] == 1) == bool(i % 2) and (i % 2 or got[i] >= 3) for i in got)
    assert reading_levels(docs, labels.limit(0)).count() == 60 and reading_levels(docs.limit(0), labels).count() == 0
