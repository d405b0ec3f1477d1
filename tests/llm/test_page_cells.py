"""Boilerplate of pages that share a path or have no url, and of hosts of any size."""

import pytest

import lorekiln.llm.boilerplate as B

SECTIONS = "page_id bigint, url string, section_ord int, title string, content string, scraped_at int"


def page(i, url):
    own = "abcdefghijklmnopqrstuvwxyz"
    words = f"{own[i % 26]}{own[i // 26 % 26]}{own[(i * 7 + 3) % 26]}"
    return (i, url, 1, None, f"Jump past the header\nThe sentence {words} stands on this page and nowhere else {words}.\nThe other sentence {words} is its own as well {words}.\nImprint of the site", 1)


@pytest.fixture
def ranges(spark):
    """Sets the number of ranges the order of pages is cut into."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("url", [None, "", "https://php.example/index.php?id={}"])
def test_pages_of_one_path_are_compared(spark, url):
    rows = [page(i, url and url.format(i)) for i in range(40)]
    rows += [(i + 100, *r[1:]) for i, r in enumerate(rows[:3])]  # the same pages with other ids
    got = {tuple(r) for r in B.boilerplate_lines(spark.createDataFrame(rows, SECTIONS)).collect()}
    assert got == {(r[0], 1, k) for r in rows for k in (1, 4)}


def test_copies_are_compared_once_and_next_to_the_nearest(spark):
    rows = [page(i, f"https://php.example/index.php?id={i:03d}") for i in range(60)]
    rows += [(i + 100, *r[1:]) for i, r in enumerate(rows[:5])]
    pages, others = B.compared_pages(spark.createDataFrame(rows, SECTIONS))
    got = {r.page_id: r.neighbours for r in pages.collect()}
    assert got == {i: 1 if i in (0, 59) else 2 for i in range(60)}
    assert {(r.page_id, r.other) for r in others.collect()} == {(i, i + 100) for i in range(5)}


def test_neighbours_do_not_depend_on_how_the_order_is_cut(spark, ranges):
    rows = [(*page(i, f"https://big.example/{'ab'[i % 2]}/page-{i:03d}")[:3], f"Part number {i} here", page(i, "")[4], 1) for i in range(50)]
    # a side bar that only three pages next to each other have, and a list of far pages
    rows = [(*r[:4], f"In this chapter\nPart number {(r[0] + 25) % 50} here\n{r[4]}" if r[0] in (20, 22, 24) else r[4], 1) for r in rows]
    rows += [page(90 + i, f"https://other{i}.example/x") for i in range(3)]  # alone on their sites
    df = spark.createDataFrame(rows, SECTIONS)
    found = []
    for n in (1, 2, 9):
        ranges(n)
        pages, _ = B.compared_pages(df)
        found.append((sorted(map(str, pages.collect())), sorted(map(tuple, B.boilerplate_lines(df).collect()))))
    assert found[0] == found[1] == found[2]
    assert {(i, 1, 1) for i in (20, 22, 24)} <= set(found[0][1])
    assert all(("neighbours=0" in p) == ("page_id=9" in p and "page_id=9," not in p) for p in found[0][0])


def test_a_third_of_the_rows_in_one_page_or_section(spark):
    rows = [page(i, f"https://s.example/p{i:02d}") for i in range(20)]
    rows += [rows[7]] * 300 + [(7, "https://s.example/p07", 1, None, "An older text of the page", 0)] * 50
    got = {tuple(r) for r in B.boilerplate_lines(spark.createDataFrame(rows, SECTIONS)).collect()}
    assert got == {(i, 1, k) for i in range(20) for k in (1, 4)}


def test_a_long_menu_has_its_parts():
    parts = [f"Part number {i}" for i in range(60)]
    assert B.line_parts("* " + " | ".join(parts)) == ["part number #"] * 60
    assert B.line_parts("word " * 200) == []


def test_shared_chunk_lines(spark):
    from lorekiln.llm.residue import shared_chunk_lines

    records = [(f"d{i}", f"https://a.example/{i:02d}", 1, "x") for i in range(6)] + [("d0", "https://z.example/old", 0, "x"), ("d9", None, 1, "x"), (None, None, None, None)]
    chunks = [(f"d{i}-{k}", f"d{i}", k, f"Own words {i} {k}\r\n\r\n Same line \r\nMore {i}{k}", 1) for i in range(6) for k in range(2)]
    chunks += [chunks[0]] * 20 + [("n-0", None, None, None, None), ("e-0", "d9", 0, "", None), ("z-0", "nowhere", 0, "Same line", 1)]
    df = spark.createDataFrame(chunks, "chunk_id string, document_id string, chunk_index int, content string, url int")
    rec = spark.createDataFrame(records, "id string, url string, scraped_at int, content string")
    got = sorted(tuple(r) for r in shared_chunk_lines(df, rec).collect())
    assert got == sorted((f"d{i}-{k}", 3) for i in range(6) for k in range(2))
    assert shared_chunk_lines(df.limit(0), rec).count() == 0
