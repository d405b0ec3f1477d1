"""The command line on small folders."""

import json
import os

import pytest

from lorekiln import cli

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_index_search_status(spark, tmp_path, capsys):
    out = str(tmp_path / "i")
    assert cli.main(["index", DATA, out], spark) == 0
    assert cli.main(["search", DATA, out, "connection pool", "--json", "--top-k", "2"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["status"] == "success" and [r["rank"] for r in found["results"]] == [1, 2] and found["results"][0]["content"].startswith("<doc_chunk ")
    assert cli.main(["search", DATA, out, "connection pool", "--module", "none"], spark) == 0 and "No results" in capsys.readouterr().out
    assert cli.main(["search", DATA, out, "x"], spark) == 1 and "Search failed" in capsys.readouterr().out  # too short a query
    assert cli.main(["search", DATA, out, "connection pool", "--prompt"], spark) == 0 and capsys.readouterr().out.startswith("## Search Results")
    assert cli.main(["status", DATA], spark) == 0 and "spring-boot" in capsys.readouterr().out
    assert cli.main(["chunk", DATA, str(tmp_path / "c"), "--tier", "xslim"], spark) == 0 and spark.read.parquet(str(tmp_path / "c")).count() > 100


def test_delta_and_ingest(spark, tmp_path, capsys):
    (tmp_path / "old.json").write_text('{"path": "a", "content_hash": "1", "size_bytes": 1}\n{"path": "b", "content_hash": "1", "size_bytes": 1}\n')
    (tmp_path / "new.json").write_text('{"path": "a", "content_hash": "2", "size_bytes": 1}\n{"path": "c", "content_hash": "1", "size_bytes": 5}\n')
    assert cli.main(["delta", str(tmp_path / "old.json"), str(tmp_path / "new.json")], spark) == 0
    shown = capsys.readouterr().out
    assert all(w in shown for w in ("modified", "removed", "added"))
    wiki = tmp_path / "wiki"
    wiki.mkdir()
    for name, text in (("X-3.1.0-Release-Notes.md", "# N\n## New\nold"), ("X-3.1.4-Release-Notes.md", "# N\n## New\nnew"), ("X-3.2-Release-Notes.md", " "), ("Home.md", "# Home")):
        (wiki / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r for r in cli.ingest(spark, str(wiki)).collect()}
    assert set(got) == {"X-3.1.4-Release-Notes.md", "X-3.2-Release-Notes.md", "Home.md"}
    assert got["X-3.1.4-Release-Notes.md"].markdown.startswith('<release_notes version="3.1.4">') and got["X-3.1.4-Release-Notes.md"].title == "N"
    assert got["Home.md"].error == "no version" and got["X-3.2-Release-Notes.md"].error == "empty page"
