"""Chunk queries over all chunks, whatever their line ends: against brute force on a small table."""

import hashlib
import re

from lorekiln.plans import search_queries as Q

LF = "# Head\n\n\n\n@Bean(x) text Copied!\n```kotlin\nval a = 1\n```\n## Next\nmore @Test"
ROWS = [("lf", LF), ("crlf", LF.replace("\n", "\r\n")), ("cr", LF.replace("\n", "\r")), ("mixed", LF.replace("\n", "\r\n", 3)), ("null", None), ("empty", "")]


def sections(text):
    out = [[]]
    for line in text.split("\n"):
        if re.match(r"#{1,6}\s+\S", line):
            out.append([])
        out[-1].append(line)
    return ["\n".join(x) for x in out if "".join(x).strip()]


def test_line_ends(spark, tmp_path):
    spark.createDataFrame(ROWS + ROWS[:2], "chunk_id string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    rows = lambda name: sorted((tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    texts = ("lf", "crlf", "cr", "mixed")
    clean = re.sub(r"\n{3,}", "\n\n", LF.replace("Copied!", ""))
    assert rows("md_clean") == sorted([*((t, clean) for t in texts), ("null", None), ("empty", "")], key=str)
    assert rows("heading_split") == sorted(((t, path, hashlib.md5(s.encode()).hexdigest()) for t in texts for path, s in zip(("Head", "Head > Next"), sections(LF))), key=str)
    assert rows("chunk_marks") == sorted([*((t, "Bean,Test", "Head") for t in texts), ("null", "", ""), ("empty", "", "")], key=str)
    assert rows("code_languages") == sorted(((t, "kotlin", "kotlin") for t in texts), key=str)
