"""wiki_tagged takes documents of every type, each tagged by its own."""

from lorekiln.plans import search_queries as Q


def test_every_type_is_tagged(spark, tmp_path):
    rows = [(1, "release-notes", "a\n## New (x)\nb"), (2, "migration-guide", "a\n## Up\nb"), (3, "guide", "no head"), (4, "guide", None)]
    spark.createDataFrame(rows, "doc_id bigint, content_type string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tagged for r in Q.wiki_tagged(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[2] == '<migration_guide version="1.0.0">\na\n  <section name="up" title="Up">\n    ## Up\n    b\n  </section>\n</migration_guide>'
    assert got[1].startswith("<release_notes ") and got[3] == '<guide version="1.0.0">\nno head\n</guide>'
