"""lorekiln: a Spark-native engine that builds, maintains and searches a documentation corpus.

Sub-packages
------------
functions   pure Column expressions (text, url, version, vector)
operators   DataFrame-to-DataFrame operators (catalog, manifests, chunking, search, ...)
sources     readers for tables, registries and page trees
plans       the named queries with their SQL counterparts
streaming   incremental indexing as a structured stream
llm         operators for training-text pipelines; optional, nothing else imports it
"""

__version__ = "0.1.0"
