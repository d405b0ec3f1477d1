"""Nearest-URL page differencing: which lines a page shares with the pages next to it in the URL order of its site.

All pages are put in the order of site and URL, one shuffle of line hashes; each task then walks its range once and aligns
every page with the one before it by longest common subsequence. Pages at the ends of ranges meet in a second, small pass, so
the pages compared do not depend on how the order was cut, and no task holds more than two pages.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekiln.session import settled

_ADDED = {"shared": T.ArrayType(T.BooleanType()), "neighbours": T.IntegerType(), "edge": T.IntegerType(), "range": T.IntegerType()}
FIRST, LAST = 1, 2


def shared_lines(a: Sequence, b: Sequence) -> tuple[set[int], set[int]]:
    """Positions in a and in b of one longest common subsequence (equal heads and tails are matched first)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha -= 1
        hb -= 1
    in_a = {*range(lo), *range(ha, len(a))}
    in_b = {*range(lo), *range(hb, len(b))}
    # positions of each line in b, latest first: a longest increasing run of them is a longest common subsequence
    where: dict = {}
    for j in range(hb - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i in range(lo, ha):
        for j in where.get(a[i], ()):
            at = bisect_left(tails, j)
            node = (i, j, ends[at - 1] if at else None)
            if at == len(tails):
                tails.append(j)
                ends.append(node)
            else:
                tails[at] = j
                ends[at] = node
    node = ends[-1] if ends else None
    while node:
        in_a.add(node[0])
        in_b.add(node[1])
        node = node[2]
    return in_a, in_b


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the lines it shares with the row before and after it in this range."""
    tail: pa.RecordBatch | None = None
    carried: set[int] = set()
    met, first = 0, True

    def out(rows: pa.RecordBatch, shared: list, neighbours: list, edge: list) -> pa.RecordBatch:
        added = [pa.array(shared, pa.list_(pa.bool_())), pa.array(neighbours, pa.int32()), pa.array(edge, pa.int32())]
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], *added, rows.columns[-1]], schema=schema)

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            whole = part if tail is None else pa.Table.from_batches([tail, part]).combine_chunks().to_batches()[0]
            site, form = whole.column("site").to_pylist(), whole.column("form").to_pylist()
            shared, neighbours, edge = [], [], []
            for i in range(len(form) - 1):
                here, there = carried, set()
                n = met
                met = 0
                if site[i] == site[i + 1]:
                    mine, there = shared_lines(form[i], form[i + 1])
                    here = here | mine
                    n, met = n + 1, 1
                shared.append([j in here for j in range(len(form[i]))])
                neighbours.append(n)
                edge.append(FIRST if first else 0)
                carried, first = there, False
            if shared:
                yield out(whole.slice(0, len(shared)), shared, neighbours, edge)
            tail = whole.slice(len(form) - 1, 1)
    if tail is not None:
        lines = tail.column("form").to_pylist()[0]
        yield out(tail, [[j in carried for j in range(len(lines))]], [met], [LAST | (FIRST if first else 0)])


def _meet(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(page, more, met) of the pages at the ends of ranges, in order: what a page shares with its neighbour in the next range."""
    prev = None
    for b in batches:
        for site, form, at, page in zip(*(b.column(c).to_pylist() for c in ("site", "form", "range", "page"))):
            if prev is not None and prev[2] != at and prev[0] == site:
                x, y = shared_lines(prev[1], form)
                yield pa.RecordBatch.from_arrays([pa.array([prev[3], page], pa.int64()), pa.array([sorted(x), sorted(y)], pa.list_(pa.int32())), pa.array([1, 1], pa.int32())], schema=schema)
            prev = (site, form, at, page)


def shared_with_nearest(pages: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`pages` with `shared`, a flag for each line, and `neighbours`, the number of pages it was compared with; written down.

    `pages` has page (bigint, unique), site, form (array<bigint>, the hash of each line) and the columns of `order`, which
    begins with site and is total. A page that is alone on its site has no neighbour and shares nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    base = pages.withColumn("range", F.lit(0))
    fields = [*pages.schema.fields, *[T.StructField(n, _ADDED[n]) for n in ("shared", "neighbours", "edge")], T.StructField("range", T.IntegerType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    ranged = base.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    walked = settled(ranged.mapInArrow(lambda b: _walk(b, arrow), schema), name)
    # two pages a range at most, so this one task is bounded by the number of partitions; ranges follow the order
    ends = walked.where("edge > 0").select("site", "form", "range", "page", "edge").repartition(1).sortWithinPartitions("range", "edge")
    small = T.StructType([T.StructField("page", T.LongType()), T.StructField("more", T.ArrayType(T.IntegerType())), T.StructField("met", T.IntegerType())])
    meeting = to_arrow_schema(small)
    met = ends.mapInArrow(lambda b: _meet(b, meeting), small).groupBy(F.col("page").alias("__page")).agg(F.flatten(F.collect_list("more")).alias("more"), F.sum("met").cast("int").alias("met"))
    joined = walked.join(F.broadcast(met), F.col("page") == F.col("__page"), "left")
    both = F.when(F.col("more").isNull(), F.col("shared")).otherwise(F.transform("shared", lambda s, i: s | F.array_contains("more", i)))
    return joined.select(*pages.columns, both.alias("shared"), (F.col("neighbours") + F.coalesce("met", F.lit(0))).alias("neighbours"))
