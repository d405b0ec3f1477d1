"""Running a Python function over one column of a DataFrame in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def flat_map(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str, rows: int = 512) -> DataFrame:
    """For each row call f(*row) and keep the tuples it returns, one output row each.

    `make` runs once a task and returns f, so that tables and caches are built in the worker. Output goes out in batches of
    about `rows` rows, so memory is bounded by the input batch and these, however many rows an input row makes.
    """
    target = T._parse_datatype_string(schema)
    fields = target.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        f = make()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out.extend(f(*row))
                    if len(out) >= rows:
                        yield batch()
                        out.clear()
        if out:
            yield batch()

    return df.mapInArrow(run, target)
