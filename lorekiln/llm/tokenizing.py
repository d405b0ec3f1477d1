"""Encoding a corpus with a public byte-level tokenizer."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorekiln.llm.transducer import ByteBPE, read_ranks

#: Where the vocabulary files lie; LOREKILN_TOKENIZERS or the parameter `folder` name another place.
FOLDER = os.environ.get("LOREKILN_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the byte-level vocabularies split a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, ByteBPE] = {}


def load(ranks: bytes) -> ByteBPE:
    """The encoder of a rank file; built once a worker, with its tables kept between tasks."""
    key = hashlib.sha1(ranks).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(read_ranks(ranks), PATTERN)
    return _loaded[key]


def _ranks(df: DataFrame, tokenizer: str, folder: str | None):
    data = Path(folder or FOLDER, f"{tokenizer}.tiktoken").read_bytes()  # under 1 MB, sent to each executor once
    return df.sparkSession.sparkContext.broadcast(data)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, one row per input row; an empty list for an empty and for a null text.

    One narrow pass without a shuffle. Texts pass through whole, in Arrow batches cut to 64 rows each.
    """
    import pyarrow as pa

    sent = _ranks(df, tokenizer, folder)
    source = df.select(key, text)

    def run(batches):
        bpe = load(sent.value)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                ids, ends = [], [0]
                for t in part.column(1).to_pylist():
                    ids += bpe.encode(t)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    out = T.StructType([source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, out)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(*keep, tokens): the number of ids of each text; 0 for an empty and for a null text."""
    import pyarrow as pa

    sent = _ranks(df, tokenizer, folder)
    source = df.select(*keep, text)
    at = len(keep)

    def run(batches):
        bpe = load(sent.value)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                n = pa.array([len(bpe.encode(t)) for t in part.column(at).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], n], names=[*keep, "tokens"])

    out = T.StructType([*[source.schema[c] for c in keep], T.StructField("tokens", T.LongType())])
    return source.mapInArrow(run, out)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text): the texts of lists of ids, decoded as a stream; null for a null list, U+FFFD for bytes that are no UTF-8."""
    import pyarrow as pa

    sent = _ranks(df, tokenizer, folder)
    source = df.select(key, ids)

    def run(batches):
        bpe = load(sent.value)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                texts = [None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, T.StructType([source.schema[key], T.StructField("text", T.StringType())]))
