"""Filling fixed-capacity containers with texts, at controlled proportions of their sources.

Method: deficit round-robin over one queue per source. Every window (container) credits each source with its target share of
the capacity; the source with the largest credit places its largest fitting text; what a source got too much or too little
is carried to the next window, and from one partition to the next.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm.tokenizing import count_tokens
from lorekiln.operators.ranks import sum_before
from lorekiln.session import settled

#: What one task packs at a time: so many containers' worth of tokens, and at most about so many texts.
WINDOWS_PER_SHARD, TEXTS_PER_SHARD = 2000, 50_000


def pack_queues(items: Iterable[tuple], shares: dict, capacity: int, credit: dict | None = None) -> list[tuple]:
    """Pack (key, source, tokens) into containers; returns (key, part, parts, container, start, tokens).

    An item above the capacity is divided: full containers, then a last part that is packed like any other; no other item is
    divided. Items without tokens need no container (None). `shares` are the target proportions by source, `credit` the
    tokens each source is owed at the start. Items of one size are taken in the order of their keys, so the result does not
    depend on the order of the input.
    """
    queues: dict = {}
    out: list[tuple] = []
    box = 0
    credit = {s: float((credit or {}).get(s, 0.0)) for s in shares}
    for key, source, n in sorted(items, key=lambda x: (x[1], x[2], x[0]), reverse=True):
        credit.setdefault(source, 0.0)
        if n <= 0:
            out.append((key, 1, 1, None, 0, 0))
            continue
        parts = -(-n // capacity)
        for p in range(1, parts):
            out.append((key, p, parts, box, 0, capacity))
            for s, w in shares.items():
                credit[s] += w * capacity
            credit[source] -= capacity
            box += 1
        queues.setdefault(source, []).append((n - (parts - 1) * capacity, key, parts))
    for q in queues.values():
        q.sort(key=lambda x: (x[0], x[1]))
    while queues:
        for s, w in shares.items():
            credit[s] += w * capacity
        room = capacity
        while room > 0:
            fitting = [s for s, q in queues.items() if q[0][0] <= room]
            if not fitting:
                break
            # the most indebted source goes first; once none is owed anything, the best fit closes the container
            owed = max(fitting, key=lambda s: (credit[s], s))
            if credit[owed] <= 0:
                owed = max(fitting, key=lambda s: (queues[s][bisect_right(queues[s], room, key=lambda x: x[0]) - 1][0], credit[s], s))
            q = queues[owed]
            n, key, parts = q.pop(bisect_right(q, room, key=lambda x: x[0]) - 1)
            out.append((key, parts, parts, box, capacity - room, n))
            room -= n
            credit[owed] -= n
            if not q:
                del queues[owed]
        box += 1
    return out


def sized_texts(documents: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """(doc_id, source, tokens), written once: three passes follow, and counting is the dear one. A null source is ''."""
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return settled(count_tokens(rows, ["doc_id", "source"], tokenizer=tokenizer, folder=folder), "sized")


def pack_texts(documents: DataFrame, capacity: int, tokenizer: str = "byte_bpe_50k", targets: dict[str, float] | None = None, folder: str | None = None) -> DataFrame:
    """doc_id, part, parts, container, start, tokens: where each text, or each part of a text above the capacity, lies.

    Texts are spread over shards by the hash of their id, so a source with a third of all texts is spread too; a shard is
    bounded by WINDOWS_PER_SHARD and TEXTS_PER_SHARD. The credit a shard starts with is what the shards before it leave:
    target share x tokens so far - tokens of the source so far, a running sum over one row per shard and source, known
    before anything is packed. So windows keep their proportions across partitions although all shards pack at once.
    Target proportions default to those of the corpus; sources outside `targets` have share 0 and fill what is left.
    Null and empty texts take no container (null). doc_id is unique in the input.
    """
    sized = sized_texts(documents, tokenizer, folder)
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    shards = max(1, -(-total["t"] // (capacity * WINDOWS_PER_SHARD)), -(-total["n"] // TEXTS_PER_SHARD))
    rows = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    part = rows.groupBy("shard", "source").agg(F.sum("tokens").alias("own"))
    if targets is None:
        whole = rows.groupBy("source").agg((F.sum("tokens") / F.lit(max(1, total["t"]))).alias("share"))
    else:
        scale = sum(targets.values()) or 1.0
        pairs = [(s, float(w) / scale) for s, w in targets.items()]
        whole = documents.sparkSession.createDataFrame(pairs, "source string, share double")
    by_shard = part.groupBy("shard").agg(F.sum("own").alias("all"))
    so_far = sum_before(by_shard, [], "shard", "all", "all_before").select("shard", "all_before")
    owed = sum_before(part, ["source"], "shard", "own", "own_before").join(so_far, "shard").join(whole, "source", "left")
    share = F.coalesce("share", F.lit(0.0))
    owed = owed.select("shard", "source", share.alias("share"), (share * F.col("all_before") - F.col("own_before")).alias("credit"))

    def pack(texts: pd.DataFrame) -> pd.DataFrame:
        shard = int(texts["shard"].iloc[0])
        first = texts.drop_duplicates("source")
        shares = dict(zip(first["source"], first["share"]))
        credit = dict(zip(first["source"], first["credit"]))
        done = pack_queues(zip(texts["doc_id"].tolist(), texts["source"].tolist(), texts["tokens"].tolist()), shares, capacity, credit)
        out = pd.DataFrame(done, columns=["doc_id", "part", "parts", "box", "start", "tokens"])
        name = [None if b is None or b != b else f"{shard}-{int(b)}" for b in out["box"]]
        return out.assign(container=name)[["doc_id", "part", "parts", "container", "start", "tokens"]]

    # a given number of partitions is kept by adaptive execution: rows of numbers are small in bytes and dear in Python
    joined = rows.join(owed, ["shard", "source"], "inner").repartition(shards, "shard")
    return joined.groupBy("shard").applyInPandas(pack, "doc_id bigint, part int, parts int, container string, start int, tokens int")


def packed(documents: DataFrame, limits: DataFrame, folder: str | None = None) -> DataFrame:
    """pack_texts with the capacity and tokenizer of the one row of `limits`."""
    row = limits.orderBy("container").first()
    return pack_texts(documents, int(row["capacity_tokens"]), row["tokenizer"], folder=folder)


def divided(packing: DataFrame) -> DataFrame:
    """(doc_id) of the texts that the packing had to divide: those with more tokens than a container holds."""
    return packing.where((F.col("parts") > 1) & (F.col("part") == 1)).select("doc_id")
