"""Best-fit packing of documents into bins of fixed capacity under conflicts.

A bin never holds two pieces of one source, nor two of one duplicate cluster.  Texts
longer than the capacity are cut into full pieces, each a bin of its own, and a last
piece that is packed like a short text; every byte is packed once.  Pieces go in falling
length into bins kept in the order of their residual capacity; each bin carries bitmaps
of its sources and clusters, and the successor search walks up from the least residual
that holds the piece to the first bin without a conflict: the tightest compatible one.

Documents are dealt by a hash of the id to shards of about SHARD_ROWS, so a source or
cluster that holds a third of all rows is spread evenly; bins do not cross shards, which
costs at most one part-filled set of bins a shard.  A null source conflicts with
nothing.  Equal texts form a cluster unless a cluster column is named.  Null and empty
texts are packed as pieces of length 0.  The packed columns are written once with a row
number, which deals and orders rows of null or repeated ids, so that a lost task packs
them as before.  Repeated rows are packed each, in different bins, since they conflict.
"""
from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged, text_of

#: Bytes of a bin, documents of a shard.
CAPACITY = 8192
SHARD_ROWS = 2048
SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, bin_offset long"


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; pieces come in falling length, sources and clusters
    as small non-negative numbers, -1 for none."""
    by_residual: list[tuple[int, int]] = []
    seen_source: list[int] = []
    seen_cluster: list[int] = []
    bins, offsets = [], []
    for n, s, c in zip(lengths, sources, clusters):
        s_bit, c_bit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        at = bisect_left(by_residual, (n, -1))
        while at < len(by_residual):
            b = by_residual[at][1]
            if not (seen_source[b] & s_bit or seen_cluster[b] & c_bit):
                break
            at += 1
        if at < len(by_residual):
            left, b = by_residual.pop(at)
        else:
            left, b = capacity, len(seen_source)
            seen_source.append(0)
            seen_cluster.append(0)
        bins.append(b)
        offsets.append(capacity - left)
        seen_source[b] |= s_bit
        seen_cluster[b] |= c_bit
        insort(by_residual, (left - n, b))
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset: one row per piece."""
    n = F.octet_length(text_of()).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source"),
                       n.alias("n"), (F.xxhash64(text_of()) if cluster is None else F.xxhash64(cluster)).alias("cluster"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-rows.count() // shard_rows))
    again = rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again"))
    place = F.when(F.col("doc_id").isNull() | F.col("again").isNotNull(), F.xxhash64("row", F.lit(1))).otherwise(F.xxhash64("doc_id"))
    dealt = rows.join(again, "doc_id", "left").withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).drop("again")

    def run(key, t):
        # ids stay in Arrow: beside a null, pandas would make them floats
        t = t.sort_by([("n", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending"), ("row", "ascending")])
        source, cl = (pd.factorize(t.column(c).to_pandas())[0] for c in ("source", "cluster"))
        size = t.column("n").to_numpy()
        full = size // capacity
        full -= (full > 0) & (size % capacity == 0)
        last = size - full * capacity
        order = np.lexsort((np.arange(len(size)), -last))
        bins, offsets = best_fit(last[order].tolist(), source[order].tolist(), cl[order].tolist(), capacity)
        where, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        where[order], off[order] = bins, offsets
        # full pieces take the bins after the packed ones
        i = np.repeat(np.arange(len(size)), full)
        piece = np.arange(len(i)) - np.repeat(np.cumsum(full) - full, full)
        who = np.concatenate([i, np.arange(len(size))])
        base = max(bins, default=-1) + 1
        part = np.concatenate([piece, full])
        return pa.table({
            "doc_id": t.column("doc_id").take(pa.array(who)), "piece": part.astype(np.int32), "start": part * capacity,
            "length": np.concatenate([np.full(len(i), capacity), last]),
            "bin_id": (key[0].as_py() << 32) + np.concatenate([base + np.arange(len(i)), where]),
            "bin_offset": np.concatenate([np.zeros(len(i), np.int64), off])})

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)
