"""Shards of equal bytes by Karmarkar-Karp differencing over indivisible groups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored


def difference(parts: np.ndarray) -> np.ndarray:
    """For n partial partitions into k sums (n, k): the final label of each sum (n, k).

    The two partitions of largest spread are combined again and again, the largest sums of one with the
    smallest of the other.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = np.take_along_axis(parts, order, 1).astype(object if parts.max(initial=0) > 2**53 else np.float64)
    tree: list[tuple] = [(i, order[i]) for i in range(n)]
    heap = [(-(sums[i][0] - sums[i][-1]), i, sums[i] - sums[i][-1], i) for i in range(n)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = a + b[::-1]
        by = np.argsort(-both, kind="stable")
        both = both[by] - both[by[-1]]
        tree.append((x, y, by))
        heapq.heappush(heap, (-both[0], len(tree), both, len(tree) - 1))
    out = np.zeros((n, k), np.int64)
    todo = [(heap[0][3], np.arange(k))] if n else []
    while todo:
        node, label = todo.pop()  # label: of each sum in falling order
        if len(tree[node]) == 2:
            i, by = tree[node]
            out[i, by] = label
        else:
            x, y, by = tree[node]
            own = np.empty(k, np.int64)
            own[by] = label
            todo += [(x, own), (y, own[::-1])]
    return out


def assign(groups: DataFrame, key: str, size: str, shards: int, chunk: int = 4096, fan: int = 256) -> DataFrame:
    """(key, shard): groups dealt into shards of nearly equal size.

    Chunks of about `chunk` groups (by a hash of the key) are differenced in tasks; the partial partitions that
    come out, of `shards` sums each, are differenced `fan` at a time until one is left. No task sees more.
    """
    n = groups.count()
    chunks = max(1, -(-n // chunk))
    dealt = groups.select(F.col(key).alias("k"), F.col(size).cast("long").alias("size"), F.pmod(F.xxhash64(key), F.lit(chunks)).alias("part"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "k"], ascending=False)
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["size"]
        return pd.DataFrame({"k": pdf["k"], "size": pdf["size"], "part": pdf["part"], "label": difference(parts)[:, 0]})

    def later(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="part", columns="label", values="size", aggfunc="sum", fill_value=0).reindex(columns=range(shards), fill_value=0)
        to = difference(wide.to_numpy(np.int64))
        return pd.DataFrame({"p": np.repeat(wide.index.to_numpy(), shards), "l": np.tile(np.arange(shards), len(wide)), "label": to.ravel()})

    out = stored(dealt.groupBy("part").applyInPandas(first, f"k {dict(groups.dtypes)[key]}, size long, part long, label long"), "parts")
    while chunks > 1:
        sums = out.groupBy("part", "label").agg(F.sum("size").alias("size")).withColumn("up", F.floor(F.col("part") / fan))
        moved = sums.groupBy("up").applyInPandas(later, "p long, l long, label long").select("p", "l", F.col("label").alias("to"))
        out = out.join(moved, (F.col("part") == F.col("p")) & (F.col("label") == F.col("l"))).select("k", "size", F.floor(F.col("part") / fan).alias("part"), F.col("to").alias("label"))
        chunks = -(-chunks // fan)
        out = stored(out, "parts")
    return out.select(F.col("k").alias(key), F.col("label").cast("int").alias("shard"))


def shard(documents: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; equal texts share a shard, bytes are nearly equal.

    size is the text's UTF-8 bytes plus 1. A null text counts as empty. Groups are summed before they are dealt;
    one larger than a shard's share fills its own. Slots are gapless from 0 in each shard, without order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("text_sha"))
    rows = stored(rows, "sizes")
    groups = rows.groupBy("text_sha").agg(F.sum("size").alias("bytes"))
    to = assign(groups, "text_sha", "bytes", shards).withColumnRenamed("text_sha", "_k")
    dealt = stored(rows.join(to, F.col("text_sha") == F.col("_k")).select("doc_id", "size", "text_crc32", "shard"), "shards")
    return ranked(dealt, ["shard"], ["doc_id", "text_crc32"], "slot", dealt.count())
