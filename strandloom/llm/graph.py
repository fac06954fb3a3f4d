"""Comparing within cells, and connected components, as Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def blocks(members: DataFrame, cell: str, item: str, limit: int, few: bool = False) -> DataFrame:
    """Split the members of each cell into blocks to be compared: adds _i, _j (the block) and _c (the member's chunk).

    A cell of up to `limit` members is one block. A larger one is dealt into chunks of about `limit`, and each
    pair of chunks is a block: every pair of members meets, no block holds more than two chunks. Cells of one
    member are left out. The sizes reach the members by a join that Spark may split where it is skewed; where
    the number of cells has a fixed bound (few), by broadcast.
    """
    sizes = members.groupBy(cell).agg(F.count("*").alias("_n")).where("_n > 1")
    k = F.ceil(F.col("_n") / limit).cast("int")
    return (
        members.join(F.broadcast(sizes) if few else sizes, cell)
        .withColumn("_k", k)
        .withColumn("_c", F.pmod(F.xxhash64(item), F.col("_k")).cast("int"))
        .withColumn("_o", F.explode(F.expr("sequence(0, _k - 1)")))
        .withColumn("_i", F.least("_c", "_o"))
        .withColumn("_j", F.greatest("_c", "_o"))
        .drop("_n", "_k", "_o")
        .repartition(cell, "_i", "_j")
        .sortWithinPartitions(cell, "_i", "_j")
    )


def group_ends(*keys: np.ndarray) -> np.ndarray:
    """For each row of sorted keys, the end of its run of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return np.append(starts, n)[np.searchsorted(starts, np.arange(n), side="right")]


def star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        m = np.minimum(label[a], label[b])
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while (label[label] != label).any():
            label = label[label]
        if (label == old).all():
            return label


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each end of a link the smallest node that it reaches.

    Alternates large-star and small-star steps until the links form stars: until no node that has a smaller
    neighbour has another one. Each step is aggregates and joins; the links go through the shared folder, so a
    lost executor costs one step. Nodes are longs.
    """
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if not least.agg(F.max(F.expr("m < u AND n > 1"))).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", "m")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", "m")).distinct()
        edges = stored(small, "links")
