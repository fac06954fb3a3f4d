"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, stored
from .graph import blocks, components, group_ends, star


class Tree:
    """Random splits at the median of a sample; what lies within `spill` of a split goes to both sides."""

    def __init__(self, sample: np.ndarray, scale: float, leaf: int, spill: float, rng: np.random.Generator, first: int):
        self.nodes: list[tuple | int] = []
        self.first, self.leaves = first, 0
        self.grow(sample, np.arange(len(sample)), scale, leaf, spill, rng)

    def grow(self, x: np.ndarray, at: np.ndarray, scale: float, leaf: int, spill: float, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(self.first + self.leaves)
        if len(at) * scale > leaf and len(at) >= 16:
            for _ in range(4):  # a split that spills nearly all is drawn anew
                way = rng.standard_normal(x.shape[1])
                way /= np.linalg.norm(way)
                p = x[at] @ way
                cut = float(np.median(p))
                left, right = at[p <= cut + spill], at[p >= cut - spill]
                if max(len(left), len(right)) <= 0.8 * len(at):
                    a = self.grow(x, left, scale, leaf, spill, rng)
                    b = self.grow(x, right, scale, leaf, spill, rng)
                    self.nodes[me] = (way, cut, spill, a, b)
                    return me
        self.leaves += 1
        return me

    def place(self, x: np.ndarray, out: list[list[int]]) -> None:
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            got = self.nodes[node]
            if isinstance(got, int):
                for i in at.tolist():
                    out[i].append(got)
                continue
            way, cut, spill, a, b = got
            p = x[at] @ way
            todo += [(a, at[p <= cut + spill]), (b, at[p >= cut - spill])]


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square overflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of the vectors, with the rows that have it."""
    length = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for dim in np.unique(length).tolist():
        yield dim, np.flatnonzero(length == dim)


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, trees: int = 8, leaf: int = 400, fit_rows: int = 20_000, spill: float = 0.5, limit: int = 2048, seed: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings(vec_id, embedding).

    Equal vectors are one point with a count, so copies cost nothing; they are linked with each other. The trees
    are fitted on at most `fit_rows` vectors, chosen by a hash, and every point is placed in them; they are as
    deep as the number of points asks for leaves of about `leaf`, while the sample reaches. The spill is in
    standard deviations of the projected distance of two vectors at the threshold. Points meet in leaves, larger
    leaves in pairs of chunks; a pair counts in the first leaf that it shares, so each link counts once without
    any pair being written. Vectors of each length have trees of their own; lengths that the sample misses are one leaf.
    Null, zero and non-finite vectors link with nothing. Columns of other names do no harm, and rows that repeat a
    vec_id count each. A row without vec_id is counted, but has no component of its own. No rows give no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    points = stored(rows.where("good").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")).withColumn("point", F.monotonically_increasing_id()), "points")
    n = points.count()
    sample = points.select("v").orderBy(F.xxhash64("v")).limit(fit_rows).toArrow() if n else None
    forest: dict[int, list[Tree]] = {}
    if n:
        given, rng, first = sample.column("v").combine_chunks(), np.random.default_rng(seed), 0
        for dim, own in by_length(given):
            x, forest[dim] = unit(matrix(given.take(pa.array(own)))), []
            margin = spill * np.sqrt(2 - 2 * cosine) / np.sqrt(dim)
            for _ in range(trees):
                forest[dim].append(Tree(x, n / len(given), leaf, margin, rng, first))
                first += forest[dim][-1].leaves

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for dim, own in by_length(batch.column("v")):
                x, found = unit(matrix(batch.column("v").take(pa.array(own)))), [[] for _ in own]
                for tree in forest.get(dim, ()):
                    tree.place(x, found)
                for i, leaves in zip(own.tolist(), found):
                    out[i] = leaves or [-dim]
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("many"), batch.column("v"), pa.array(map(sorted, out), pa.list_(pa.int32()))], names=["point", "many", "v", "leaves"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["leaf", "_i", "_j"], 4096):
            leaves, i, j, chunk, point, many = (table.column(c).to_numpy() for c in ("leaf", "_i", "_j", "_c", "point", "many"))
            ends, vectors = group_ends(leaves, i, j), table.column("v")
            lists = table.column("leaves").combine_chunks()
            at, got = 0, ([], [], [])
            while at < len(leaves):
                end = int(ends[at])
                x = unit(matrix(vectors.slice(at, end - at)))
                near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                if i[at] != j[at]:
                    near &= chunk[at:end, None] != chunk[None, at:end]
                own = np.flatnonzero(near.any(1))
                if len(own):
                    near = near[np.ix_(own, own)]
                    # pairs that an earlier leaf holds have been counted there
                    seen = [np.array(lists[at + int(k)].as_py()) for k in own]
                    seen = [s[s < leaves[at]] for s in seen]
                    names, where = np.unique(np.concatenate(seen), return_inverse=True)
                    inside = np.zeros((len(own), len(names)), np.float32)
                    inside[np.repeat(np.arange(len(own)), [len(s) for s in seen]), where] = 1
                    first = near & (inside @ inside.T == 0)
                    a, b = np.nonzero(near)
                    label = star(len(own), a, b)
                    got[0].append(point[at + own])
                    got[1].append(first @ many[at + own])
                    got[2].append(point[at + own[label]])
                at = end
            if got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in got], names=["a", "n", "b"])

    if n:
        placed = stored(points.mapInArrow(place, "point long, many long, v array<double>, leaves array<int>"), "placed")
        cells = placed.select("*", F.explode("leaves").alias("leaf"))
        met = stored(blocks(cells, "leaf", "point", limit, few=True).mapInArrow(compare, "a long, n long, b long"), "met")
        counts = met.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_links"))
        found = components(met, "a", "b")
        of = points.join(counts, F.col("point") == F.col("_a"), "left").join(found, F.col("point") == F.col("node"), "left")
        of = of.select("v", "rep", (F.coalesce("_links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "point").alias("_c"))
        least = of.groupBy(F.col("_c").alias("_l")).agg(F.min("rep").alias("component"))
        of = of.join(least, F.col("_c") == F.col("_l")).select(F.col("v").alias("_v"), "n_links", "component")
        out = rows.where("good").join(of, F.col("v") == F.col("_v")).select("vec_id", "n_links", F.col("component").alias("component_id"))
        out = out.union(rows.where("NOT good").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    else:
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
