"""Near copies by the Jaccard similarity of word shingles: SimHash links and MinHash bands propose, the whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_of_each, per_batch, runs, stored
from .graph import components, group_ends, star
from .simhash import links, voted

BANDS, ROWS = 25, 4
_RNG = np.random.default_rng(20)
XOR, MUL = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
MUL |= np.uint64(1)
MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of words; a shorter text is one run, a wordless one has none."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(line[s:e], 42) for s, e in zip(starts, stops)), np.uint64, n))


def cells(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit cell a band; two sets of similarity s share a given one with probability s ** ROWS."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for lo in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[lo : lo + 512, None] ^ XOR) * MUL).min(0), out=least)
    return (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64).view(np.int64)


def key(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def sketches(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, key, size, fp, cells): key is a hash of the whole set, so texts of equal sets are one point; fp is the set's SimHash."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "key": [key(s) for s in sets], "size": [len(s) for s in sets], "fp": np.array([voted(s) for s in sets], np.uint64).view(np.int64), "cells": [cells(s) for s in sets]}

    return per_batch(documents, run, "doc_id long, h long, key long, size long, fp long, cells array<long>")


def whole_sets(documents: DataFrame, words: int) -> DataFrame:
    """(key, shingles binary)."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
        return {"key": [key(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    return per_batch(documents, run, "key long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    small, large = sorted((len(x), len(y)))
    if small < least * large - 1e-6:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, small + large - both) >= least


def checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            near = [similar(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), least) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    rows = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def close(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs of sets are similar, as a matrix; the shared items are counted by matrix products."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[item] > 1
    owner, item = owner[shared], place[item[shared]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(item[-1]) + 1 if len(item) else 0, 4096):
        s, e = np.searchsorted(item, [lo, lo + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[s:e], item[s:e] - lo] = 1
        both += held @ held.T
    return both.astype(np.float64) / np.maximum(1, n[:, None] + n - both.astype(np.float64)) >= least


def across(members: DataFrame, rows: int, items: int) -> DataFrame:
    """Blocks, as graph.blocks() makes them, in which the members of different components of each cell meet.

    members: (cell, key, of, size). A cell of up to `rows` members and `items` shingles is one block. Of a larger
    one the largest component has chunks of its own, which meet those of the rest but not each other, so rows grow
    with its members times the chunks of the rest. Cells of one component are left out.
    """
    parts = members.groupBy("cell", "of").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sums = parts.groupBy("cell").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "of", "s")).alias("m")).where("parts > 1")
    chunks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / rows), F.ceil(s / items)).cast("int")
    large = (F.col("n") > rows) | (F.col("s") > items)
    sizes = sums.select(
        "cell",
        F.when(large, F.col("m.of")).alias("_main"),
        F.when(large, chunks(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s"))).otherwise(1).alias("_rest"),
        F.when(large, chunks(F.col("m.n"), F.col("m.s"))).otherwise(0).alias("_more"),
    )
    main, hashed = F.col("of").eqNullSafe(F.col("_main")), F.xxhash64("key")
    return (
        members.join(sizes, "cell")
        .withColumn("_c", F.when(main, F.col("_rest") + F.pmod(hashed, F.greatest("_more", F.lit(1)))).otherwise(F.pmod(hashed, F.col("_rest"))).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.when(main, F.col("_rest")).otherwise(F.col("_rest") + F.col("_more")) - 1)))
        .select("cell", "key", "of", "_c", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"))
    )


def compared(members: DataFrame, sets: DataFrame, least: float, rows: int, items: int) -> DataFrame:
    """(a, b): per block of a cell the components that a spanning forest of its similar pairs joins.

    members: (cell, key, of, size); a block holds about 2 * rows members and 2 * items shingles at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cell", "_i", "_j"], rows):
            of, chunk, i, j = (table.column(c).to_numpy() for c in ("of", "_c", "_i", "_j"))
            ends = group_ends(table.column("cell").to_numpy(), i, j)
            lo = 0
            while lo < len(of):
                hi = int(ends[lo])
                sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles").slice(lo, hi - lo)]
                near = close(sets, least) & (of[lo:hi, None] != of[lo:hi])
                if i[lo] != j[lo]:
                    near &= chunk[lo:hi, None] != chunk[lo:hi]
                a, b = np.nonzero(np.triu(near, 1))
                if len(a):
                    label = star(hi - lo, a, b)
                    own = label != np.arange(hi - lo)
                    yield pa.RecordBatch.from_pydict({"a": of[lo:hi][own], "b": of[lo:hi][label[own]]})
                lo = hi

    held = across(members, rows, items).join(sets, "key").repartition("cell", "_i", "_j").sortWithinPartitions("cell", "_i", "_j")
    return held.mapInArrow(run, "a long, b long").distinct()


def groups(documents: DataFrame, words: int = 5, least: float = 0.8, distance: int = 4, rows: int = 512, items: int = 500_000) -> DataFrame:
    """(doc_id, h, of, component_id), h the xxhash64 of the text, of a name of the component: the smallest doc_id that each document reaches over pairs of similarity `least` or more.

    Words are runs other than ASCII white space, A-Z lower-cased; wordless texts are equal. The links of the
    sets' SimHash fingerprints at `distance` or fewer bits and 25 bands of minima propose; the bands alone miss
    a pair of similarity 0.8 with probability 2e-6, above it less. The whole sets decide every pair; rows
    without doc_id are left out, repeated rows repeat, no rows give no rows. First come the links and each
    member of a cell against the cell's smallest, which joins most groups at a cost in proportion to the
    members; then, in the cells that still hold different components, each pair across them, by blocks of at
    most about 2 * rows texts and 2 * items shingles.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).where("doc_id IS NOT NULL")
    sketched = stored(sketches(docs, words), "sketches")
    points = stored(sketched.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("cells").alias("cells")), "points")
    prints = points.groupBy("fp").agg(F.min("key").alias("rep"))
    equal = points.join(prints.toDF("fp", "b"), "fp").where("key != b").select(F.col("key").alias("a"), "b")
    members = points.select("key", F.explode("cells").alias("cell"))
    heads = members.groupBy("cell").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(members.join(heads, "cell").select("cell", "key", "head"), "cells")
    met = shared.where("key != head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    pairs = met.union(links(prints, distance)).union(equal).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = stored(pairs.distinct(), "pairs")
    named = shared.select("key").union(pairs.select("a")).union(pairs.select("b")).distinct()
    reps = points.join(named, "key").select(F.col("rep").alias("_rep")).distinct()
    sets = stored(whole_sets(docs.join(reps, F.col("doc_id") == F.col("_rep"), "left_semi"), words).dropDuplicates(["key"]), "sets")
    found = components(checked(pairs, sets, least), "a", "b")
    of = points.join(found, F.col("key") == F.col("node"), "left").select("key", "rep", "size", F.coalesce("component", "key").alias("one"))
    of = stored(of, "placed")
    placed = shared.select("cell", "key").join(of.select("key", F.col("one").alias("of"), "size"), "key")
    found = components(compared(placed, sets, least, rows, items), "a", "b")
    of = of.join(found, F.col("one") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "one").alias("of"))
    least_id = of.groupBy("of").agg(F.min("rep").alias("component_id"))
    return sketched.select("doc_id", "h", "key").join(of.select("key", "of"), "key").join(least_id, "of").select("doc_id", "h", "of", "component_id")


def first_of_each(documents: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group, the one of the smallest doc_id; rows without doc_id stay. Columns as given.

    Of rows that share that doc_id the one of the smallest text hash stays, of equal rows one.
    """
    heads = groups(documents, words, least).where("doc_id = component_id").groupBy("of").agg(F.min("doc_id").alias("doc_id"), F.min("h").alias("h"))
    return one_of_each(documents, heads)
