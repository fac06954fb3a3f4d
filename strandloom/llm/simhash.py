"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, runs, stored
from .graph import blocks, components, group_ends, star

LOW = 0x5555555555555555


def voted(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes; 0 of none."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[lo : lo + 4096], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the shingles of a text, repeats included; 0 for a text without words."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = (np.append(0, ends[:-1] + 1)[:n]).tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return voted(np.fromiter((h(line[s:e], 42) for s, e in zip(starts, stops)), np.uint64, n))


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long): each whole text's fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    return per_batch(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def slabs(count: int) -> list[int]:
    """Masks of `count` slabs that together hold the 32 two-bit segments."""
    cuts = [round(i * 32 / count) for i in range(count + 1)]
    return [sum(3 << 2 * s for s in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(points: DataFrame, distance: int = 4, count: int = 6, limit: int = 2048) -> DataFrame:
    """(a, b): a spanning forest, per block, of the links between fingerprints at `distance` or fewer bits.

    points: (fp, rep), distinct fp. A fingerprint becomes the vector of the bit counts of its 32 two-bit
    segments. The Manhattan distance of two vectors never exceeds the Hamming distance. The grid is laid over
    slabs of segments: at distance d over `count` slabs, at least count - d slabs have distance 0, so two
    linked points share the cell of some choice of count - d slabs. In a cell the Manhattan distance of the
    slabs' totals bounds once more, and the bits decide. count - d grows the cells' resolution; more slabs
    suit more points.
    """
    masks = slabs(count)
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    packed = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))  # low + high in each segment
    keys = [F.xxhash64(F.lit(i), F.col("packed").bitwiseAND(F.lit(signed(sum(c))))) for i, c in enumerate(combinations(masks, count - distance))]
    cells = points.withColumn("packed", packed).select("fp", "rep", F.explode(F.array(*keys)).alias("cell"))
    unsigned = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cell", "_i", "_j"]):
            x = table.column("fp").to_numpy().view(np.uint64)
            rep, chunk, i, j = (table.column(c).to_numpy() for c in ("rep", "_c", "_i", "_j"))
            end = group_ends(table.column("cell").to_numpy(), i, j)
            totals = np.bitwise_count(x[:, None] & unsigned).astype(np.int8)
            a, b = [], []
            at, lag, n = np.arange(len(x)), 0, 0
            while True:
                lag += 1
                at = at[at + lag < end[at]]
                if not len(at):
                    break
                to = at + lag
                near = np.abs(totals[at] - totals[to]).sum(1) <= distance
                p, q = at[near], to[near]
                near = (np.bitwise_count(x[p] ^ x[q]) <= distance) & ((i[p] == j[p]) | (chunk[p] != chunk[q]))
                a.append(p[near])
                b.append(q[near])
                n += len(a[-1])
                if n > 2_000_000:
                    label = star(len(x), np.concatenate(a), np.concatenate(b))
                    a, b = [np.flatnonzero(label != np.arange(len(x)))], [label[label != np.arange(len(x))]]
                    n = len(a[0])
            if n:
                label = star(len(x), np.concatenate(a), np.concatenate(b))
                own = label != np.arange(len(x))
                yield pa.RecordBatch.from_pydict({"a": rep[own], "b": rep[label[own]]})

    return blocks(cells, "cell", "fp", limit).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, words: int = 4, distance: int = 4, count: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents(doc_id, text).

    Words are runs other than ASCII white space, A-Z lower-cased. A null, empty or wordless text has fingerprint
    zero and is linked like any other. Equal fingerprints are joined before any comparison, so copies cost one
    point. component_id is the smallest doc_id that is reached; rows without doc_id keep their fingerprint, and
    have a component only through others. Repeated rows and other columns do no harm; no rows give no rows.
    """
    prints = stored(fingerprints(documents, words), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    found = components(links(points.where("rep IS NOT NULL"), distance, count), "a", "b")
    of = points.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_f"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, F.col("fp") == F.col("_f")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
