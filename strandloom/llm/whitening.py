"""Whitening of embeddings on the leading components of their covariance, found by contour integration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .feast import leading

SHIFT = 1_000_000  # x = floor(64 c) + SHIFT; sums are taken of x - SHIFT, which change nothing once centred
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def lattice(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): floor(64 c) of each entry of the vectors that hold no null or non-finite one. Entries from 2^34 on are an error."""
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.when(F.abs(v) < 2.0**34, F.floor(v * 64)).otherwise(F.raise_error(F.lit("an entry is too large for exact sums"))).cast("long"))
    return vectors.where(c.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their x) for each length of vector in a batch."""
    x = batch.column("x")
    flat, ends = x.flatten().to_numpy(), x.offsets.to_numpy()
    lengths, first = np.diff(ends), ends[:-1] - ends[0]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[first[rows][:, None] + np.arange(d)]


def summed(fit: DataFrame, d: int, f: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of f(matrix) over all vectors of length d. A task adds up its own; the tasks' sums are added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, m in matrices(batch):
                if m.shape[1] == d:
                    total = f(m) if total is None else total + f(m)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["i", "row"])

    parts = fit.where(F.size("x") == d).select("x").mapInArrow(run, f"i int, row array<{kind}>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # a cell per pair of places
    out = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1), np.int64 if kind == "long" else float)
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def whitened(vectors: DataFrame, components: int = 16) -> DataFrame:
    """A row per usable vector(vec_id, embedding) and component, with columns as in SCHEMA.

    The fit list holds each different x once, so repeated rows weigh as one and get the same values. Its size, sums,
    centred covariance and the covariance of the whitened values are each a pass; what reaches the driver is as wide
    and high as a vector is long, whatever the number of rows. Vectors of another length are fitted among themselves,
    one length after another. Vectors that are null, empty or hold null or non-finite entries give no rows; a null
    vec_id is kept. There are at most as many components as the covariance has rank, so a single different vector
    gives no rows; no vectors give none. deviation beyond a long is an error. Equal eigenvalues have components in
    an order of the fit's own, one for all rows.
    """
    rows = lattice(vectors)
    fit = stored(rows.select("x").distinct(), "lattice")
    fits: dict[int, tuple] = {}
    for d, n in sorted(tuple(r) for r in fit.where(F.size("x") > 0).groupBy(F.size("x")).agg(F.count("*")).collect()):
        total = summed(fit, d, lambda m: m.sum(0, keepdims=True), "long")[0]

        def centred(m: np.ndarray, n: int = n, total: np.ndarray = total) -> np.ndarray:
            return (m * n - total) / n

        v = summed(fit, d, lambda m: centred(m).T @ centred(m), "double") / n
        v = (v + v.T) / 2
        e, q = leading(v, components)
        if not len(e):
            continue
        scale = q / np.sqrt(e)
        # whitened values are centred as their vectors are: their mean is that of the vectors, zero, times scale
        w = summed(fit, d, lambda m: (centred(m) @ scale).T @ (centred(m) @ scale), "double") / n
        fits[d] = (n, total, scale, e / np.trace(v), float(np.abs(w - np.eye(len(e))).max()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for at, m in matrices(batch):
                if m.shape[1] not in fits:
                    continue
                n, total, scale, share, error = fits[m.shape[1]]
                far = m * n - total
                if float(np.abs(far).max(initial=0)) ** 2 * m.shape[1] >= 2.0**63:
                    raise OverflowError("a deviation does not fit into a long")
                k = len(share)
                columns = {
                    "vec_id": ids.take(pa.array(np.repeat(at, k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), "n": np.full(len(at) * k, n),
                    "deviation": np.repeat((far * far).sum(1), k), "whitened": ((far / n) @ scale).ravel(), "explained": np.tile(share, len(at)), "identity_error": np.full(len(at) * k, error),
                }
                yield pa.RecordBatch.from_pydict({k: pa.array(c) for k, c in columns.items()})

    return rows.mapInArrow(run, SCHEMA)
