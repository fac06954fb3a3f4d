"""Counts and bases of overlaps from running sums along ranges of bases: no pair is made and nothing is written between."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .prefix import WIDTH


def totals(regions: DataFrame, features: DataFrame, key: str, kinds: int, width: int = WIDTH) -> DataFrame:
    """(key, _first, _n0, _n1, ..., bases) of regions that end after they start: how many features(chrom, start_pos, end_pos,
    _kind) of each kind overlap a region, and by how many bases in all. Features may have no length, kinds are numbers from 0.

    A region has a row for each range of bases that it touches, to be added up; _first is 1 in the one where it starts.
    Regions and features go once to each range that they touch. A task sees a range's features first and counts those
    that start and end at each base; each region then reads running sums at two places. A hot range takes no more memory
    than another one.
    """

    def in_ranges(rows: DataFrame, id: Column, kind: Column) -> DataFrame:
        s, e = F.col("start_pos").cast("long"), F.col("end_pos").cast("long")
        last = F.floor(F.greatest(e - 1, s) / width)
        good = rows.where("chrom IS NOT NULL AND start_pos <= end_pos").select("chrom", s.alias("_s"), e.alias("_e"), id.alias(key), kind.alias("_kind"), F.explode(F.sequence(F.floor(s / width), last)).alias("_r"))
        return good.select("chrom", "_r", (F.col("_s") - F.col("_r") * width).alias("_s"), (F.col("_e") - F.col("_r") * width).alias("_e"), "_kind", key)

    own = in_ranges(regions, F.col(key), F.lit(-1))
    other = in_ranges(features.where("_kind IS NOT NULL"), F.lit(None).cast(regions.schema[key].dataType), F.col("_kind").cast("int"))
    both = own.union(other).repartition("chrom", "_r").sortWithinPartitions("chrom", "_r", F.desc("_kind"))
    schema = StructType([StructField(key, regions.schema[key].dataType), *(StructField(n, LongType()) for n in ("_first", *(f"_n{i}" for i in range(kinds)), "bases"))])
    arrow = to_arrow_schema(schema)

    def passed_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = starts = ends = covered = None
        for batch in batches:
            names, r = batch["chrom"].dictionary_encode(), batch["_r"].to_numpy()
            code = names.indices.to_numpy()
            kind, s, e = (batch[c].to_numpy() for c in ("_kind", "_s", "_e"))
            turns = np.flatnonzero((np.diff(code) != 0) | (np.diff(r) != 0) | (np.diff(kind < 0) != 0)) + 1
            for i, j in zip([0, *turns], [*turns, len(r)]):
                place = names.dictionary[int(code[i])].as_py(), int(r[i])
                if at != place:  # index 0 holds what starts before the range, base b is at b + 1
                    at, covered = place, None
                    starts, ends = (np.zeros(kinds * (width + 2), np.int64) for _ in range(2))
                if kind[i] >= 0:
                    k, ending = kind[i:j].astype(np.int64) * (width + 2), e[i:j] <= width
                    np.add.at(starts, k + np.maximum(s[i:j], -1) + 1, 1)
                    np.add.at(ends, k[ending] + e[i:j][ending] + 1, 1)
                    continue
                if covered is None:
                    starts, ends = (np.cumsum(x.reshape(kinds, width + 2), axis=1) for x in (starts, ends))
                    covered = np.concatenate([[0], np.cumsum((starts - ends).sum(axis=0)[1 : width + 1])])
                here, low, high = s[i:j] >= 0, np.maximum(s[i:j], 0), np.minimum(e[i:j], width)
                counts = [a[high] - np.where(here, b[low + 1], a[0]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([batch[key].slice(i, j - i), pa.array(here.astype(np.int64)), *map(pa.array, counts), pa.array(covered[high] - covered[low])], schema=arrow)

    passed_along.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return both.mapInArrow(passed_along, schema)
