"""Running sums, maxima and minima without a window over a whole key: within ranges, then over the ranges' totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 100_000  # bases of a range


def base_range(at: Column, width: int = WIDTH) -> Column:
    return F.floor(at / width)


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """rows with _r, numbers of ranges that rise with the order: sorted apart by a sample, so that hot values don't matter."""
    from .graphs import cut

    return cut(rows.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()))


def running(rows: DataFrame, by: list[str], order: list[str], value: Column | dict[str, Column], f: Callable[[Column], Column], name: str = "", down: bool = False, before: bool = False) -> DataFrame:
    """Adds f of the values (F.sum, F.max or F.min) from the first row of each `by` on to each row, in the order of _r and then `order`.

    down: from the last row on. before: without the row itself. Several values, by name, go in one pass. A task holds one
    range of a key; the rows are read once and written with what their range gives, the ranges' totals, one row each,
    are ordered by key.
    """
    from .graphs import cut

    values = value if isinstance(value, dict) else {name: value}

    def turned(c: str) -> Column:
        return F.desc(c) if down else F.asc(c)

    inner = Window.partitionBy(*by, "_r").orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    outer = Window.partitionBy(*by).orderBy(turned("_r")).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumns({f"_value_{n}": v for n, v in values.items()})
    held = cut(held.withColumns({f"_here_{n}": f(F.col(f"_value_{n}")).over(inner) for n in values}))
    totals = held.groupBy(*by, "_r").agg(*(f(F.col(f"_value_{n}")).alias(f"_t_{n}") for n in values))
    totals = totals.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_r").alias("_q"), *(f(F.col(f"_t_{n}")).over(outer).alias(f"_b_{n}") for n in values))
    joined = {F.sum: lambda x, y: F.coalesce(x + y, x, y), F.max: F.greatest, F.min: F.least}[f]
    return held.join(small(totals), same(by)).select(*rows.columns, *(joined(F.col(f"_here_{n}"), F.col(f"_b_{n}")).alias(n) for n in values))


def same(by: list[str], left: str = "_r", right: str = "_q") -> Column:
    on = F.col(left) == F.col(right)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return on


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """The rows, broadcast if they are counted to be at most `most`."""
    from .graphs import cut

    held = cut(rows)
    return F.broadcast(held) if held.count() <= most else held


def shifted(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, hops: int) -> DataFrame:
    """Adds the value of the row `hops` after each one (before it, where negative), in the order of _r and then `order` in
    each `by`; null where there is none.

    A task holds one range of a key. Each range's first |hops| rows, its border, are numbered by key; only the rows that
    are as near to their range's end are joined with them.
    """
    from .graphs import cut

    if not hops:
        return rows.withColumn(name, value)
    n, turned = abs(hops), F.asc if hops > 0 else F.desc
    own = Window.partitionBy(*by, "_r")
    held = rows.withColumn("_value", F.struct(value.alias("v")))
    held = cut(held.withColumns({"_i": F.row_number().over(own.orderBy(*map(turned, order))), "_n": F.count("*").over(own), "_next": F.lead("_value", n).over(own.orderBy(*map(turned, order)))}))
    border = held.where(F.col("_i") <= n).select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_r").alias("_q"), "_i", F.col("_value").alias("_far"))
    border = cut(border.withColumn("_b", F.row_number().over(Window.partitionBy(*(f"_k_{k}" for k in by)).orderBy(turned("_q"), "_i"))))
    last = small(border.groupBy(*(f"_k_{k}" for k in by), "_q").agg(F.max("_b").alias("_last")))
    inside = held.where(F.col("_i") + n <= F.col("_n")).select(*rows.columns, F.col("_next.v").alias(name))
    edge = held.where(F.col("_i") + n > F.col("_n")).join(last, same(by)).withColumn("_want", F.col("_last") + F.col("_i") + n - F.col("_n")).select(*rows.columns, "_want")
    edge = edge.join(border.drop("_q", "_i"), same(by, "_want", "_b"), "left").select(*rows.columns, F.col("_far.v").alias(name))
    return inside.union(edge)
