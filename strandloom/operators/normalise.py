"""Normalisation of counts: TMM factors, quantiles, normal scores, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_quantile
from .association import average_ranks


def tmm_factors(counts: DataFrame, trim_ratio: float = 0.3, trim_sum: float = 0.05) -> DataFrame:
    """(sample_id, factor): trimmed means of log ratios to a reference sample, divided by their geometric mean.

    Genes without any count go. The reference is the sample whose upper quartile of shares is nearest to the
    samples' mean quartile, ties to the smaller id; its counts are joined by gene, so no table meets itself.
    """
    live = counts.groupBy("gene_id").agg(F.max("n").alias("_m")).where("_m > 0").select("gene_id")
    y = counts.join(live, "gene_id").select("gene_id", "sample_id", F.col("n").cast("double").alias("y"))
    size = y.groupBy("sample_id").agg(F.sum("y").alias("s"), F.expr("percentile(y, 0.75)").alias("_q")).withColumn("q", F.col("_q") / F.col("s"))
    near = F.abs(F.col("q") - F.avg("q").over(Window.partitionBy()))
    ref = size.withColumn("_d", near).orderBy("_d", "sample_id").limit(1).select(F.col("sample_id").alias("_ref"))  # as many rows as samples
    y = y.join(size.select("sample_id", "s"), "sample_id").where("y > 0")
    base = y.join(F.broadcast(ref), F.col("sample_id") == F.col("_ref")).select("gene_id", F.col("y").alias("yr"), F.col("s").alias("sr"))
    both = y.join(base, "gene_id")
    a, b = F.col("y") / F.col("s"), F.col("yr") / F.col("sr")
    m = both.select(
        "sample_id", F.log2(a / b).alias("m"), (0.5 * F.log2(a * b)).alias("e"),
        ((F.col("s") - F.col("y")) / F.col("s") / F.col("y") + (F.col("sr") - F.col("yr")) / F.col("sr") / F.col("yr")).alias("v"),
    )
    m = average_ranks(average_ranks(m, "sample_id", "m").withColumnRenamed("rank", "rm").drop("u"), "sample_id", "e").withColumn("n", F.count("*").over(Window.partitionBy("sample_id")))
    low_m, low_e = F.floor(F.col("n") * trim_ratio) + 1, F.floor(F.col("n") * trim_sum) + 1
    kept = m.where(F.col("rm").between(low_m, F.col("n") + 1 - low_m) & F.col("rank").between(low_e, F.col("n") + 1 - low_e) & (F.col("v") > 0))
    logs = kept.groupBy("sample_id").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("l"))
    return logs.select("sample_id", F.pow(2.0, F.col("l") - F.avg("l").over(Window.partitionBy())).alias("factor"))


def normal_scores(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds score: the normal quantile of the average rank over n + 1."""
    return average_ranks(rows, key, value).withColumn("score", normal_quantile(F.col("u")))


def quantiles(rows: DataFrame, value: str, key: str = "gene_id") -> DataFrame:
    """Each sample's values replaced by the samples' mean at that rank; equal values get the median of their places.

    The rank within a sample is counted over distinct values, so a table of (rank, mean) is joined by range of
    places; the places of equal values are consecutive and their median lies at their middle.
    """
    w = Window.partitionBy("sample_id").orderBy(value, key)
    placed = rows.withColumn("_i", F.row_number().over(w))
    means = placed.groupBy("_i").agg(F.avg(value).alias("_mean"))
    ties = Window.partitionBy("sample_id", value)
    got = placed.join(means, "_i").withColumn("normal", F.median("_mean").over(ties))
    return got.select(key, "sample_id", "normal")


def clipped(rows: DataFrame, value: str) -> DataFrame:
    """inf takes the largest finite value; -inf the smallest finite one; where no value is below 0, 0 the smallest positive."""
    x = F.col(value)
    finite = F.abs(x) < float("inf")
    ends = rows.agg(F.max(F.when(finite, x)).alias("_hi"), F.min(F.when(finite, x)).alias("_lo"), F.min(F.when(finite & (x > 0), x)).alias("_pos"), F.min(x).alias("_least"))
    low = F.when(x == float("-inf"), F.col("_lo")).when((x == 0) & (F.col("_least") >= 0), F.col("_pos"))
    return rows.crossJoin(F.broadcast(ends)).withColumn(value, F.coalesce(F.when(x == float("inf"), F.col("_hi")), low, x)).drop("_hi", "_lo", "_pos", "_least")


def z_scores(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Adds z, by population deviation within `by`; null without spread."""
    w = Window.partitionBy(by)
    return rows.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))
