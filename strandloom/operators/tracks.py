"""Tracks: pileups in bins, over samples and by genotype."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .samples import basis, table_of


def binned(depths: DataFrame, chrom: str, start: int, end: int, size: int) -> DataFrame:
    """Mean depth per bin of an interval, by sample and strand, over the bin's bases from the first change on.

    Stretches of equal depth are cut at the bins' edges, so no row per base is made.
    """
    w = Window.partitionBy("sample_id", "strand").orderBy("pos")
    s = depths.where(F.col("chrom") == chrom).withColumn("_e", F.lead("pos").over(w)).where((F.col("_e") > start) & (F.col("pos") < end))
    first = F.floor((F.greatest("pos", F.lit(start)) - start) / size)
    last = F.floor((F.least("_e", F.lit(end)) - 1 - start) / size)
    cut = s.withColumn("bin", F.explode(F.sequence(first, last)))
    low = F.lit(start) + F.col("bin") * size
    cut = cut.withColumn("_n", F.least("_e", low + size) - F.greatest("pos", low))
    return cut.groupBy("sample_id", "strand", "bin").agg((F.sum(F.col("depth") * F.col("_n")) / F.sum("_n")).alias("depth"))


def normalised(track: DataFrame, factors: DataFrame) -> DataFrame:
    """Depths divided by their samples' factors."""
    return track.join(factors, "sample_id").withColumn("depth", F.col("depth") / F.col("factor")).drop("factor")


def residualised(track: DataFrame, covariates: DataFrame, by: list[str]) -> DataFrame:
    """(by, sample_id, depth): depths less what the centred covariates explain across the samples; a position's mean stays.

    covariates has sample_id and a column per covariate, none null. Its samples are the samples: one without a row at a
    position has depth 0 there, rows of others are left out, and a sample twice at a position is an error. Covariates
    that depend on others count once. A position's sums with an orthonormal basis are combined before its one shuffle;
    the basis, a row per sample, is all that reaches the driver and goes to all tasks.
    """
    names = sorted(r[0] for r in covariates.select("sample_id").where("sample_id IS NOT NULL").distinct().collect())
    values = table_of(covariates, names)
    if values.size and values.dtype == float and (values != values).any():
        raise ValueError("a covariate is null")
    q = basis(values).tolist()
    axes = range(len(q[0]) if q else 0)
    spark = track.sparkSession
    rows = spark.createDataFrame([(n, v) for n, v in zip(names, q)], "sample_id string, _q array<double>")
    own = track.join(F.broadcast(rows), "sample_id")
    sums = [F.sum(F.col("depth") * F.col("_q")[k]).alias(f"_s{k}") for k in axes]
    packed = own.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("sample_id", F.col("depth").cast("double")))).alias("_d"), *sums)
    every = spark.createDataFrame([(list(zip(names, q)),)], "_all array<struct<sample_id string, q array<double>>>")
    each = packed.crossJoin(F.broadcast(every)).withColumn("_x", F.explode("_all"))  # one row
    less = sum((F.col(f"_s{k}") * F.col("_x.q")[k] for k in axes), F.lit(0.0))
    return each.select(*by, "_x.sample_id", (F.coalesce(F.try_element_at("_d", F.col("_x.sample_id")), F.lit(0.0)) - less).alias("depth"))


def staged(track: DataFrame, mode: str, factors: DataFrame, covariates: DataFrame, by: list[str]) -> DataFrame:
    """The track as it is (raw), divided by its samples' factors (norm), or residualised after that (res)."""
    if mode not in ("raw", "norm", "res"):
        raise ValueError(f"not a mode: {mode!r}")
    if mode == "raw":
        return track.select(*by, "sample_id", F.col("depth").cast("double").alias("depth"))
    own = normalised(track, factors).select(*by, "sample_id", "depth")
    return own if mode == "norm" else residualised(own, covariates, by)


def summary(track: DataFrame, by: list[str]) -> DataFrame:
    """Mean and relative deviation over samples."""
    return track.groupBy(*by).agg(F.avg("depth").alias("mean"), (F.stddev_samp("depth") / F.avg("depth")).alias("norm_variance"))


def by_genotype(track: DataFrame, genotypes: DataFrame, by: list[str]) -> DataFrame:
    """Mean depth of the samples of each dosage of one variant."""
    own = genotypes.where(F.col("dosage").isNotNull()).select("sample_id", "dosage")
    return track.join(own, "sample_id").groupBy("dosage", *by).agg(F.avg("depth").alias("depth"))


def coarser(track: DataFrame, by: list[str], start: int, end: int, bins: int) -> DataFrame:
    """(by, pos, depth): means over `bins` bins of positions, closed at the right, named by their rounded middles."""
    width = (end - start) / bins
    at = F.greatest(F.ceil((F.col("pos") - start) / width) - 1, F.lit(0))
    own = track.where(F.col("pos").between(start, end)).withColumn("pos", F.round(F.lit(start) + (at + 0.5) * width).cast("long"))
    return own.groupBy(*by, "pos").agg(F.avg("depth").alias("depth"))


def centred(track: DataFrame, zero: int) -> DataFrame:
    """Positions from an anchor on."""
    return track.withColumn("pos", F.col("pos") - zero)


def scaled(track: DataFrame, factor: float) -> DataFrame:
    return track.withColumn("depth", F.col("depth") * factor)


def explained(track: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, signed_r2): along a track, the correlation of the samples' depths with values(sample_id, value), and its
    square with the sign of the slope. Null where either is constant."""
    both = track.join(values.select("sample_id", F.col("value").cast("double").alias("value")), "sample_id")
    n = both.groupBy(*by).agg(F.covar_pop("depth", "value").alias("xy"), F.var_pop("depth").alias("xx"), F.var_pop("value").alias("yy"))
    r = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return n.select(*by, r.alias("r"), (r * F.abs(r)).alias("signed_r2"))
