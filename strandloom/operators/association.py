"""Association of variants and phenotypes, and counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_two_sided
from . import intervals
from .prefix import in_ranges, running
from .samples import by_mask, complete, packed
from .tiles import centred, everywhere, half_up, near, squares, summed


def tpm(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts per thousand bases, as millionths of their sum in a sample."""
    rate = counts.join(genes.select("gene_id", intervals.length().alias("bases")), "gene_id").withColumn("rpk", F.col("n") / (F.col("bases") / 1000.0))
    total = rate.groupBy("sample_id").agg((F.sum("rpk") / 1e6).alias("_t"))
    return rate.join(total, "sample_id").select("gene_id", "sample_id", (F.col("rpk") / F.col("_t")).alias("tpm"))


def cpm_factors(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sample_id").agg((F.sum("n") / 1e6).alias("factor"))


def expressed(counts: DataFrame, genes: DataFrame, share: float = 0.2, least: int = 6, tpm_least: float = 0.1) -> DataFrame:
    """(gene_id, kept): enough samples with enough counts and TPM."""
    both = counts.join(tpm(counts, genes), ["gene_id", "sample_id"])
    return both.groupBy("gene_id").agg(((F.avg((F.col("n") >= least).cast("int")) >= share) & (F.avg((F.col("tpm") >= tpm_least).cast("int")) >= share)).alias("kept"))


def imputed(genotypes: DataFrame) -> DataFrame:
    """Missing dosages become the mean of the variant's others."""
    return genotypes.withColumn("dosage", F.coalesce(F.col("dosage").cast("double"), F.avg("dosage").over(Window.partitionBy("variant_id"))))


def allele_stats(genotypes: DataFrame) -> DataFrame:
    """(variant_id, maf, ma_samples, ma_count) after imputation."""
    g = F.col("dosage")
    sums = imputed(genotypes).groupBy("variant_id").agg(
        (F.sum(g) / (2 * F.count("*"))).alias("af"), F.count("*").alias("n"), F.sum(g).alias("all"), F.count_if(g > 0.5).alias("up"), F.count_if(g < 1.5).alias("down"), F.sum(F.when(g > 0.5, g).otherwise(0.0)).alias("carried"), F.sum(F.when(g > 1.5, 0.0).otherwise(2.0 - g)).alias("lacked")
    )
    minor = F.col("af") <= 0.5
    return sums.select("variant_id", F.when(minor, F.col("af")).otherwise(1 - F.col("af")).alias("maf"), F.when(minor, F.col("up")).otherwise(F.col("down")).alias("ma_samples"), F.when(minor, F.col("carried")).otherwise(2 * F.col("n") - F.col("all")).alias("ma_count"))


def cis_pairs(variants: DataFrame, genes: DataFrame, window: int = 50_000, *more: str) -> DataFrame:
    """(phenotype_id, variant_id, tss_distance, more): variants within the window of a gene's start, both ends included, with further columns of the genes.

    A gene goes to the tiles of the window's width that its window touches, a variant to its own; positions go along, so
    a pair is not joined again.
    """
    size = max(1, window)
    g = genes.select(F.col("gene_id").alias("phenotype_id"), F.col("chrom").alias("_c"), F.col("start_pos").alias("_tss"), *more)
    g = g.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_tss") - window) / size), F.floor((F.col("_tss") + window) / size))))
    v = variants.select("variant_id", F.col("chrom").alias("_d"), "pos", F.floor(F.col("pos") / size).alias("_e"))
    near = (F.col("_c") == F.col("_d")) & (F.col("_b") == F.col("_e")) & (F.abs(F.col("pos") - F.col("_tss")) <= window)
    return g.join(v, near).select("phenotype_id", "variant_id", (F.col("pos") - F.col("_tss")).alias("tss_distance"), *more)


def constant(phenotypes: DataFrame) -> DataFrame:
    return phenotypes.groupBy("phenotype_id").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a = b").select("phenotype_id")


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nominal(genotypes: DataFrame, phenotypes: DataFrame, pairs: DataFrame, same: bool = False) -> DataFrame:
    """Each pair's r2, slope, its error and t statistic, over the samples that both tables have and the phenotype has values of.

    Rows are packed once, so a pair moves two arrays, not samples. A perfect fit has a null t, a slope of 0 a null error.
    With same, a sample that one table lacks is an error.
    """
    g, p, _ = packed(genotypes, phenotypes, same=same)
    both = complete(pairs.join(p, "phenotype_id").join(g, "variant_id"), "p", ["g"])
    s = both.select("phenotype_id", "variant_id", "tss_distance", dot("g", "p").alias("gp"), dot("g", "g").alias("gg"), dot("p", "p").alias("pp"), (F.size("g") - 2).alias("dof")).where("gg > 1e-20 AND dof > 0")
    s = s.withColumn("r2", F.col("gp") * F.col("gp") / (F.col("gg") * F.col("pp"))).withColumn("slope", F.col("gp") / F.col("gg"))
    s = s.withColumn("tstat", F.signum("gp") * F.sqrt(F.try_divide(F.col("dof") * F.col("r2"), 1 - F.col("r2"))))
    return s.select("phenotype_id", "variant_id", "tss_distance", "dof", "r2", "slope", F.try_divide("slope", "tstat").alias("slope_se"), "tstat")


def nominal_stats(x: np.ndarray, y: np.ndarray, pvalues: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """nominal()'s statistics of packed rows, matrices of phenotypes by variants, nan for null, and which of them are pairs."""
    shape = len(y), len(x)
    known = np.zeros(shape, bool)
    out = {k: np.full(shape, np.nan) for k in ("r2", "slope", "slope_se", "tstat", "strength", "pval_nominal")} | {"dof": np.zeros(shape, np.int32)}
    for rows, own in by_mask(y):
        dof = int(own.sum()) - 2
        if dof < 1:
            continue
        p, g = y[np.ix_(rows, own)], x if own.all() else centred(x[:, own])
        gp, gg, pp = summed(p, g), squares(g)[None, :], squares(p)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            r2, slope = gp * gp / (gg * pp), gp / gg
            t = np.sign(gp) * np.sqrt(np.where(1 - r2 == 0, np.nan, dof * r2 / (1 - r2)))
            found = {"r2": r2, "slope": slope, "slope_se": np.where(t == 0, np.nan, slope / t), "tstat": t, "strength": np.where(1 - r2 == 0, np.inf, np.round(np.abs(t), 9))}
        if pvalues:
            tested = np.isfinite(t)
            found["pval_nominal"] = np.full(t.shape, np.nan)
            found["pval_nominal"][tested] = t_two_sided(t[tested], np.full(int(tested.sum()), float(dof)))
        for k, values in found.items():
            out[k][rows] = values
        out["dof"][rows], known[rows] = dof, gg > 1e-20
    return out, known


def cis_nominal(genotypes: DataFrame, phenotypes: DataFrame, variants: DataFrame, genes: DataFrame, window: int = 50_000, names: Sequence[str] = ("dof", "r2", "slope", "slope_se", "tstat"), best: tuple[list[str], str, str] | None = None, digits: dict[str, int] | None = None) -> DataFrame:
    """nominal() of cis_pairs(), without a list of pairs: packed variants and phenotypes meet in tiles.

    names chooses among dof, r2, slope, slope_se, tstat, pval_nominal and strength (|t| to nine digits, infinite for a
    perfect fit). Columns of variants and genes beyond their id
    and place go with each pair; best is that of tiles.near. digits rounds statistics where they arise, once for equal
    rows; the slope in single precision.
    """
    g, p, _ = packed(genotypes, phenotypes)
    v = variants.join(g.withColumnRenamed("g", "x"), "variant_id")
    t = genes.withColumnsRenamed({"gene_id": "phenotype_id", "start_pos": "tss"}).join(p.withColumnRenamed("p", "y"), "phenotype_id")
    pvalues = "pval_nominal" in names

    def stats(x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        found, known = nominal_stats(x, y, pvalues)
        for k, d in (digits or {}).items():
            found[k] = half_up(found[k].astype(np.float32).astype(float) if k == "slope" else found[k], d)
        return found, known

    return near(v, t, window, stats, ", ".join(f"{k} {'int' if k == 'dof' else 'double'}" for k in names), best)


def strongest(found: DataFrame) -> DataFrame:
    """Each phenotype's pair of largest r2; ties to the smaller variant id."""
    w = Window.partitionBy("phenotype_id").orderBy(F.desc("r2"), "variant_id")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def benjamini_hochberg(pvals: DataFrame, key: str, p: str) -> DataFrame:
    """Step-up adjusted values: the ranks of equal values come from sums over distinct values, in ranges of them."""
    adjusted = stepped_up(pvals.select(p), p).select(F.col(p).alias("_p"), F.least("least", F.lit(1.0)).alias("adjusted"))
    return pvals.join(adjusted, F.col(p) == F.col("_p")).select(key, p, "adjusted")


def stepped_up(pvals: DataFrame, p: str) -> DataFrame:
    """(p, least): of each different value the least p * m / rank from it up; m is the number of rows."""
    by = in_ranges(pvals.groupBy(p).agg(F.count("*").alias("k")), p)
    ranks = running(by, [], [p], F.col("k"), F.sum, "r").crossJoin(F.broadcast(by.agg(F.sum("k").alias("m"))))
    return running(ranks, [], [p], F.col(p) * F.col("m") / F.col("r"), F.min, "least", down=True).select(p, "least")


def average_ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds rank, the average rank among a key's values, and u, that over n + 1: what the normal quantile is taken of."""
    w = Window.partitionBy(key)
    ties = rows.withColumn("_low", F.rank().over(w.orderBy(value))).withColumn("_k", F.count("*").over(Window.partitionBy(key, value))).withColumn("_n", F.count("*").over(w))
    return ties.withColumn("rank", F.col("_low") + (F.col("_k") - 1) / 2.0).withColumn("u", F.col("rank") / (F.col("_n") + 1)).drop("_low", "_k", "_n")


def sample_correlation(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(a, b, r): the correlation of each two samples over the rows, a before b.

    Each row's values are packed first, so the pairs of samples come from arrays, not from a join of the table with itself.
    """
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sample_id", F.col(value).cast("double").alias("x")))).alias("v"))
    left = packed.select("v", F.posexplode("v").alias("i", "a"))
    pairs = left.select(F.col("a"), F.explode(F.expr("slice(v, i + 2, size(v))")).alias("b"))
    return pairs.groupBy(F.col("a.sample_id").alias("a"), F.col("b.sample_id").alias("b")).agg(F.corr("a.x", "b.x").alias("r"))


def residualised(rows: DataFrame, samples: DataFrame, key: str, value: str, covariate: str) -> DataFrame:
    """Each row's values less what a centred covariate explains; the row's mean stays."""
    x = samples.select("sample_id", (F.col(covariate) - F.avg(covariate).over(Window.partitionBy())).alias("_c"))
    both = rows.join(x, "sample_id")
    slope = both.groupBy(key).agg((F.sum(F.col(value) * F.col("_c")) / F.sum(F.col("_c") * F.col("_c"))).alias("_s"))
    return both.join(slope, key).select(key, "sample_id", (F.col(value) - F.col("_s") * F.col("_c")).alias(value))


def group_t(rows: DataFrame, samples: DataFrame, key: str, value: str, group: str, first: str) -> DataFrame:
    """(key, t): pooled-variance t of the samples of group `first` against the others."""
    both = rows.join(samples.select("sample_id", (F.col(group) == first).alias("_g")), "sample_id")

    def of(f, g):
        return f(F.when(F.col("_g") == g, F.col(value)))

    s = both.groupBy(key).agg(*(of(f, g).alias(f"{n}{int(g)}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for g in (True, False)))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    return s.withColumn("_p", pooled).where("_p > 0").select(key, ((F.col("m1") - F.col("m0")) / F.sqrt(F.col("_p") * (1 / F.col("n1") + 1 / F.col("n0")))).alias("t"))


def trans_pairs(genotypes: DataFrame, phenotypes: DataFrame, variants: DataFrame, genes: DataFrame, least_r2: float, window: int = 5_000_000, block: int = 2000, chrom: bool = False) -> DataFrame:
    """Pairs of strong correlation, over the samples that both tables have and the phenotype has values of, that are not on
    one chromosome within the window.

    All packed variants meet all phenotypes in large parts, compared `block` by `block`; what passes carries its places.
    With chrom also that of the phenotype.
    """
    g, p, samples = packed(genotypes, phenotypes)
    g = g.withColumnRenamed("g", "x").join(variants.select("variant_id", F.col("chrom").alias("_vc"), "pos"), "variant_id")
    p = p.withColumnRenamed("p", "y").join(genes.select(F.col("gene_id").alias("phenotype_id"), F.col("chrom").alias("_gc"), F.col("start_pos").alias("tss")), "phenotype_id")

    def strong(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        found = []
        for rows, own in by_mask(b):
            x, y = (z - z.mean(1, keepdims=True) for z in (a[:, own], b[rows][:, own]))
            x, y = (z / np.where((k := np.linalg.norm(z, axis=1)) > 1e-10, k, np.inf)[:, None] for z in (x, y))
            r2 = (x @ y.T) ** 2
            i, j = np.nonzero(r2 >= least_r2)
            found.append((i, rows[j], r2[i, j]))
        i, j, r2 = (np.concatenate(c) for c in zip(*found))
        return i, j, {"r2": r2}

    found = everywhere(g, p, strong, "r2 double", (variants.count(), genes.count()), len(samples), block)
    near = (F.col("_vc") == F.col("_gc")) & (F.abs(F.col("pos") - F.col("tss")) <= window)
    return found.where(~near).select("variant_id", "phenotype_id", "r2", *([F.col("_gc").alias("chrom")] if chrom else []))
