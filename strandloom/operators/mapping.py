"""Mapping of variants to phenotypes: p-values, covariates, interactions, permutations, q-values, numbers of tests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import beta_at, beta_cdf, t_pvalue, t_pvalue_once, t_two_sided
from .association import allele_stats, benjamini_hochberg, cis_nominal, dot, nominal, nominal_stats, stepped_up
from .samples import arrays, basis as spanned, by_mask, common, complete, of_samples, packed, table_of, varying
from .tiles import centred, classes, everywhere, near, squares, summed


def with_pvalues(found: DataFrame, covariates: int = 0) -> DataFrame:
    """Adds pval_nominal, the two-sided tail of tstat at dof less the number of covariates."""
    return found.withColumn("pval_nominal", t_pvalue_once("tstat", F.col("dof") - covariates))


def cis_full_nominal(genotypes: DataFrame, phenotypes: DataFrame, variants: DataFrame, genes: DataFrame, least_maf: float = 0.0, digits: dict[str, int] | None = None) -> DataFrame:
    """full_nominal() of the cis pairs, which meet in tiles; digits rounds as of cis_nominal()."""
    alleles = allele_stats(of_samples(genotypes, common(genotypes, phenotypes))).where(F.col("maf") >= least_maf)
    own = ["maf", "ma_samples", "ma_count"]
    alleles = alleles.withColumns({k: F.round(k, d) for k, d in (digits or {}).items() if k in own})
    names = ["dof", "r2", "slope", "slope_se", "tstat", "pval_nominal"]
    found = cis_nominal(genotypes, phenotypes, variants.select("variant_id", "chrom", "pos").join(alleles, "variant_id"), genes.select("gene_id", "chrom", "start_pos"), names=names, digits={k: d for k, d in (digits or {}).items() if k in names})
    return found.select("variant_id", "phenotype_id", "tss_distance", *names, *own)


def full_nominal(genotypes: DataFrame, phenotypes: DataFrame, pairs: DataFrame, least_maf: float = 0.0) -> DataFrame:
    """nominal() with p-values, and allele counts among the samples that both tables have; variants of a smaller minor allele frequency are not tested."""
    alleles = allele_stats(of_samples(genotypes, common(genotypes, phenotypes))).where(F.col("maf") >= least_maf)
    found = nominal(genotypes, phenotypes, pairs.join(alleles.select("variant_id"), "variant_id", "left_semi"))
    return with_pvalues(found).join(alleles, "variant_id")


def residualiser(samples: DataFrame, covariates: list[str]) -> np.ndarray:
    """Orthonormal columns that span the centred covariates, rows in sample order: as many rows as samples."""
    got = samples.select("sample_id", *(F.col(c).cast("double") for c in covariates)).orderBy("sample_id").toPandas()
    c = got[covariates].to_numpy(float)
    return np.linalg.qr(c - c.mean(0))[0]


def residualised(packed: DataFrame, name: str, basis: np.ndarray) -> DataFrame:
    """Packed vectors less what the covariates explain; the mean of a vector stays."""

    @F.pandas_udf("array<double>")
    def rest(v: pd.Series) -> pd.Series:
        if not len(v):
            return v
        m = np.stack(v.to_numpy())
        return pd.Series(list(m - (m - m.mean(1, keepdims=True)) @ basis @ basis.T))

    return packed.withColumn(name, rest(name))


def difference(genotypes: DataFrame, phenotypes: DataFrame, variants: DataFrame, genes: DataFrame, samples: DataFrame, group: str, first: str, window: int = 50_000) -> DataFrame:
    """Slopes of the cis pairs among the samples of `first` and among the others, and z and p of their difference.

    The packed values of both go to the tiles in one array, so no list of pairs is made or joined.
    """

    def of(own: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame, int]:
        ids = own.select("sample_id")
        g, p, held = packed(genotypes.join(ids, "sample_id", "left_semi"), phenotypes.join(ids, "sample_id", "left_semi"))
        return g.withColumnRenamed("g", f"_{suffix}"), p.withColumnRenamed("p", f"_{suffix}"), len(held)

    g1, p1, n = of(samples.where(F.col(group) == first), "a")
    g2, p2, _ = of(samples.where(F.col(group) != first), "b")
    v = variants.select("variant_id", "chrom", "pos").join(g1.join(g2, "variant_id").select("variant_id", F.concat("_a", "_b").alias("x")), "variant_id")
    t = genes.select(F.col("gene_id").alias("phenotype_id"), "chrom", F.col("start_pos").alias("tss")).join(p1.join(p2, "phenotype_id").select("phenotype_id", F.concat("_a", "_b").alias("y")), "phenotype_id")

    def stats(x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        (one, known), (two, also) = nominal_stats(x[:, :n], y[:, :n]), nominal_stats(x[:, n:], y[:, n:])
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (one["slope"] - two["slope"]) / (one["slope_se"] + two["slope_se"])
        p = np.array([erfc(abs(u) / sqrt(2)) for u in z.ravel().tolist()]).reshape(z.shape)
        return {"slope_a": one["slope"], "se_a": one["slope_se"], "slope_b": two["slope"], "se_b": two["slope_se"], "z": z, "pval": p}, known & also

    return near(v, t, window, stats, "slope_a double, se_a double, slope_b double, se_b double, z double, pval double").drop("tss_distance")


def best_in_group(found: DataFrame, groups: DataFrame, strength: Column | None = None) -> DataFrame:
    """For each group of phenotypes and variant, the phenotype of largest strength (none given: |t|); ties to the smaller phenotype id."""
    named = found.join(groups, "phenotype_id")
    w = Window.partitionBy("group_id", "variant_id").orderBy(F.desc(F.abs("tstat") if strength is None else strength), "phenotype_id")
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def interaction(genotypes: DataFrame, phenotypes: DataFrame, pairs: DataFrame, samples: DataFrame, term: str, covariates: int = 0) -> DataFrame:
    """Each pair's model phenotype ~ genotype + term + genotype x term: slopes, errors, t and p of the three.

    Samples are those that all three tables have, with a term, and of which the phenotype has values. Rows are packed
    once; a pair moves three arrays. The normal equations of three terms are solved by cofactors. Pairs whose terms
    depend on each other are left out.
    """
    i = samples.select("sample_id", F.col(term).cast("double").alias("_i")).where("_i IS NOT NULL")
    shared = common(genotypes, phenotypes, i)
    g = arrays(genotypes, "variant_id", "dosage", "g", shared, fill=True, centre=False)
    p = arrays(varying(of_samples(phenotypes, shared).drop("_at")), "phenotype_id", "value", "p", shared)
    one = arrays(i.withColumn("_k", F.lit(0)), "_k", "_i", "i", shared, centre=False).select("i")
    g = g.crossJoin(F.broadcast(one)).withColumn("x", F.zip_with("g", "i", lambda x, y: x * y))  # a number per sample goes to all
    both = complete(pairs.join(p, "phenotype_id").join(g, "variant_id"), "p", ["g", "i", "x"], raw=True)
    names = ["g", "i", "x"]
    sums = {f"{a}{b}": dot(a, b) for k, a in enumerate(names) for b in [*names[k:], "p"]} | {"pp": dot("p", "p")}
    s = both.select("phenotype_id", "variant_id", "tss_distance", (F.size("g") - 4 - covariates).alias("dof"), *(v.alias(k) for k, v in sums.items()))
    c = F.col
    inverse = {
        "gg": c("ii") * c("xx") - c("ix") ** 2, "gi": c("gx") * c("ix") - c("gi") * c("xx"), "gx": c("gi") * c("ix") - c("gx") * c("ii"),
        "ii": c("gg") * c("xx") - c("gx") ** 2, "ix": c("gi") * c("gx") - c("gg") * c("ix"), "xx": c("gg") * c("ii") - c("gi") ** 2,
    }
    s = s.withColumns({f"_{k}": v for k, v in inverse.items()})
    s = s.withColumn("_det", c("gg") * c("_gg") + c("gi") * c("_gi") + c("gx") * c("_gx")).where(c("_det") > 1e-9 * c("gg") * c("ii") * c("xx"))
    s = s.withColumns({
        "b_g": (c("_gg") * c("gp") + c("_gi") * c("ip") + c("_gx") * c("xp")) / c("_det"),
        "b_i": (c("_gi") * c("gp") + c("_ii") * c("ip") + c("_ix") * c("xp")) / c("_det"),
        "b_gi": (c("_gx") * c("gp") + c("_ix") * c("ip") + c("_xx") * c("xp")) / c("_det"),
    })
    s = s.withColumn("_rss", c("pp") - c("b_g") * c("gp") - c("b_i") * c("ip") - c("b_gi") * c("xp")).where("_rss > 0")
    s = s.withColumns({f"{n}_se": F.sqrt(c(d) / c("_det") * c("_rss") / c("dof")) for n, d in (("b_g", "_gg"), ("b_i", "_ii"), ("b_gi", "_xx"))})
    terms = ["g", "i", "gi"]
    s = s.withColumns({f"t_{t}": c(f"b_{t}") / c(f"b_{t}_se") for t in terms})
    s = s.withColumns({f"pval_{t}": t_pvalue(f"t_{t}", "dof") for t in terms})
    return s.select("phenotype_id", "variant_id", "tss_distance", "dof", *(f"{k}_{t}" for t in terms for k in ("b", "t", "pval")), *(f"b_{t}_se" for t in terms))


def interaction_stats(x: np.ndarray, y: np.ndarray, term: np.ndarray, covariates: int = 0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """interaction()'s statistics of packed rows, matrices of phenotypes by variants, and which of them are pairs."""
    shape = len(y), len(x)
    terms = ["g", "i", "gi"]
    names = [*(f"{k}_{t}" for t in terms for k in ("b", "t")), *(f"b_{t}_se" for t in terms), "strength"]
    out, known = {k: np.full(shape, np.nan) for k in names} | {"dof": np.zeros(shape, np.int32)}, np.zeros(shape, bool)
    for rows, own in by_mask(y):
        dof = int(own.sum()) - 4 - covariates
        if dof < 1:
            continue
        p, g, i, gi = y[np.ix_(rows, own)], centred(x[:, own]), centred(term[None, own]), centred(x[:, own] * term[own])
        gp, ip, xp, pp = summed(p, g), summed(p, i), summed(p, gi), squares(p)[:, None]
        gg, ii, xx, s_gi, s_ix, s_gx = squares(g), squares(i), squares(gi), summed(g, i)[:, 0], summed(gi, i)[:, 0], np.zeros(len(x))
        for a, b in zip(g.T, gi.T):
            s_gx += a * b
        i_gg, i_gi, i_gx = ii * xx - s_ix * s_ix, s_gx * s_ix - s_gi * xx, s_gi * s_ix - s_gx * ii
        i_ii, i_ix, i_xx = gg * xx - s_gx * s_gx, s_gi * s_gx - gg * s_ix, gg * ii - s_gi * s_gi
        det = gg * i_gg + s_gi * i_gi + s_gx * i_gx
        with np.errstate(divide="ignore", invalid="ignore"):
            slopes = [(i_gg * gp + i_gi * ip + i_gx * xp) / det, (i_gi * gp + i_ii * ip + i_ix * xp) / det, (i_gx * gp + i_ix * ip + i_xx * xp) / det]
            rss = pp - slopes[0] * gp - slopes[1] * ip - slopes[2] * xp
            for t, slope, d in zip(terms, slopes, (i_gg, i_ii, i_xx)):
                se = np.sqrt(d / det * rss / dof)
                out[f"b_{t}"][rows], out[f"b_{t}_se"][rows], out[f"t_{t}"][rows] = slope, se, slope / se
            out["dof"][rows], known[rows] = dof, (det > 1e-9 * gg * ii * xx) & (rss > 0)
    out["strength"] = np.round(np.abs(out["t_gi"]), 9)
    return out, known


def cis_interaction(genotypes: DataFrame, phenotypes: DataFrame, variants: DataFrame, genes: DataFrame, samples: DataFrame, term: str, window: int = 50_000, covariates: int = 0, best: tuple[list[str], str, str] | None = None) -> DataFrame:
    """interaction() of the cis pairs without its p-values and without a list of pairs: packed rows meet in tiles. best is
    that of tiles.near, of which strength is |t| of genotype x term to nine digits."""
    i = samples.select("sample_id", F.col(term).cast("double").alias("_i")).where("_i IS NOT NULL")
    shared = common(genotypes, phenotypes, i)
    g = arrays(genotypes, "variant_id", "dosage", "x", shared, fill=True, centre=False)
    p = arrays(varying(of_samples(phenotypes, shared).drop("_at")), "phenotype_id", "value", "y", shared)
    values = table_of(i, shared)[:, 0]  # a number per sample
    v = variants.select("variant_id", "chrom", "pos").join(g, "variant_id")
    t = genes.select(F.col("gene_id").alias("phenotype_id"), "chrom", F.col("start_pos").alias("tss")).join(p, "phenotype_id")
    names = [*(f"{k}_{t}" for t in ("g", "i", "gi") for k in ("b", "t")), *(f"b_{t}_se" for t in ("g", "i", "gi"))]
    found = near(v, t, window, lambda x, y: interaction_stats(x, y, values, covariates), "dof int, " + ", ".join(f"{k} double" for k in (*names, *(["strength"] if best else []))), best)
    return found.drop("strength")


def frequent(genotypes: DataFrame, phenotypes: DataFrame, samples: DataFrame, term: str, least_maf: float) -> DataFrame:
    """(variant_id) of variants that vary, and are frequent enough in both halves of the term, among the samples that all tables have."""
    from .results import interaction_maf

    own = samples.where(F.col(term).isNotNull())
    shared = common(genotypes, phenotypes, own)
    return interaction_maf(of_samples(genotypes, shared).drop("_at"), of_samples(own, shared).drop("_at"), term, least_maf)


def top_interaction(genotypes: DataFrame, phenotypes: DataFrame, variants: DataFrame, genes: DataFrame, samples: DataFrame, term: str, least_maf: float = 0.05, window: int = 50_000) -> DataFrame:
    """Each phenotype's pair of largest |t| of genotype x term, ties to the smaller variant id, and num_tests, how many were tested.

    Variants vary, and are frequent enough in both halves of the term, among the samples that all tables have. A task
    hands on one pair of a phenotype.
    """
    fit = frequent(genotypes, phenotypes, samples, term, least_maf)
    found = cis_interaction(genotypes, phenotypes, variants.join(fit, "variant_id", "left_semi"), genes, samples, term, window, best=(["phenotype_id"], "strength", "variant_id"))
    return found.withColumns({f"pval_{t}": t_pvalue(f"t_{t}", "dof") for t in ("g", "i", "gi")}).withColumnRenamed("n", "num_tests")


def derivative(x: float, order: int) -> float:
    """Digamma (0) or trigamma (1), by recurrence to 8 and the asymptotic series."""
    out = 0.0
    while x < 8:
        out += -1 / x if order == 0 else 1 / x**2
        x += 1
    y = 1 / x**2
    return out + (np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252)) if order == 0 else 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y / 42)))


def beta_fit(p: np.ndarray) -> tuple[float, float]:
    """Most likely shapes of a beta distribution, from its moments on by Newton steps."""
    p = np.clip(p, 1e-300, 1 - 1e-12)
    return beta_shapes(float(p.mean()), float(p.var(ddof=1)), float(np.log(p).mean()), float(np.log1p(-p).mean()))


def beta_shapes(m: float, v: float, la: float, lb: float) -> tuple[float, float]:
    """beta_fit() of the mean, the variance and the means of the logarithms of p and of 1 - p."""
    k = max(m * (1 - m) / max(v, 1e-300) - 1, 1e-3)
    a, b = m * k, (1 - m) * k
    for _ in range(50):
        ab, ta, tb, tab = derivative(a + b, 0), derivative(a, 1), derivative(b, 1), derivative(a + b, 1)
        ga, gb = la - derivative(a, 0) + ab, lb - derivative(b, 0) + ab
        det = (ta - tab) * (tb - tab) - tab * tab
        da, db = ((tb - tab) * ga + tab * gb) / det, (tab * ga + (ta - tab) * gb) / det
        step = 1.0
        while a + step * da <= 0 or b + step * db <= 0:
            step /= 2
        a, b = a + step * da, b + step * db
        if abs(da) < 1e-9 * a and abs(db) < 1e-9 * b:
            break
    return float(a), float(b)


def moments(z: np.ndarray, n: int, step: int = 12) -> np.ndarray:
    """Means of Chebyshev's polynomials 0 to n - 1 at z: those of products of two, of which one's degree is below `step`
    and the other's a multiple of it, give those of their sums and differences."""
    fine = np.empty((step + 1, len(z)))
    fine[0], fine[1] = 1.0, z
    for k in range(2, step + 1):
        np.multiply(fine[k - 1], 2 * z, out=fine[k])
        fine[k] -= fine[k - 2]
    coarse = np.empty((-(-n // step), len(z)))
    coarse[0], coarse[1:2] = 1.0, fine[step]
    for k in range(2, len(coarse)):
        np.multiply(coarse[k - 1], 2 * fine[step], out=coarse[k])
        coarse[k] -= coarse[k - 2]
    both = coarse @ fine[:step].T / len(z)
    out = np.empty((len(coarse), step))
    out[0] = both[0]
    for k in range(1, len(coarse)):
        out[k, 0] = both[k, 0]
        out[k, 1:] = 2 * both[k, 1:] - out[k - 1, :0:-1]
    return out.ravel()[:n]


def coefficients(n: int) -> np.ndarray:
    """What gives a polynomial's coefficients of its values at n of Chebyshev's points."""
    return np.polynomial.chebyshev.chebvander(points(n), n - 1).T / np.where(np.arange(n) == 0, n, n / 2)[:, None]


def points(n: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5) / n)


POINTS, WEIGHTS = points(64), coefficients(64)
#: Values at twice as many points of what is known at 64, and coefficients of its square.
FINER, SQUARES = np.polynomial.chebyshev.chebvander(points(128), 63) @ WEIGHTS, coefficients(128)


class Angles:
    """Largest r2 of permutations as angles arcsin(r), by what is needed of them: p is a smooth function of the angle,
    whatever dof, so 64 of its values give its mean over the permutations, and that of its square and logarithms."""

    def __init__(self, r2: np.ndarray):
        angle = np.arcsin(np.sqrt(r2))
        least, self.n = float(angle.min()), len(r2)
        middle, half = (angle.max() + least) / 2, max((angle.max() - least) / 2, 1e-12)
        self.at = middle + half * POINTS
        self.means = moments((angle - middle) / half, 128)
        self.smooth = half > 1e-6 and least > 1e-7  # else the logarithms of 1 - p are taken one by one
        self.logs = (float(np.log1p(-r2).mean() / 2), float(np.log(angle).mean())) if self.smooth else None
        self.r2 = r2


class Many:
    """Angles of several problems, whose distributions are evaluated at once."""

    def __init__(self, each: list[Angles]):
        self.each, self.at, self.means = each, np.stack([a.at for a in each]), np.stack([a.means for a in each])
        self.n = np.array([a.n for a in each])

    def p(self, dof: np.ndarray, which: np.ndarray) -> np.ndarray:
        return t_two_sided(np.sqrt(dof)[:, None] * np.tan(self.at[which]), dof[:, None])

    def spread(self, p: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and variances over the permutations of what has these values at the points."""
        m = (p @ WEIGHTS.T * self.means[which, :64]).sum(1)
        square = ((p @ FINER.T) ** 2 @ SQUARES.T * self.means[which]).sum(1)
        return m, (square - m * m) * self.n[which] / np.maximum(self.n[which] - 1, 1)

    def shape(self, dof: np.ndarray, which: np.ndarray) -> np.ndarray:
        m, v = self.spread(self.p(dof, which), which)
        return np.where(v > 0, m * (m * (1 - m) / np.where(v > 0, v, 1) - 1) - 1, 0.0)

    def dofs(self, start: np.ndarray) -> np.ndarray:
        """effective_dof() of each."""
        every = np.arange(len(self.each))
        out, lo, hi = start.astype(float), start / 8, start * 4.0
        at_lo, at_hi = self.shape(lo, every), self.shape(hi, every)
        live = np.flatnonzero(at_lo * at_hi <= 0)
        for _ in range(40):
            if not len(live):
                break
            a, b, fa, fb = lo[live], hi[live], at_lo[live], at_hi[live]
            mid = np.where(fb != fa, b - fb * (b - a) / np.where(fb != fa, fb - fa, 1), (a + b) / 2)
            here = self.shape(mid, live)
            done = (np.abs(here) < 1e-6) | (np.abs(b - a) < 1e-9 * np.abs(b))
            out[live[done]] = mid[done]
            turn = here * fb < 0  # the kept end counts half, so that both ends move
            lo[live], at_lo[live] = np.where(turn, b, a), np.where(turn, fb, fa / 2)
            hi[live], at_hi[live] = mid, here
            live = live[~done]
        out[live] = hi[live]
        return out

    def fits(self, dof: np.ndarray) -> list[tuple[float, float]]:
        """beta_fit() of each one's least p-values at its dof."""
        every = np.arange(len(self.each))
        p = self.p(dof, every)
        m, v = self.spread(p, every)
        out = []
        for k, a in enumerate(self.each):
            if not a.smooth or p[k].min() < 1e-250:
                out.append(beta_fit(t_two_sided(np.sqrt(dof[k] * a.r2 / (1 - a.r2)), dof[k])))
                continue
            # less their singular parts the logarithms are smooth up to both ends
            low = dof[k] * a.logs[0] + float(WEIGHTS @ (np.log(p[k]) - dof[k] * np.log(np.cos(a.at))) @ a.means[:64])
            high = a.logs[1] + float(WEIGHTS @ (np.log1p(-p[k]) - np.log(a.at)) @ a.means[:64])
            out.append(beta_shapes(float(m[k]), float(v[k]), low, high))
        return out


def effective_dof(r2: np.ndarray, start: float) -> float:
    """The degrees of freedom at which the permutations' least p-values have first shape 1, between an eighth and four times the start; the start if none is."""
    return float(Many([Angles(r2)]).dofs(np.array([start]))[0])


TOP = "phenotype_id string, num_var int, beta_shape1 double, beta_shape2 double, true_df double, pval_true_df double, variant_id string, tss_distance long, pval_nominal double, slope double, slope_se double, pval_perm double, pval_beta double"


def unit(m: np.ndarray) -> np.ndarray:
    m = m - m.mean(-1, keepdims=True)
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def permuted(genotypes: DataFrame, phenotypes: DataFrame, pairs: DataFrame, permutations: int = 10_000, seed: int = 1, block: int = 1000, share: int = 50) -> DataFrame:
    """Each phenotype's strongest variant with empirical and beta-approximated p-values.

    A task has about `share` phenotypes and holds one's cis variants and `block` permutations at a time; the
    permutations follow from the seed, so a lost task gives the same result again. Samples are those that both tables have
    and of which the phenotype has values. Constant variants and phenotypes are left out.
    """
    g, p, _ = packed(genotypes, phenotypes)
    cis = pairs.join(g, "variant_id")

    def of(key: tuple, own: pd.DataFrame, cases: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in TOP.split(", ")]
        if not len(own) or not len(cases):
            return pd.DataFrame(columns=columns)
        own = own.sort_values(["tss_distance", "variant_id"], ignore_index=True)
        raw, y = np.stack(own["g"]), np.array(cases["p"].iloc[0], float)
        raw, y = raw[:, ~np.isnan(y)], y[~np.isnan(y)]
        if len(y) < 3:
            return pd.DataFrame(columns=columns)
        live = np.flatnonzero(np.ptp(raw, axis=1) > 0)
        if not len(live):
            return pd.DataFrame(columns=columns)
        x, n = unit(raw[live]), len(y)
        r = x @ unit(y)
        top, dof = int(np.argmax(r * r)), n - 2
        rng = np.random.default_rng(seed)
        best = np.concatenate([((x @ unit(rng.permuted(np.tile(y, (min(block, permutations - at), 1)), axis=1)).T) ** 2).max(0) for at in range(0, permutations, block)])
        best = np.minimum(best, 1 - 1e-12)
        r2 = min(float(r[top] ** 2), 1 - 1e-12)
        true = effective_dof(best, dof)
        a, b = beta_fit(t_two_sided(np.sqrt(true * best / (1 - best)), true))
        slope = float(r[top]) * float(np.std(y) / np.std(raw[live[top]]))
        t = np.sign(r[top]) * np.sqrt(dof * r2 / (1 - r2))
        at_true = float(t_two_sided(np.sqrt(true * r2 / (1 - r2)), true))
        row = own.iloc[live[top]]
        return pd.DataFrame([(key[0], len(live), a, b, true, at_true, row["variant_id"], row["tss_distance"], float(t_two_sided(t, dof)), slope, slope / t if t else np.nan, (int((best >= r2).sum()) + 1) / (permutations + 1), float(beta_cdf(at_true, a, b)))], columns=columns)

    parts = max(1, -(-phenotypes.select("phenotype_id").distinct().count() // share))  # by the work, as the bytes are few
    cis, p = cis.repartition(parts, "phenotype_id"), p.select(F.col("phenotype_id").alias("_own"), "p").repartition(parts, "_own")
    return cis.groupBy("phenotype_id").cogroup(p.groupBy("_own")).applyInPandas(of, TOP)


def qvalues(pvals: DataFrame, key: str, p: str, knot: float = 0.94) -> DataFrame:
    """Adds qval: step-up values times the share of true nulls, read at the last knot (1 for under 100 rows)."""
    share = pvals.agg(F.when(F.count(p) < 100, 1.0).otherwise(F.least(F.lit(1.0), F.count_if(F.col(p) > knot) / F.count(p) / (1 - knot))).alias("_pi0"))
    q = stepped_up(pvals.select(p), p).crossJoin(F.broadcast(share)).select(F.col(p).alias("_p"), F.least(F.col("_pi0") * F.col("least"), F.lit(1.0)).alias("qval"))
    return pvals.join(q, F.col(p) == F.col("_p")).drop("_p")


def thresholds(found: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Adds qval, the common threshold between the last passing and the first failing value, and each phenotype's own.

    None passing gives 0.
    """
    q = qvalues(found, "phenotype_id", "pval_beta")
    ends = q.agg(F.max(F.when(F.col("qval") <= fdr, F.col("pval_beta"))).alias("_lo"), F.min(F.when(F.col("qval") > fdr, F.col("pval_beta"))).alias("_hi"))
    both = q.crossJoin(F.broadcast(ends)).withColumn("threshold", F.when(F.col("_lo").isNull(), 0.0).otherwise((F.col("_lo") + F.coalesce("_hi", "_lo")) / 2)).drop("_lo", "_hi")
    return both.withColumn("pval_nominal_threshold", beta_at("threshold", "beta_shape1", "beta_shape2"))


def significant(found: DataFrame, limits: DataFrame, fdr: float | None = None) -> DataFrame:
    """Pairs with p at most their phenotype's threshold; with fdr: below it, and of phenotypes with qval at most fdr."""
    own = limits if fdr is None else limits.where(F.col("qval") <= fdr)
    both = found.join(own.select("phenotype_id", "pval_nominal_threshold"), "phenotype_id")
    return both.where(F.col("pval_nominal") <= F.col("pval_nominal_threshold") if fdr is None else F.col("pval_nominal") < F.col("pval_nominal_threshold"))


def shrunk(x: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf's covariance of the rows of x, towards a multiple of the identity."""
    x = x - x.mean(1, keepdims=True)
    p, n = x.shape
    s = x @ x.T / n
    mu = np.trace(s) / p
    far = ((s - mu * np.eye(p)) ** 2).sum()
    noise = min(((x**2) @ (x**2).T / n - s**2).sum() / n, far)
    w = noise / far if far > 0 else 0.0
    return (1 - w) * s + w * mu * np.eye(p)


def numbers_of_tests(genotypes: DataFrame, pairs: DataFrame, window: int = 200, share: float = 0.99) -> DataFrame:
    """(phenotype_id, tests): eigenvalues that make up `share` of each window of cis variants, summed."""
    g = arrays(genotypes, "variant_id", "dosage", "g", common(genotypes), fill=True)
    order = Window.partitionBy("phenotype_id").orderBy("tss_distance", "variant_id")
    placed = pairs.withColumn("_w", F.floor((F.row_number().over(order) - 1) / window)).join(g, "variant_id")

    def of(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own.sort_values(["tss_distance", "variant_id"])["g"])
        x = x[np.ptp(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"phenotype_id": [key[0]], "tests": [0]})
        c = shrunk(x)
        d = np.sqrt(np.diag(c))
        e = np.clip(np.linalg.eigvalsh(c / np.outer(d, d))[::-1], 0, None)
        return pd.DataFrame({"phenotype_id": [key[0]], "tests": [int(min(len(e), np.searchsorted(np.cumsum(e), share * len(e)) + 1))]})

    return placed.groupBy("phenotype_id", "_w").applyInPandas(of, "phenotype_id string, tests long").groupBy("phenotype_id").agg(F.sum("tests").alias("tests"))


def paired_correlation(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, r, pval, adjusted): the correlation of a row's values in two tables; Bonferroni over the rows. Rows that are constant in either are left out."""
    r = a.select(key, "sample_id", F.col(value).cast("double").alias("_a")).join(b.select(key, "sample_id", F.col(value).cast("double").alias("_b")), [key, "sample_id"])
    sums = r.groupBy(key).agg(F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("_ab"), F.var_pop("_a").alias("_aa"), F.var_pop("_b").alias("_bb"), (F.min("_a") < F.max("_a")).alias("_va"), (F.min("_b") < F.max("_b")).alias("_vb"))
    r = sums.where("n > 2 AND _va AND _vb").select(key, "n", (F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias("r"))
    return with_bonferroni(r)


def with_bonferroni(r: DataFrame) -> DataFrame:
    """Adds pval and adjusted, p times the number of rows, to correlations r over n samples."""
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    m = r.agg(F.count("*").alias("_m"))
    return r.withColumn("pval", t_pvalue(t, F.col("n") - 2)).crossJoin(F.broadcast(m)).withColumn("adjusted", F.least(F.col("pval") * F.col("_m"), F.lit(1.0))).drop("_m")


def fisher_exact(rows: DataFrame, one: str, other: str) -> DataFrame:
    """(both, only_one, only_other, neither, odds, pval) of two boolean columns."""
    x, y = F.col(one), F.col(other)
    return with_fisher(rows.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_one"), F.count_if(~x & y).alias("only_other"), F.count_if(~x & ~y).alias("neither")))


def with_fisher(tables: DataFrame) -> DataFrame:
    """Adds odds and pval to tables(both, only_one, only_other, neither), over groups of equal sums.

    A table's hypergeometric probabilities are summed where they do not exceed the observed one.
    """
    import math

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def of(a: int, b: int, c: int, d: int) -> float:
            def choose(n: np.ndarray | int, k: np.ndarray) -> np.ndarray:
                lg = np.frompyfunc(math.lgamma, 1, 1)
                return (lg(np.asarray(n + 1.0)) - lg(k + 1.0) - lg(n - k + 1.0)).astype(float)

            k = np.arange(max(0, a - d), min(a + b, a + c) + 1, dtype=float)
            logs = choose(a + b, k) + choose(c + d, a + c - k)
            p = np.exp(logs - logs.max())
            return float(min(1.0, p[p <= p[int(a - k[0])] * (1 + 1e-7)].sum() / p.sum()))

        return pd.Series([of(*map(int, x)) for x in zip(a, b, c, d)])

    odds = F.col("both") * F.col("neither") / F.nullif(F.col("only_one") * F.col("only_other"), F.lit(0))
    return tables.withColumn("odds", odds).withColumn("pval", tail("both", "only_one", "only_other", "neither"))


def adjusted_by_tests(found: DataFrame, tests: DataFrame) -> DataFrame:
    """The phenotypes' least p-values times their numbers of tests, and those step-up adjusted."""
    least = found.groupBy("phenotype_id").agg(F.min("pval_nominal").alias("_p")).join(tests, "phenotype_id").select("phenotype_id", F.least(F.col("_p") * F.col("tests"), F.lit(1.0)).alias("pval_emt"))
    return benjamini_hochberg(least, "phenotype_id", "pval_emt")


def by_pairs(genotypes: DataFrame, phenotypes: DataFrame, pairs: DataFrame, covariates: int = 0) -> DataFrame:
    """The given pairs (phenotype_id, variant_id), each once, with slope, error, t and p; none that was not asked for."""
    return with_pvalues(nominal(genotypes, phenotypes, pairs.select("phenotype_id", "variant_id").distinct().withColumn("tss_distance", F.lit(0))), covariates).drop("tss_distance")


def beta_approximation(best: np.ndarray, r2: float, dof: float) -> tuple[float, float, float, float, float]:
    """(pval_beta, shape1, shape2, true_df, pval_true_df) of an observed r2 among the largest ones of permutations."""
    best, r2 = np.minimum(best, 1 - 1e-12), min(r2, 1 - 1e-12)
    one = Many([Angles(best)])
    found = one.dofs(np.array([dof]))
    true, (a, b) = float(found[0]), one.fits(found)[0]
    at = float(t_two_sided(np.sqrt(true * r2 / (1 - r2)), true))
    return float(beta_cdf(at, a, b)), a, b, true, at


def orders(n: int, permutations: int, seed: int, block: int = 1000) -> Iterator[np.ndarray]:
    """Places of n values in each permutation, a column each, a block at a time: what Generator.permuted makes of rows of values."""
    if permutations * n > 1 << 24:
        rng = np.random.default_rng(seed)
        for at in range(0, permutations, block):
            yield rng.permuted(np.tile(np.arange(n), (min(block, permutations - at), 1)), axis=1).T
    else:
        yield from kept_orders(n, permutations, seed, block)


@lru_cache(maxsize=8)
def kept_orders(n: int, permutations: int, seed: int, block: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.ascontiguousarray(rng.permuted(np.tile(np.arange(n), (min(block, permutations - at), 1)), axis=1).T) for at in range(0, permutations, block)]


def stepwise(tested, threshold: float | None, most: int) -> list[tuple]:
    """Rows of LEADS: tested(variants beside which it searches, rank) until pval_beta is above the threshold, then each found one anew beside the others."""
    found = [tested([], 1)]
    if threshold is None:
        return found
    if found[0][-2] > threshold:
        return []
    while len(found) < most:
        new = tested([f[3] for f in found], len(found) + 1)
        if new[-2] > threshold or new[3] in {f[3] for f in found}:
            break
        found.append(new)
    if len(found) == 1:
        return found
    kept = {}
    for f in [tested([o[3] for o in found if o is not f], f[-1]) for f in found]:
        if f[-2] <= threshold:
            kept.setdefault(f[3], f)
    return list(kept.values())


def search(x: np.ndarray, ys: list[np.ndarray], basis: np.ndarray, permutations: int, seed: int, block: int = 1000) -> tuple[int, int, float, float, np.ndarray, float]:
    """(phenotype, variant, r, slope, largest r2 of each permutation, dof): the strongest of some phenotypes over variants, less what the basis explains.

    The same permutations are drawn for each phenotype, so that their maxima belong together. Variants that the
    basis explains have r 0.
    """

    def rest(m: np.ndarray) -> np.ndarray:
        m = m - m.mean(-1, keepdims=True)
        return m - (m @ basis) @ basis.T

    def scaled(m: np.ndarray, like: np.ndarray) -> np.ndarray:
        n, whole = np.linalg.norm(m, axis=-1, keepdims=True), np.linalg.norm(like - like.mean(-1, keepdims=True), axis=-1, keepdims=True)
        return np.where(n > 1e-7 * np.maximum(whole, 1e-300), m / np.where(n > 0, n, 1), 0.0)

    rx = rest(x)
    u = scaled(rx, x)
    top, best = None, np.zeros(permutations)
    for k, y in enumerate(ys):
        ry = rest(y)
        r = u @ scaled(ry, y)
        i = int(np.argmax(r * r))
        if top is None or r[i] ** 2 > top[2] ** 2:
            top = (k, i, float(r[i]), float(r[i] * np.linalg.norm(ry) / max(np.linalg.norm(rx[i]), 1e-300)))
        at = 0
        for order in orders(len(y), permutations, seed, block):
            own = y[order.T]
            c = u @ scaled(rest(own), own).T
            best[at : at + len(own)] = np.maximum(best[at : at + len(own)], np.maximum(c.max(0), -c.min(0)) ** 2)
            at += len(own)
    return *top, best, len(ys[0]) - 2 - basis.shape[1]


LEADS = "group_id string, group_size int, phenotype_id string, variant_id string, tss_distance long, num_var int, beta_shape1 double, beta_shape2 double, true_df double, pval_true_df double, pval_nominal double, slope double, slope_se double, pval_perm double, pval_beta double, rank int"


def lead(group: str, own: pd.DataFrame, x: np.ndarray, names: list[str], ys: list[np.ndarray], basis: np.ndarray, permutations: int, seed: int, rank: int) -> tuple:
    k, i, r, slope, best, dof = search(x, ys, basis, permutations, seed)
    beta, a, b, true, at = beta_approximation(best, r * r, dof)
    r2 = min(r * r, 1 - 1e-12)
    t = np.sign(r) * np.sqrt(dof * r2 / (1 - r2))
    row = own.iloc[i]
    return (group, len(names), names[k], row["variant_id"], int(row["tss_distance"]), len(own), a, b, true, at, float(t_two_sided(t, dof)), slope, slope / t if t else np.nan, (int((best >= r2).sum()) + 1) / (permutations + 1), beta, rank)


def leads(genotypes: DataFrame, phenotypes: DataFrame, pairs: DataFrame, groups: DataFrame | None = None, covariates: DataFrame | None = None, threshold: float | None = None, permutations: int = 10_000, seed: int = 1, share: int = 50) -> DataFrame:
    """Each group's strongest pair of a phenotype and a variant with permutation p-values; with a threshold, its independent variants.

    groups has phenotype_id and group_id; without it each phenotype is a group. covariates has a row per sample,
    its columns but sample_id are covariates. Samples are those that all tables have and of which all of a group's phenotypes
    have values. A permutation's maximum is over a group's phenotypes. With a threshold, the strongest variant
    joins the covariates until pval_beta is above it; then each one found is tested anew beside the others, and what
    passes is kept once. A task holds one group's cis variants, and `share` groups go to a task.
    """
    names = groups if groups is not None else phenotypes.select("phenotype_id", F.col("phenotype_id").alias("group_id")).distinct()
    g, p, shared = packed(genotypes, phenotypes, *([covariates] if covariates is not None else []))
    beside = table_of(covariates, shared) if covariates is not None else np.zeros((len(shared), 0))
    p = p.join(names, "phenotype_id").select(F.col("group_id").alias("_group"), "phenotype_id", "p")
    near = pairs.join(names, "phenotype_id").groupBy("group_id", "variant_id").agg(F.min_by("tss_distance", "phenotype_id").alias("tss_distance"))
    cis = near.join(g, "variant_id")
    columns = [c.split()[0] for c in LEADS.split(", ")]

    def of(key: tuple, own: pd.DataFrame, cases: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(cases):
            return pd.DataFrame(columns=columns)
        own, cases = own.sort_values(["tss_distance", "variant_id"], ignore_index=True), cases.sort_values("phenotype_id", ignore_index=True)
        x, y = np.stack(own["g"]), np.stack(cases["p"]).astype(float)
        has = ~np.isnan(y).any(0)
        x, y = x[:, has], y[:, has]
        own, x = own[np.ptp(x, axis=1) > 0].reset_index(drop=True), x[np.ptp(x, axis=1) > 0]
        base = list(spanned(beside[has]).T)
        if not len(own) or x.shape[1] < 3 + len(base):
            return pd.DataFrame(columns=columns)
        ids, ys = list(cases["phenotype_id"]), list(y)
        at = {v: i for i, v in enumerate(own["variant_id"])}

        def tested(more: list[str], rank: int) -> tuple:
            return lead(key[0], own, x, ids, ys, spanned(np.array([*base, *(x[at[v]] for v in more)]).reshape(-1, x.shape[1]).T), permutations, seed, rank)

        return pd.DataFrame(stepwise(tested, threshold, min(len(own), x.shape[1] - 4 - len(base))), columns=columns)

    parts = max(1, -(-names.select("group_id").distinct().count() // share))
    cis, p = cis.repartition(parts, "group_id"), p.repartition(parts, "_group")
    return cis.groupBy("group_id").cogroup(p.groupBy("_group")).applyInPandas(of, LEADS)


def trans_interaction(genotypes: DataFrame, phenotypes: DataFrame, samples: DataFrame, term: str, least_t: float, least_maf: float = 0.05, block: int = 2000, covariates: int = 0) -> DataFrame:
    """(variant_id, phenotype_id, b_gi, t_gi, pval_gi) over all variants and phenotypes, where |t| of genotype x term is at least least_t.

    Samples are those that all three tables have, with a term, and of which the phenotype has values. All variants
    meet all phenotypes in large parts, compared `block` by `block`. Genotype, term and their
    product are made orthogonal per variant, so a pair costs three products. least_t 0 gives every pair that has a t.
    """
    i = samples.select("sample_id", F.col(term).cast("double").alias("_i")).where("_i IS NOT NULL")
    shared = common(genotypes, phenotypes, i)
    term_of = table_of(i, shared)[:, 0]
    own = of_samples(genotypes, shared).drop("_at")
    alleles = allele_stats(own).where(F.col("maf") >= least_maf).select("variant_id")
    g = arrays(own.join(alleles, "variant_id", "left_semi"), "variant_id", "dosage", "g", shared, fill=True, centre=False)
    p = arrays(varying(of_samples(phenotypes, shared).drop("_at")), "phenotype_id", "value", "p", shared)
    sizes = alleles.count(), phenotypes.select("phenotype_id").distinct().count()

    def strong(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        found = []
        for rows, has in by_mask(right):
            x, y, raw = left[:, has], right[rows][:, has], term_of[has]
            y, one = y - y.mean(1, keepdims=True), raw - raw.mean()
            e0 = one / max(np.linalg.norm(one), 1e-300)
            a, z = x - x.mean(1, keepdims=True), x * raw
            z = z - z.mean(1, keepdims=True)
            a1 = a - (a @ e0)[:, None] * e0
            na = np.linalg.norm(a1, axis=1, keepdims=True)
            a1 = a1 / np.where(na > 1e-9, na, np.inf)
            z1 = z - (z @ e0)[:, None] * e0
            z1 = z1 - (z1 * a1).sum(1, keepdims=True) * a1
            nz = np.linalg.norm(z1, axis=1, keepdims=True)
            u = z1 / np.where((nz > 1e-6 * np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)) & (na > 1e-9), nz, np.inf)
            dof = x.shape[1] - 4 - covariates
            c = u @ y.T
            left_over = (y * y).sum(1)[None, :] - (y @ e0)[None, :] ** 2 - (a1 @ y.T) ** 2 - c * c
            with np.errstate(divide="ignore", invalid="ignore"):
                t = c * np.sqrt(dof / left_over)
            k, j = np.nonzero((np.abs(t) >= least_t) & (left_over > 1e-12 * (y * y).sum(1)[None, :]) & (u != 0).any(1)[:, None])
            found.append((k, rows[j], c[k, j] / nz[k, 0], t[k, j], np.full(len(k), dof)))
        i, j, *values = (np.concatenate(c) for c in zip(*found))
        return i, j, dict(zip(("b_gi", "t_gi", "dof"), values))

    found = everywhere(g.withColumnRenamed("g", "x"), p.withColumnRenamed("p", "y"), strong, "b_gi double, t_gi double, dof int", sizes, len(shared), block)
    return found.withColumn("pval_gi", t_pvalue("t_gi", "dof")).drop("dof")


def permutation_maxima(genotypes: DataFrame, samples: DataFrame, variants: DataFrame, permutations: int, seed: int = 1, block: int = 2000) -> DataFrame:
    """(chrom, permutation, r2): the largest r2 of permuted normal scores with all variants of the other chromosomes.

    Each block of variants gives a maximum per chromosome and permutation; the two largest over chromosomes then
    give every chromosome's maximum without itself. Chrom null: over all of them.
    """
    shared = common(genotypes, samples)
    n = len(shared)
    import statistics

    base = np.array([statistics.NormalDist().inv_cdf((k + 1) / (n + 1)) for k in range(n)])
    scores = unit(np.random.default_rng(seed).permuted(np.tile(base, (permutations, 1)), axis=1))
    g = arrays(genotypes, "variant_id", "dosage", "g", shared, fill=True).join(variants.select("variant_id", "chrom"), "variant_id")

    def largest(batches):
        """Of each chromosome the maxima over the task's variants, of which equal ones are compared once."""
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for chrom, own in b.groupby("chrom"):
                x = classes(np.stack(own["g"]))[0]
                for at in range(0, len(x), block):
                    r = unit(x[at : at + block]) @ scores.T
                    found[chrom] = np.maximum(found.get(chrom, 0.0), np.maximum(r.max(0), -r.min(0)) ** 2)
        for chrom, r2 in found.items():
            yield pd.DataFrame({"chrom": chrom, "permutation": np.arange(permutations, dtype=np.int32), "r2": r2})

    per = g.select("chrom", "g").mapInPandas(largest, "chrom string, permutation int, r2 double").groupBy("permutation", "chrom").agg(F.max("r2").alias("r2"))
    by = per.groupBy("permutation").agg(F.array_sort(F.collect_list(F.struct(-F.col("r2"), "chrom"))).alias("_all"))  # a row per chromosome
    top = by.select("permutation", F.col("_all")[0].alias("_x"), F.try_element_at("_all", F.lit(2)).alias("_y"))
    names = per.select("chrom").distinct()
    each = names.crossJoin(top).select("chrom", "permutation", (-F.when(F.col("_x.chrom") == F.col("chrom"), F.col("_y.col1")).otherwise(F.col("_x.col1"))).alias("r2")).where("r2 IS NOT NULL")
    return each.union(top.select(F.lit(None).cast("string"), "permutation", -F.col("_x.col1")))


def with_permutations(pairs: DataFrame, maxima: DataFrame) -> DataFrame:
    """Adds pval_perm to pairs (r2, chrom of the phenotype; null: all): the share of permutations whose maximum is at least r2, one added to both counts.

    maxima has at most chromosomes x permutations rows; in order, they go to all tasks, and a pair's place among them is
    found by halving.
    """
    rows = maxima.groupBy("chrom").agg(F.array_sort(F.collect_list("r2")).alias("_max")).collect()
    held = maxima.sparkSession.sparkContext.broadcast({r["chrom"]: np.array(r["_max"]) for r in rows})

    @F.pandas_udf("double")
    def share(r2: pd.Series, chrom: pd.Series) -> pd.Series:
        out = np.full(len(r2), np.nan)
        names = chrom.astype(object).where(chrom.notna(), None)
        for c in names.unique():
            own = (names.isna() if c is None else names == c).to_numpy()
            if c in held.value:
                m = held.value[c]
                out[own] = (len(m) - np.searchsorted(m, r2[own].to_numpy()) + 1) / (len(m) + 1)
        return pd.Series(out)

    known = F.col("chrom").isin(*(r["chrom"] for r in rows if r["chrom"] is not None))
    known = F.coalesce(known, F.lit(any(r["chrom"] is None for r in rows)))
    return pairs.where(known).withColumn("pval_perm", share("r2", "chrom"))


def true_share(found: DataFrame, p: str, knot: float = 0.94) -> DataFrame:
    """(n, pi1): the share of true effects among p-values, 1 less the share of nulls at the last knot; under 100 rows it is 0."""
    pi0 = F.when(F.count(p) < 100, 1.0).otherwise(F.least(F.lit(1.0), F.count_if(F.col(p) > knot) / F.count(p) / (1 - knot)))
    return found.agg(F.count(p).alias("n"), (1 - pi0).alias("pi1"))


def replication(pairs: DataFrame, genotypes: DataFrame, phenotypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed pairs tested in another cohort, and the share of them that are true there."""
    found = by_pairs(genotypes, phenotypes, pairs)
    return found, true_share(found, "pval_nominal")


def kendall(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, tau): Kendall's rank correlation with ties; null where a side is constant.

    A key's values are packed into an array, and pairs are counted inside it.
    """
    packed = rows.groupBy(key).agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("v"))

    def counted(f):
        return F.aggregate("v", F.lit(0).cast("long"), lambda s, a: s + F.aggregate("v", F.lit(0).cast("long"), lambda u, b: u + f(a, b)))

    concordant = counted(lambda a, b: (F.signum(a["x"] - b["x"]) * F.signum(a["y"] - b["y"])).cast("long"))
    tx, ty = counted(lambda a, b: (a["x"] != b["x"]).cast("long")), counted(lambda a, b: (a["y"] != b["y"]).cast("long"))
    return packed.select(key, F.size("v").alias("n"), F.try_divide(concordant, F.sqrt(tx.cast("double") * ty)).alias("tau"))
