"""All pairs of variants and phenotypes as a table of matrices: a row holds a block of the ones against a block of the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_two_sided
from .association import allele_stats
from .results import interaction_maf
from .samples import arrays, basis, by_mask, common, of_samples, rest, table_of, varying

STATS = [f"{k}_{t}" for t in ("g", "i", "gi") for k in ("b", "t", "pval")]
SIDES = "row_block long, column_block long, variant_ids array<string>, phenotype_ids array<string>, maf array<double>, ma_samples array<long>, ma_count array<double>"


def three_terms(x: np.ndarray, one: np.ndarray, y: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
    """b, t and pval (rows of x by rows of y) of y ~ x + one + x one beside the basis q; nan where terms depend on each other or the fit is perfect."""
    terms = [rest(x, q), rest(np.broadcast_to(one, x.shape).copy(), q), rest(x * one, q)]
    y = rest(y, q)
    s = np.stack(terms, 1)  # variants x terms x samples
    gram = s @ s.transpose(0, 2, 1)
    free = np.linalg.det(gram) > 1e-9 * np.prod(np.diagonal(gram, axis1=1, axis2=2), axis=1)
    inverse = np.full_like(gram, np.nan)
    inverse[free] = np.linalg.inv(gram[free])
    with_y = s @ y.T  # variants x terms x phenotypes
    b = inverse @ with_y
    whole = (y * y).sum(1)
    rss = whole - (b * with_y).sum(1)
    dof = x.shape[1] - 4 - q.shape[1]
    out = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        rss = np.where(rss > 1e-9 * whole, rss, np.nan)
        for k, name in enumerate(("g", "i", "gi")):
            t = b[:, k] / np.sqrt(inverse[:, k, k, None] * rss / dof)
            known = np.isfinite(t)
            p = np.full_like(t, np.nan)
            p[known] = t_two_sided(t[known], np.full(known.sum(), float(dof)))
            out |= {f"b_{name}": np.where(known, b[:, k], np.nan), f"t_{name}": np.where(known, t, np.nan), f"pval_{name}": p}
    return out


def interaction_blocks(genotypes: DataFrame, phenotypes: DataFrame, samples: DataFrame, term: str, covariates: DataFrame | None = None, least_maf: float = 0.05, block: int = 256) -> DataFrame:
    """Each block of variants with each block of phenotypes: the blocks' ids, the variants' allele statistics, and b, t
    and p of genotype, term and their product as arrays, a variant's phenotypes one after another.

    Samples are those that all tables have, with a term; a phenotype's are those of which it has values. Variants vary,
    and are frequent enough in both halves of the term. Covariates, a row per sample, are projected out of all terms.
    Statistics are null where the terms depend on each other, where the fit is perfect, and where a phenotype has too few
    values. Packed rows move once per block of the other side; a task holds two blocks and their nine matrices.
    """
    own = samples.where(F.col(term).isNotNull())
    shared = common(genotypes, phenotypes, own, *([covariates] if covariates is not None else []))
    one = table_of(own.select("sample_id", term), shared)[:, 0]
    beside = table_of(covariates, shared) if covariates is not None else np.zeros((len(shared), 0))
    g = of_samples(genotypes, shared).drop("_at")
    fit = interaction_maf(g, of_samples(own, shared).drop("_at"), term, least_maf)
    alleles = allele_stats(g).join(fit.select("variant_id"), "variant_id", "left_semi")
    left = arrays(g, "variant_id", "dosage", "g", shared, fill=True, centre=False).join(alleles, "variant_id")
    right = arrays(varying(of_samples(phenotypes, shared).drop("_at")), "phenotype_id", "value", "p", shared)
    m, n = (max(1, -(-x.select(k).distinct().count() // block)) for x, k in ((genotypes, "variant_id"), (phenotypes, "phenotype_id")))
    schema = f"{SIDES}, {', '.join(f'{k} array<double>' for k in STATS)}"

    def meet(key: tuple, v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(p):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        v, p = v.sort_values("variant_id"), p.sort_values("phenotype_id")
        x, y = np.stack(v["g"]).astype(float), np.stack(p["p"]).astype(float)
        found = {k: np.full((len(v), len(p)), np.nan) for k in STATS}
        for rows, has in by_mask(y):
            q = basis(beside[has])
            if has.sum() - 4 - q.shape[1] < 1:
                continue
            for k, values in three_terms(x[:, has], one[has], y[np.ix_(rows, has)], q).items():
                found[k][:, rows] = values
        row = {"row_block": key[0], "column_block": key[1], "variant_ids": v["variant_id"].tolist(), "phenotype_ids": p["phenotype_id"].tolist(), "maf": v["maf"].to_numpy(float), "ma_samples": v["ma_samples"].tolist(), "ma_count": v["ma_count"].to_numpy(float)}
        return pd.DataFrame([row | {k: pa.array(a.ravel(), from_pandas=True).to_pylist() for k, a in found.items()}])

    def dealt(rows: DataFrame, key: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts))).withColumn(other, each)

    a, b = dealt(left, "variant_id", "_v", m, "_w", n), dealt(right, "phenotype_id", "_w", n, "_v", m)
    return a.groupBy("_v", "_w").cogroup(b.groupBy("_v", "_w")).applyInPandas(meet, schema)


def pairs_of(blocks: DataFrame, names: list[str]) -> DataFrame:
    """(variant_id, phenotype_id, names): a row per pair of such a table of matrices."""
    schema = f"variant_id string, phenotype_id string, {', '.join(f'{k} double' for k in names)}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v, p = batch["variant_ids"][i].values, batch["phenotype_ids"][i].values
                rows = pa.array(np.repeat(np.arange(len(v)), len(p)))
                columns = pa.array(np.tile(np.arange(len(p)), len(v)))
                yield pa.RecordBatch.from_arrays([v.take(rows), p.take(columns), *(batch[k][i].values for k in names)], ["variant_id", "phenotype_id", *names])

    return blocks.select("variant_ids", "phenotype_ids", *names).mapInArrow(each, schema)
