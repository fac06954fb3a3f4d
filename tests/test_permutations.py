import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import catalog
from strandloom.functions.special import t_two_sided
from strandloom.operators import association as qtl
from strandloom.operators import mapping as mp
from strandloom.operators import permutations as pm

SMALL = "/root/testdata/sf0.001"


def tables(spark):
    """Two chromosomes, equal variants, constant ones, missing values, a gene without variants and one without values."""
    rng = np.random.default_rng(3)
    calls = rng.integers(0, 3, (8, 14))
    variants = [(f"v{k}", f"chr{k % 2}", 1000 + 700 * (k // 2)) for k in range(24)]
    g = [(v, f"s{s:02}", None if (k + s) % 13 == 0 else int(1 if k == 5 else calls[k % 8, s])) for k, (v, *_) in enumerate(variants) for s in range(14)]
    genes = [(f"g{k}", f"chr{k % 2}", 1500 + 900 * (k // 2)) for k in range(9)] + [("far", "chr0", 900_000), ("none", "chr1", 2000)]
    p = [(name, f"s{s:02}", None if k == 2 and s in (3, 7) else float(2.0 if name == "none" else calls[k % 8, s] * (1 if k < 3 else 0) + rng.normal())) for k, (name, *_) in enumerate(genes) for s in range(14)]
    return (spark.createDataFrame(g, "variant_id string, sample_id string, dosage int"), spark.createDataFrame(p, "phenotype_id string, sample_id string, value double"),
            spark.createDataFrame(variants, "variant_id string, chrom string, pos long"), spark.createDataFrame(genes, "gene_id string, chrom string, start_pos long"))


def same(found, other, keys):
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (found, other))
    assert a and a.keys() == b.keys()
    for k, r in a.items():
        for name, value in r.asDict().items():
            close = pytest.approx(b[k][name], rel=1e-6, abs=0.02 if name == "pval_perm" else 1e-12, nan_ok=True) if isinstance(value, float) else b[k][name]
            assert value == close, (k, name)


def test_tiles_give_what_pairs_give(spark):
    g, p, v, t = tables(spark)
    pairs = qtl.cis_pairs(v, t, 1500)
    same(pm.cis_permuted(g, p, v, t, 300, window=1500), mp.permuted(g, p, pairs, 300), ["phenotype_id"])
    groups = t.select(F.col("gene_id").alias("phenotype_id"), F.when(F.col("gene_id").isin("g0", "g3", "g4"), "both").otherwise(F.col("gene_id")).alias("group_id"))
    same(pm.cis_leads(g, p, v, t, groups, permutations=300, window=1500), mp.leads(g, p, pairs, groups, permutations=300), ["group_id"])
    age = spark.createDataFrame([(f"s{s:02}", float(s * s % 5)) for s in range(14)], "sample_id string, age double")
    same(pm.cis_leads(g, p, v, t, covariates=age, threshold=0.2, permutations=300, window=1500), mp.leads(g, p, pairs, covariates=age, threshold=0.2, permutations=300), ["group_id", "variant_id"])
    sizes = pairs.groupBy("phenotype_id").agg(F.count("*").alias("n"), F.min("tss_distance").alias("first"), F.max("tss_distance").alias("last"))
    same(pm.cis_sizes(v, t, 1500), sizes, ["phenotype_id"])
    found = pm.cis_numbers_of_tests(g, v, t, width=4, window=1500, phenotypes=p)
    same(found.select("phenotype_id", "tests"), mp.numbers_of_tests(g, pairs, 4), ["phenotype_id"])
    least = mp.with_pvalues(qtl.nominal(g, p, pairs)).groupBy("phenotype_id").agg(F.min("pval_nominal").alias("least"))
    same(found.where("least IS NOT NULL").select("phenotype_id", "least"), least, ["phenotype_id"])


@pytest.mark.parametrize("name", ["q11_permuted", "q12_grouped_leads", "q13_independent", "q14_grouped_independent", "q28_numbers_of_tests", "p8_sizes"])
def test_no_row_per_pair_is_made(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "tss_distance#" not in plan.partition("FlatMapGroupsInArrow")[2].partition("\n")[2]


def test_fits_of_many_equal_those_of_each(spark):
    rng = np.random.default_rng(1)
    bests = [np.minimum(np.sort(rng.beta(0.5, n / 2, (m, 4000)).max(0)), 1 - 1e-12) for n, m in ((12, 1), (23, 5), (23, 100), (400, 30))]
    start = np.array([12.0, 23.0, 23.0, 400.0])
    many = mp.Many([mp.Angles(b) for b in bests])
    dof = many.dofs(start)
    for b, d, fit in zip(bests, dof, many.fits(dof)):
        p = t_two_sided(np.sqrt(d * b / (1 - b)), d)
        assert abs(p.mean() * (p.mean() * (1 - p.mean()) / p.var(ddof=1) - 1) - 1) < 1e-5
        assert fit == pytest.approx(mp.beta_fit(p), rel=1e-6) and not math.isnan(fit[0])


def test_shares_of_maxima_come_from_their_order(spark):
    """One row a pair, no array of maxima beside it; the same shares as counted one by one."""
    maxima = spark.createDataFrame([("c1", 0.2), ("c1", 0.5), ("c1", 0.5), ("c2", 0.9), (None, 0.4)], "chrom string, r2 double")
    pairs = spark.createDataFrame([("a", 0.5, "c1"), ("b", 0.51, "c1"), ("c", 0.1, "c2"), ("d", 0.4, None), ("e", 0.5, "c3")], "id string, r2 double, chrom string")
    found = mp.with_permutations(pairs, maxima)
    assert {r.id: r.pval_perm for r in found.collect()} == {"a": 3 / 4, "b": 1 / 4, "c": 1.0, "d": 1.0}
    assert "_max" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q7_full", "q17_dense"])
def test_pairs_meet_in_tiles(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "tss_distance" in plan.partition("FlatMapGroupsInArrow")[2].partition("\n")[0] and "_tss#" not in plan
