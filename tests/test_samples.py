"""Samples are matched by id, whatever rows come in which order, and values that are missing are left out of their pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.special import t_two_sided
from strandloom.operators import association as qtl
from strandloom.operators import mapping as mp
from strandloom.operators import results, samples

G, P = "variant_id string, sample_id string, dosage int", "phenotype_id string, sample_id string, value double"
SAMPLES = [f"S{i:02}" for i in range(30)]


def tables(spark):
    """Genotypes of samples 0-27, phenotypes of 2-29; nulls and absent rows in both."""
    rng = np.random.default_rng(9)
    g = [(f"v{i}", s, int(rng.integers(0, 3)) if rng.random() > 0.1 else None) for i in range(8) for s in SAMPLES[:28] if (i, s) != (1, "S05")]
    dose = {(v, s): d for v, s, d in g}
    p = [(f"p{j}", s, None if j == 2 and k % 7 == 0 else float((dose.get(("v3", s)) or 0) * (j == 1) + rng.normal())) for j in range(5) for k, s in enumerate(SAMPLES[2:]) if (j, s) != (3, "S11")]
    p += [("flat", s, 1.0 if s > "S01" and s < "S28" else 2.0) for s in SAMPLES[2:]]
    rng.shuffle(g)
    rng.shuffle(p)
    g = [(str(v), str(s), None if d is None else int(d)) for v, s, d in g]
    p = [(str(v), str(s), None if d is None else float(d)) for v, s, d in p]
    return spark.createDataFrame(g, G), spark.createDataFrame(p, P)


def by_sql(g, p):
    """n, r and slope of every pair: dosages imputed among the common samples, samples without a value left out."""
    con = duckdb.connect()
    con.register("g", g.toPandas().astype({"dosage": "Float64"}))
    con.register("p", p.toPandas())
    rows = con.execute("""WITH shared AS (SELECT sample_id FROM g INTERSECT SELECT sample_id FROM p),
    every AS (SELECT v.variant_id, b.sample_id, g.dosage FROM (SELECT DISTINCT variant_id FROM g) v CROSS JOIN shared b LEFT JOIN g USING (variant_id, sample_id)),
    filled AS (SELECT variant_id, sample_id, coalesce(dosage, avg(dosage) OVER (PARTITION BY variant_id)) AS d FROM every)
    SELECT phenotype_id, variant_id, count(*), corr(value, d), regr_slope(value, d) FROM p JOIN filled USING (sample_id) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL HAVING min(value) < max(value)""").fetchall()
    return {r[:2]: r[2:] for r in rows}


def test_shifted_missing_and_null_samples(spark):
    g, p = tables(spark)
    want = by_sql(g, p)
    assert len(want) == 40 and {n for n, *_ in want.values()} == {26, 22, 25}
    pairs = p.select("phenotype_id").distinct().crossJoin(g.select("variant_id").distinct()).withColumn("tss_distance", F.lit(0).cast("long"))
    found = {(r.phenotype_id, r.variant_id): (r.dof + 2, r.r2, r.slope, r.tstat) for r in qtl.nominal(g, p, pairs).collect()}
    whole = {(r.phenotype_id, r.variant_id): (r.n, r.r2, r.slope, r.tstat) for r in results.pairwise(g, p, block=3).collect()}
    for got in (found, whole):
        assert got.keys() == want.keys()
        for k, (n, r, slope) in want.items():
            assert got[k][0] == n and math.isclose(got[k][1], r * r, abs_tol=1e-12) and math.isclose(got[k][2], slope, abs_tol=1e-12)
            assert math.isclose(got[k][3], r * math.sqrt((n - 2) / (1 - r * r)), abs_tol=1e-9)
    top = {r.phenotype_id: r for r in mp.permuted(g, p, pairs, 50).collect()}
    leads = {r.phenotype_id: r for r in mp.leads(g, p, pairs, permutations=50).collect()}
    for name in {k[0] for k in want}:
        best = max((want[k][1] ** 2, k[1]) for k in want if k[0] == name)[1]
        for r in (top[name], leads[name]):
            assert r.variant_id == best and math.isclose(r.slope, want[name, best][2], abs_tol=1e-9)
            assert math.isclose(r.pval_nominal, float(t_two_sided(want[name, best][1] * math.sqrt((want[name, best][0] - 2) / (1 - want[name, best][1] ** 2)), want[name, best][0] - 2)), rel_tol=1e-6)
    assert qtl.nominal(g.where("sample_id < 'S01'"), p, pairs).count() == 0
    with pytest.raises(ValueError, match="S00"):
        qtl.nominal(g, p, pairs, same=True)
    with pytest.raises(ValueError, match="more than one"):
        results.of_phenotype(g, p)


def test_term_of_missing_samples(spark):
    g, p = tables(spark)
    term = spark.createDataFrame([(s, float(i % 5) if i != 9 else None) for i, s in enumerate(SAMPLES) if i != 4], "sample_id string, c double")
    pairs = spark.createDataFrame([(f"p{j}", f"v{i}", 0) for j in range(5) for i in range(8)], "phenotype_id string, variant_id string, tss_distance long")
    dense = {(r.phenotype_id, r.variant_id): r for r in mp.trans_interaction(g, p, term, "c", 0.0, 0.0, block=3).collect()}
    cis = {(r.phenotype_id, r.variant_id): r for r in mp.interaction(g, p, pairs, term, "c").collect()}
    assert dense.keys() == cis.keys() and len(cis) == 40
    values = {(r.phenotype_id, r.sample_id): r.value for r in p.collect()}
    doses = {(r.variant_id, r.sample_id): r.dosage for r in g.collect()}
    terms = {r.sample_id: r.c for r in term.collect()}
    shared = [s for s in SAMPLES[2:28] if terms.get(s) is not None]
    for (name, v), r in cis.items():
        known = [doses[v, s] for s in shared if doses.get((v, s)) is not None]
        own = [s for s in shared if values.get((name, s)) is not None]
        d = np.array([np.mean(known) if doses.get((v, s)) is None else doses[v, s] for s in own])
        c, y = np.array([terms[s] for s in own]), np.array([values[name, s] for s in own])
        x = np.column_stack([np.ones(len(own)), d, c, d * c])
        b, rss = np.linalg.lstsq(x, y)[:2]
        se = math.sqrt(rss[0] / (len(own) - 4) * np.linalg.inv(x.T @ x)[3, 3])
        assert r.dof == len(own) - 4
        for got in (r, dense[name, v]):
            assert math.isclose(got.b_gi, b[3], abs_tol=1e-7) and math.isclose(got.t_gi, b[3] / se, rel_tol=1e-6, abs_tol=1e-7)


def test_products_beside_covariates(spark):
    g, p = tables(spark)
    cov = spark.createDataFrame([(s, float(i % 4), float(i * i % 7), float(2 * (i % 4))) for i, s in enumerate(SAMPLES) if i != 6], "sample_id string, a double, b double, twice double")
    got = {(r.phenotype_id, r.variant_id): r for r in results.pairwise(g, p, cov, maf=True, variances=True, block=3).collect()}
    values = {(r.phenotype_id, r.sample_id): r.value for r in p.collect()}
    doses = {(r.variant_id, r.sample_id): r.dosage for r in g.collect()}
    beside = {r.sample_id: (r.a, r.b) for r in cov.collect()}
    shared = [s for s in SAMPLES[2:28] if s in beside]
    assert len(got) == 40
    for (name, v), r in got.items():
        known = [doses[v, s] for s in shared if doses.get((v, s)) is not None]
        filled = {s: np.mean(known) if doses.get((v, s)) is None else doses[v, s] for s in shared}
        own = [s for s in shared if values.get((name, s)) is not None]
        c = np.column_stack([np.ones(len(own)), [beside[s] for s in own]])
        y, d = (z - c @ np.linalg.lstsq(c, z)[0] for z in (np.array([values[name, s] for s in own]), np.array([filled[s] for s in own])))
        rr = d @ y / math.sqrt(d @ d * (y @ y))
        t = rr * math.sqrt((len(own) - 4) / (1 - rr * rr))
        assert r.n == len(own) and math.isclose(r.r, rr, abs_tol=1e-9) and math.isclose(r.slope, d @ y / (d @ d), abs_tol=1e-9)
        assert math.isclose(r.tstat, t, rel_tol=1e-7, abs_tol=1e-9) and math.isclose(r.pval, float(t_two_sided(t, len(own) - 4)), rel_tol=1e-6) and math.isclose(r.slope_se, r.slope / t, rel_tol=1e-6)
        assert math.isclose(r.var_g, d @ d / (len(own) - 1), rel_tol=1e-9) and math.isclose(r.var_p, y @ y / (len(own) - 1), rel_tol=1e-9)
        af = sum(filled.values()) / (2 * len(filled))
        assert math.isclose(r.maf, min(af, 1 - af), abs_tol=1e-12)
    few = results.pairwise(g, p, cov, most_p=0.1, block=3).collect()
    assert {(r.phenotype_id, r.variant_id) for r in few} == {k for k, r in got.items() if r.pval <= 0.1} and few


def test_masks_and_repeats(spark):
    m = np.array([[1.0, np.nan, 2], [3, 4, 5], [6, np.nan, 7]])
    assert sorted((rows.tolist(), has.tolist()) for rows, has in samples.by_mask(m)) == [([0, 2], [True, False, True]), ([1], [True, True, True])]
    twice = spark.createDataFrame([("v", "a", 1), ("v", "a", 2), ("v", "b", 1)], G)
    with pytest.raises(Exception, match="(?i)duplicate"):
        samples.arrays(twice, "variant_id", "dosage", "g", ["a", "b"]).collect()
