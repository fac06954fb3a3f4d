"""Distribution functions against known values, and mapping of a planted association."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import special as sp
from strandloom.operators import graphs as gr
from strandloom.operators import mapping as mp
from strandloom.sources import formats as fm


def test_distribution_functions(spark):
    p = [1e-12, 1e-4, 0.03, 0.2, 0.5, 0.8, 0.999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(sp.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(x) for x in p], abs=1e-9)
    assert sp.beta_cdf([0.3, 0.9], 1.0, 4.0) == pytest.approx([1 - 0.7**4, 1 - 0.1**4])
    assert sp.beta_cdf(sp.beta_quantile([1e-9, 0.4], 0.7, 30.0), 0.7, 30.0) == pytest.approx([1e-9, 0.4])
    assert sp.t_two_sided([1.0, 2.0], [1.0, 2.0]) == pytest.approx([0.5, 1 - 2 / 6**0.5])
    assert mp.beta_fit(np.random.default_rng(0).beta(2, 9, 20_000)) == pytest.approx((2, 9), rel=0.05)


def test_planted_association(spark):
    rng = np.random.default_rng(3)
    dosages = rng.integers(0, 3, (6, 60))
    values = {"planted": dosages[2] + rng.normal(0, 0.5, 60), "noise": rng.normal(size=60), "constant": np.ones(60)}
    g = spark.createDataFrame([(f"v{i}", f"S{j:02}", int(d)) for i, row in enumerate(dosages) for j, d in enumerate(row)], "variant_id string, sample_id string, dosage int")
    p = spark.createDataFrame([(k, f"S{j:02}", float(x)) for k, row in values.items() for j, x in enumerate(row)], "phenotype_id string, sample_id string, value double")
    pairs = spark.createDataFrame([(k, f"v{i}", i) for k in values for i in range(6)], "phenotype_id string, variant_id string, tss_distance long")
    found = {r["phenotype_id"]: r for r in mp.permuted(g, p, pairs, 500).collect()}
    assert sorted(found) == ["noise", "planted"]
    top = found["planted"]
    assert top["variant_id"] == "v2" and top["pval_perm"] == pytest.approx(1 / 501) and top["pval_beta"] < 1e-6
    assert found["noise"]["pval_perm"] > 0.01 and 0.5 < found["noise"]["beta_shape1"] < 2
    x, y = dosages[2] - dosages[2].mean(), values["planted"] - values["planted"].mean()
    assert top["slope"] == pytest.approx(x @ y / (x @ x))
    assert mp.permuted(g.limit(0), p, pairs, 10).count() == 0
    tests = {r["phenotype_id"]: r["tests"] for r in mp.numbers_of_tests(g, pairs).collect()}
    assert all(1 <= n <= 6 for n in tests.values())


def test_modes_components_and_missing_calls(spark):
    rows = spark.createDataFrame([(f"a{i}", True, False, False) for i in range(5)] + [(f"b{i}", False, True, True) for i in range(4)] + [("c", False, True, False)], "k string, x boolean, y boolean, z boolean")
    got = {r["k"]: (r["cluster"], r["distance"]) for r in gr.k_modes(rows, "k", ["x", "y", "z"], 2).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["c"] == (got["b0"][0], 1)
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "d"), ("f", "e")], "src string, dst string")
    assert {r["node"]: r["component"] for r in gr.components(edges).collect()} == dict(a="a", b="a", c="a", d="d", e="e", f="e")
    lines = spark.createDataFrame([("##x",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB",), ("chr1\t5\trs1\tA\tG\t.\tPASS\t.\tGT:DS\t0|1:0.9\t./.:.",)], "value string")
    calls = fm.read_vcf(lines).select("sample_id", fm.dosage(F.col("value")).alias("d")).collect()
    assert {r["sample_id"]: r["d"] for r in calls} == {"A": 1, "B": None}
    assert {r["value"] for r in fm.read_vcf(lines, "DS").collect()} == {"0.9", "."}


def test_queries_draw_ten_thousand_permutations(spark):
    from strandloom.catalog import QUERIES

    rows = QUERIES["q13_independent"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(abs(r.pval_perm * 10_001 - round(r.pval_perm * 10_001)) < 1e-6 for r in rows)
    assert QUERIES["q19_permutation_maxima"](spark, "/root/testdata/sf0.001").count() % 10_000 == 0
