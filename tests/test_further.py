"""Residualised tracks, rewritten lines, results in ranges, whole annotations and matrices of interactions against brute force."""

import itertools

import numpy as np
import pytest

from strandloom.operators import annotation as an
from strandloom.operators import blocks as bl
from strandloom.operators import tracks as tr
from strandloom.sources import formats as fm
from strandloom.sources import tables as tb


def test_residualised_track(spark):
    rng = np.random.default_rng(3)
    names = [f"s{i}" for i in range(9)]
    c = rng.normal(size=(9, 2))
    c = np.column_stack([c, c[:, 0] * 2 + 1])  # the third depends on the first
    depth = {(p, n): float(rng.integers(1, 50)) for p in (5, 9, 12) for n in names if rng.random() < 0.7}
    track = spark.createDataFrame([("c", p, n, d) for (p, n), d in depth.items()] + [("c", 5, "other", 3.0)], "chrom string, pos long, sample_id string, depth double")
    beside = spark.createDataFrame([(n, *map(float, v)) for n, v in zip(names, c)], "sample_id string, a double, b double, d double")
    got = {(r["pos"], r["sample_id"]): r["depth"] for r in tr.residualised(track, beside, ["chrom", "pos"]).collect()}
    full = np.column_stack([np.ones(9), c])
    assert len(got) == 27
    for p in (5, 9, 12):
        y = np.array([depth.get((p, n), 0.0) for n in names])
        want = y - full @ np.linalg.lstsq(full, y, rcond=None)[0] + y.mean()
        assert [got[p, n] for n in names] == pytest.approx(list(want), abs=1e-9)
    bare = tr.residualised(track, beside.select("sample_id"), ["chrom", "pos"])
    assert {(r["pos"], r["sample_id"]): r["depth"] for r in bare.collect()} == {(p, n): depth.get((p, n), 0.0) for p in (5, 9, 12) for n in names}
    assert tr.residualised(track.limit(0), beside, ["chrom", "pos"]).count() == 0
    with pytest.raises(ValueError):
        tr.residualised(track, spark.createDataFrame([("s0", None)], "sample_id string, a double"), ["chrom", "pos"])
    with pytest.raises(ValueError):
        tr.staged(track, "log", beside, beside, ["pos"])
    with pytest.raises(Exception, match="(?i)duplicate"):
        tr.residualised(track.union(track), beside, ["chrom", "pos"]).collect()


def test_variant_lines_keep_one_field(spark):
    head = ["##fileformat=VCFv4.2", "##FORMAT=<ID=GT,Number=1>", "##FORMAT=<ID=GTX,Number=1>", "##FILTER=<ID=q>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"]
    body = ["1\t5\tv\tA\tC\t.\tq\tGT:x=1\tGT:DP\t0/1:3\t1/1", "1\t6\tw\tA\tC\t9\tPASS\t.\tDP:GT\t3:0|0\t4", "1\t7\tx\tA\tC\t.\t.\t.\tDP\t3\t4", "1\t8\ty\tA\tC\t.\tq\t."]
    rows = spark.createDataFrame([(v,) for v in head + body], "value string").coalesce(1)
    got = [r["value"] for r in fm.kept_format(rows).collect()]
    assert got == [*head[:2], *head[3:], "1\t5\tv\tA\tC\t.\tq\tGT:x=1\tGT\t0/1\t1/1", "1\t6\tw\tA\tC\t9\tPASS\t.\tGT\t0|0\t.", "1\t7\tx\tA\tC\t.\t.\t.\tGT\t.\t.", body[3]]
    assert [r["value"] for r in fm.without_filter(rows).collect()] == [*head[:3], head[4], *(v.replace("\tq\t", "\t.\t").replace("\tPASS\t", "\t.\t") for v in body)]
    assert [r["value"] for r in fm.kept_format(rows, "DP").collect()][-4:-1] == ["1\t5\tv\tA\tC\t.\tq\tGT:x=1\tDP\t3\t.", "1\t6\tw\tA\tC\t9\tPASS\t.\tDP\t3\t4", "1\t7\tx\tA\tC\t.\t.\t.\tDP\t3\t4"]
    calls = {(r["id"], r["sample_id"]): r["value"] for r in fm.read_vcf(fm.kept_format(rows)).collect()}
    assert calls["v", "a"] == "0/1" and calls["w", "a"] == "0|0"


def test_results_in_ranges(spark):
    rows = [(c, int(p), i) for i, (c, p) in enumerate(itertools.product(["1", "2", None], [*range(0, 1000, 7), *[55] * 200]))]
    df = spark.createDataFrame(rows, "chrom string, pos long, i long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few rows are one task's
    try:
        path = tb.write_by_range(df, tb.scratch(spark, "ranges"), width=100, files=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["chrom"] or "", r["pos"], r["i"]) for r in tb.read_by_range(spark, path).collect()) == sorted((c or "", p, i) for c, p, i in rows)
    some = tb.read_by_range(spark, path, "2:50-250")
    assert sorted(r["i"] for r in some.collect()) == [i for c, p, i in rows if c == "2" and 50 <= p <= 250]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "range" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    crowded = [f for f in tb.read_by_range(spark, path).inputFiles() if "chrom=1/range=0/" in f]
    assert len(crowded) > 1  # a crowded range is several tasks'
    assert sorted(r["i"] for r in tb.read_by_range(spark, path, "1").collect()) == [i for c, _, i in rows if c == "1"]
    for text in ("2:9-3", "2:a-b", ""):
        with pytest.raises(ValueError):
            tb.read_by_range(spark, path, text)
    with pytest.raises(ValueError):
        tb.write_by_range(df.withColumnRenamed("i", "range"), tb.scratch(spark, "ranges"))
    assert tb.read_by_range(spark, path, "9:1-5").count() == 0


def test_trans_results_round_trip(spark):
    df = spark.createDataFrame([("v1", "p1", 0.123456789), ("v2", "p2", 1.23456789e-30), ("v3", None, None)], "variant_id string, phenotype_id string, pval double")
    schema = "variant_id string, phenotype_id string, pval double"
    text = tb.read_trans(spark, tb.write_trans(df, tb.scratch(spark, "trans"), text=True), schema)
    assert sorted(map(tuple, text.collect())) == [("v1", "p1", 0.123457), ("v2", "p2", 1.23457e-30), ("v3", None, None)]
    assert sorted(map(tuple, tb.read_trans(spark, tb.write_trans(df, tb.scratch(spark, "trans"))).collect())) == sorted(map(tuple, df.collect()))


def test_whole_annotation_of_ways_that_meet(spark):
    # two namespaces; z lies below both a and b, q and r form a cycle below b
    edges = [("a", "A"), ("b", "A"), ("a1", "a"), ("a2", "a"), ("b1", "b"), ("z", "a1"), ("z", "b1"), ("q", "b1"), ("r", "q"), ("q", "r"), ("f", "F"), ("f1", "f")]
    terms = spark.createDataFrame([("A", None, "A"), ("F", None, "F"), *((t, p, f"{t} activity") for t, p in edges)], "term_id string, parent_id string, name string")
    rows = [("g", "z", "EXP"), ("g", "r", "IEA"), ("g", "r", "IEA"), ("h", "a", "EXP"), ("h", "f1", "IC"), ("k", "A", "EXP"), ("k", "nowhere", "EXP"), (None, "a", "EXP"), ("m", "a1", "IC"), ("m", "a2", "IC"), ("m", "b", "IC"), ("n", "b", "IC"), ("n", "a", "IC")]
    gene_terms = spark.createDataFrame(rows, "gene string, term_id string, evidence string")
    roots = spark.createDataFrame([("process", "A"), ("function", "F")], "namespace string, term_id string")
    got = {(r["namespace"], r["gene"]): tuple(r)[2:] for r in an.whole_annotation(terms, gene_terms, roots, ["EXP"], ["IC"], {"function": " activity"}).collect()}
    assert got == {
        ("process", "g"): ("b", "b activity", 5, "b1", "b1 activity", 5),
        ("process", "h"): ("a", "a activity", 3, None, None, None),
        ("function", "h"): ("f", "f", 2, "f1", "f1", 2),
        ("process", "m"): ("a", "a activity", 4, "a1", "a1 activity", 2),
        ("process", "n"): ("a", "a activity", 2, None, None, None),
    }
    n = {(r["namespace"], r["score"]): r["n"] for r in an.evidence_by_tier(gene_terms, terms, roots, ["EXP"], ["IC"]).collect()}
    assert n == {("process", 3): 4, ("process", 1): 2, ("process", 2): 5, ("function", 2): 1}
    assert an.whole_annotation(terms, gene_terms.limit(0), roots, ["EXP"], ["IC"]).count() == 0


@pytest.mark.parametrize("beside", [0, 2])
def test_matrices_of_interactions(spark, beside):
    rng = np.random.default_rng(beside)
    names = [f"s{i:02d}" for i in range(30)]
    g = rng.integers(0, 3, size=(14, 30)).astype(float)
    g[3] = 1  # does not vary
    y = rng.normal(size=(9, 30))
    y[2, :4], y[5, 7] = np.nan, np.nan
    y[8, 3:] = np.nan  # too few values
    term, c = rng.normal(size=30), rng.normal(size=(30, beside))
    table = [(f"v{i}", s, int(g[i, j])) for i in range(14) for j, s in enumerate(names)] + [("v0", "other", 2)]
    genotypes = spark.createDataFrame(table, "variant_id string, sample_id string, dosage int")
    phenotypes = spark.createDataFrame([(f"p{i}", s, None if np.isnan(y[i, j]) else float(y[i, j])) for i in range(9) for j, s in enumerate(names)], "phenotype_id string, sample_id string, value double")
    samples = spark.createDataFrame([(s, float(t)) for s, t in zip(names, term)], "sample_id string, t double")
    covariates = spark.createDataFrame([(s, *map(float, v)) for s, v in zip(names, c)], "sample_id string, a double, b double") if beside else None
    found = bl.interaction_blocks(genotypes, phenotypes, samples, "t", covariates, least_maf=0.0, block=4)
    assert found.count() > 4  # several blocks on both sides
    got = {(r["variant_id"], r["phenotype_id"]): r for r in bl.pairs_of(found, bl.STATS).collect()}
    assert {k[0] for k in got} == {f"v{i}" for i in range(14)} - {"v3"} and len(got) == 13 * 9
    for (v, p), r in got.items():
        x, z = g[int(v[1:])], y[int(p[1:])]
        has = ~np.isnan(z)
        full = np.column_stack([x, term, x * term, np.ones(30), c])[has]
        dof = has.sum() - full.shape[1]
        if dof < 1:
            assert r["t_g"] is None and r["pval_gi"] is None
            continue
        b = np.linalg.lstsq(full, z[has], rcond=None)[0]
        se = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * ((z[has] - full @ b) ** 2).sum() / dof)
        assert [r["b_g"], r["b_i"], r["b_gi"]] == pytest.approx(list(b[:3]), rel=1e-6)
        assert [r["t_g"], r["t_i"], r["t_gi"]] == pytest.approx(list((b / se)[:3]), rel=1e-6)
    some = found.select("variant_ids", "maf").collect()
    assert all(m == pytest.approx(min(f, 1 - f)) for r in some for v, m in zip(r["variant_ids"], r["maf"]) for f in [g[int(v[1:])].mean() / 2])
