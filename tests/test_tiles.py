"""Variants near genes meet in tiles: the same pairs and values as from a list of pairs, and no pair is shuffled."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.catalog import QUERIES
from strandloom.operators import association as qtl
from strandloom.operators import mapping as mp
from strandloom.operators import tiles
from strandloom.operators.results import correlation_by_pairs
from strandloom.operators.tiles import everywhere, half_up, near, parts_of

SF = "/root/testdata/sf0.001"


def above(df, name):
    """The operators of the plan above the first one of that name."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert name in text, text[:300]
    return text[: text.index(name)]


@pytest.mark.parametrize("name", ["q7_nominal", "q27_annotated", "q3_by_pairs", "p6_filtered", "q24_below_thresholds", "q26_replication"])
def test_no_pair_is_shuffled_by_id(spark, name):
    top = above(QUERIES[name](spark, SF), "FlatMapGroupsInArrow")
    assert "Join" not in top and "hashpartitioning" not in top


@pytest.mark.parametrize("name", ["p10_signed_distances", "p7_by_distance", "q4_cis_pairs"])
def test_a_pair_is_joined_once(spark, name):
    assert QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Join") == 1


def cohort(spark, seed=3):
    r = random.Random(seed)
    samples = [f"S{k:02d}" for k in range(9)]
    variants = [(f"rs{k}", f"chr{k % 2}", r.choice([r.randrange(1, 4000), 500])) for k in range(40)]
    genes = [(f"G{k}", f"chr{k % 2}", r.choice([r.randrange(-50, 4000), 500])) for k in range(30)]
    g = [(v[0], s, r.choice([0, 1, 2, 2, None])) for v in variants for s in samples]
    p = [(n[0], s, None if r.random() < 0.1 else float(r.randrange(5))) for n in genes for s in samples]
    return (
        spark.createDataFrame(g, "variant_id string, sample_id string, dosage int"), spark.createDataFrame(p, "phenotype_id string, sample_id string, value double"),
        spark.createDataFrame(variants, "variant_id string, chrom string, pos long"), spark.createDataFrame(genes, "gene_id string, chrom string, start_pos long"),
    )


@pytest.mark.parametrize("window", [0, 300])
def test_tiles_equal_a_list_of_pairs(spark, window):
    g, p, v, t = cohort(spark)
    want = qtl.nominal(g, p, qtl.cis_pairs(v, t, window))
    got = qtl.cis_nominal(g, p, v, t, window)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and want.count() > 10


def test_chunks_lose_and_repeat_nothing(spark):
    g, p, v, t = cohort(spark)
    t = t.withColumnsRenamed({"gene_id": "phenotype_id", "start_pos": "tss"}).withColumn("y", F.array(F.lit(1.0)))
    got = near(v.withColumn("x", F.array(F.lit(1.0))), t, 300, lambda x, y: ({}, np.ones((len(y), len(x)), bool)), "", block=3)
    want = {(a.phenotype_id, b.variant_id, b.pos - a.tss) for a in t.collect() for b in v.collect() if a.chrom == b.chrom and abs(b.pos - a.tss) <= 300}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_best_of_each_phenotype(spark):
    g, p, v, t = cohort(spark)
    all_ = [(r.phenotype_id, r.variant_id, r.r2) for r in qtl.cis_nominal(g, p, v, t, 300).collect()]
    got = {r.phenotype_id: (r.variant_id, r.r2, r.n) for r in qtl.cis_nominal(g, p, v, t, 300, ["r2"], (["phenotype_id"], "r2", "variant_id")).collect()}
    for key in {a[0] for a in all_}:
        own = [a for a in all_ if a[0] == key]
        assert got[key] == (*min(((-r2, v), v, r2) for _, v, r2 in own)[1:], len(own))


def test_halves_go_away_from_zero():
    assert half_up(np.array([0.0078125, -0.0078125, 1.0000005, np.inf]), 6).tolist() == [0.007813, -0.007813, 1.000001, np.inf]


def test_a_row_goes_to_few_parts():
    """Parts of 2,000 rows copied each variant 600 times and each phenotype 450 times here."""
    assert parts_of((900_000, 1_200_000), 25, 2000, 64) == (7, 10)
    assert parts_of((5_400_000, 7_200_000), 25, 2000, 64) == (21, 28) and parts_of((30, 0), 25, 2000, 64) == (1, 1)


@pytest.mark.parametrize("step", [3, 100])
def test_everywhere_finds_each_pair_once(spark, monkeypatch, step):
    monkeypatch.setattr(tiles, "STEP", 7)
    r = random.Random(5)
    x = [(f"rs{k}", [float(r.randrange(2)) for _ in range(3)]) for k in range(50)]
    y = [(f"G{k}", [float(r.randrange(2)) for _ in range(3)], k) for k in range(40)]

    def equal(a, b):
        i, j = np.nonzero((a[:, None] == b[None]).all(2))
        return i, j, {"total": a[i].sum(1)}

    v, p = spark.createDataFrame(x, "variant_id string, x array<double>"), spark.createDataFrame(y, "phenotype_id string, y array<double>, own long")
    got = [tuple(q) for q in everywhere(v, p, equal, "total double", (50, 40), 3, step, tasks=6).select("variant_id", "phenotype_id", "total", "own").collect()]
    want = {(a, b, sum(m), k) for a, m in x for b, n, k in y if m == n}
    assert len(got) == len(want) and set(got) == want


def test_listed_pairs_move_arrays(spark):
    plan = QUERIES["e12_by_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "sample_id" not in plan[: plan.index("Join")]  # no row per pair and sample
    r = random.Random(2)
    a, b = ({(k, s): r.choice([None, 1.0, 2.0, 4.0]) for k in "uvw" for s in "abcdefg"} for _ in range(2))
    b[("u", "a")] = None
    tables = [spark.createDataFrame([(*k, v) for k, v in t.items()], f"{c} string, sample_id string, value double") for t, c in ((a, "x"), (b, "y"))]
    pairs = spark.createDataFrame([(i, j) for i in "uvw" for j in "uv"], "x string, y string")
    got = {(q.x, q.y): (q.n, round(q.r, 9)) for q in correlation_by_pairs(*tables, pairs, "x", "y", "value").collect()}
    want = {}
    for i in "uvw":
        for j in "uv":
            both = np.array([(a[i, s], b[j, s]) for s in "abcdefg" if a[i, s] is not None and b[j, s] is not None], float).reshape(-1, 2)
            if len(both) > 2 and (np.ptp(both, axis=0) > 0).all():
                want[i, j] = (len(both), round(float(np.corrcoef(both.T)[0, 1]), 9))
    assert got == want and want


def test_whole_products_meet_in_large_parts(spark):
    for name in ("q1_covariates", "q15_q18_trans", "q17_trans_interaction"):
        assert "CoGroup" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_cis_interactions_equal_a_list_of_pairs(spark):
    g, p, v, t = cohort(spark)
    s = spark.createDataFrame([(f"S{k:02d}", None if k == 4 else float(k * k % 5)) for k in range(9)], "sample_id string, c double")
    want = {(r.phenotype_id, r.variant_id): r for r in mp.interaction(g, p, qtl.cis_pairs(v, t, 300), s, "c").collect()}
    got = {(r.phenotype_id, r.variant_id): r for r in mp.cis_interaction(g, p, v, t, s, "c", 300).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    for key, r in got.items():
        for c in ("tss_distance", "dof", "b_g", "b_i", "b_gi", "b_g_se", "b_i_se", "b_gi_se", "t_gi"):
            assert r[c] == pytest.approx(want[key][c], rel=1e-9, abs=1e-12), c
    best = {r.phenotype_id: r for r in mp.top_interaction(g, p, v, t, s, "c", 0.0, 300).collect()}
    for key in {k[0] for k in want}:
        own = [r for k, r in want.items() if k[0] == key]
        first = min(own, key=lambda r: (-round(abs(r.t_gi), 9), r.variant_id))
        assert (best[key].variant_id, best[key].num_tests) == (first.variant_id, len(own))
        assert best[key].pval_gi == pytest.approx(first.pval_gi, rel=1e-6)


def test_difference_of_groups_is_that_of_their_slopes(spark):
    g, p, v, t = cohort(spark, 4)
    s = spark.createDataFrame([(f"S{k:02d}", "ab"[k % 2]) for k in range(9)], "sample_id string, half string")
    sides = []
    for half in "ab":
        ids = s.where(F.col("half") == half)
        own = [x.join(ids, "sample_id", "left_semi") for x in (g, p)]
        sides.append({(r.phenotype_id, r.variant_id): r for r in qtl.nominal(*own, qtl.cis_pairs(v, t, 300)).collect()})
    got = {(r.phenotype_id, r.variant_id): r for r in mp.difference(g, p, v, t, s, "half", "a", 300).collect()}
    assert got.keys() == sides[0].keys() & sides[1].keys() and len(got) > 10
    for key, r in got.items():
        a, b = (x[key] for x in sides)
        assert (r.slope_a, r.slope_b, r.se_a) == pytest.approx((a.slope, b.slope, a.slope_se)) if r.se_a is not None else a.slope_se is None
        if a.slope_se is not None and b.slope_se is not None:
            z = (a.slope - b.slope) / (a.slope_se + b.slope_se)
            assert (r.z, r.pval) == pytest.approx((z, math.erfc(abs(z) / 2**0.5)), abs=1e-12)
        else:
            assert r.z is None and r.pval is None


@pytest.mark.parametrize("name", ["q2_difference", "q9_interaction", "q9_top_interaction"])
def test_no_pair_is_joined(spark, name):
    top = above(QUERIES[name](spark, SF), "FlatMapGroupsInArrow")
    assert "Join" not in top and "Window" not in top


@pytest.mark.parametrize("most", [1, 60, 1 << 23])
def test_pairs_by_distance_are_made_in_order(spark, most):
    r = random.Random(most)
    v = spark.createDataFrame([(f"rs{k}", r.choice(["c1", "c2", None]), r.choice([None, 7, r.randrange(-200, 900)])) for k in range(150)], "variant_id string, chrom string, pos long")
    g = spark.createDataFrame([(f"G{k}", r.choice(["c1", "c2", None]), r.choice([7, r.randrange(-200, 900)])) for k in range(90)], "gene_id string, chrom string, start_pos long")
    for window in (0, 100):
        got = [tuple(q) for q in tiles.by_distance(v, g, window, most, chunk=40).collect()]
        assert [abs(q[2]) for q in got] == sorted(abs(q[2]) for q in got) and len(got) > 50
        assert sorted(got) == sorted(tuple(q) for q in qtl.cis_pairs(v, g, window).collect())


def test_no_pair_is_sorted_by_distance(spark):
    text = QUERIES["p7_by_distance"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "abs(tss_distance" not in text and "rangepartitioning" not in text
