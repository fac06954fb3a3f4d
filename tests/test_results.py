"""What SQL does not show: errors, quantiles, whole cross products, repeated rows, ranges that are split."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.special import t_quantile, t_two_sided
from strandloom.operators import clusters, intervals, network, prefix, results
from strandloom.sources import tables
from strandloom.sources.views import with_views
from strandloom.plans.fragments import IMPUTED
from strandloom.operators.results import pairwise
from strandloom.sources.views import view

SF = "/root/testdata/sf0.001"


def test_pairwise_equals_sql(spark):
    con = duckdb.connect()
    for t in ("nation", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = f"SELECT g.variant_id, p.phenotype_id, corr(value, d) AS r, regr_slope(value, d) AS slope FROM {IMPUTED} g JOIN phenotypes p ON p.sample_id = g.sample_id GROUP BY ALL HAVING min(d) < max(d) AND min(value) < max(value)"
    want = {(v, p): (r, s) for v, p, r, s in con.execute(with_views(sql, "genotypes", "phenotypes")).fetchall()}
    got = pairwise(view(spark, SF, "genotypes"), view(spark, SF, "phenotypes")).collect()
    assert len(got) == len(want)
    for x in got:
        r, slope = want[x.variant_id, x.phenotype_id]
        assert math.isclose(x.r, r, abs_tol=1e-9) and math.isclose(x.slope, slope, abs_tol=1e-9) and math.isclose(x.r2, r * r, abs_tol=1e-9)
        assert math.isclose(x.tstat, r * math.sqrt(23 / (1 - r * r)), abs_tol=1e-6) and math.isclose(x.pval, t_two_sided(x.tstat, 23), abs_tol=1e-9)


def test_t_quantile():
    for dof in (3, 23.5):
        for p in (0.001, 0.3, 0.5, 0.975):
            t = float(t_quantile(p, dof))
            assert abs((t_two_sided(t, dof) / 2 if t < 0 else 1 - t_two_sided(t, dof) / 2) - p) < 1e-9
    assert abs(float(t_quantile(0.975, 10)) - 2.228138852) < 1e-8


def test_pvalue_of_correlation(spark):
    row = spark.range(1).select(results.pvalue_of_correlation(F.lit(0.5), 20).alias("p"), results.pvalue_of_correlation(F.lit(0.5), 20, legacy=True).alias("q")).first()
    assert np.isclose(row.p, t_two_sided(0.5 * math.sqrt(20 / 0.75), 20)) and np.isclose(row.q, t_two_sided(10 / math.sqrt(0.75), 20))


def test_regions_that_are_none(spark):
    good = spark.createDataFrame([("1", 5, 9, "+"), ("chrX", 0, 1, None)], "chrom string, start_pos long, end_pos long, strand string")
    assert [r.chrom for r in intervals.validated(good).collect()] == ["chr1", "chrX"]
    for bad in [("1", 5, 5, "+"), ("1", 5, 9, "x"), ("1", None, 9, "+")]:
        with pytest.raises(Exception, match="not a region"):
            intervals.validated(spark.createDataFrame([bad], good.schema)).collect()


def test_overlapping_keeps_repeated_rows(spark):
    a = spark.createDataFrame([("chr1", 5, 25_000, 1), ("chr1", 5, 25_000, 1), ("chr1", 5, 25_000, 2), ("chr2", 5, 9, 3)], "chrom string, start_pos long, end_pos long, n int")
    b = spark.createDataFrame([("chr1", 100, 24_000), ("chr1", 8, 12)], "chrom string, start_pos long, end_pos long")
    assert sorted(r.n for r in intervals.overlapping(a, b).collect()) == [1, 1, 2]


def test_depths_beyond_twelve_levels(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "term_id long, parent_id long")
    assert {r.term_id: r.depth for r in network.term_depths(chain).collect()} == {i: i for i in range(20)}


def test_nodes_of_self_loops_have_a_cluster(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("z", "z", 1.0)], "src string, dst string, cost double")
    assert {r.node for r in clusters.power_clusters(edges, 2).collect()} == {"a", "b", "c", "z"}


@pytest.mark.parametrize("f, whole", [(F.sum, np.cumsum), (F.max, np.maximum.accumulate), (F.min, np.minimum.accumulate)])
def test_running_over_ranges(spark, f, whole):
    rng = np.random.default_rng(1)
    rows = [(k, int(p), int(v)) for k, n in (("a", 300), ("b", 1), ("c", 40)) for p, v in zip(rng.permutation(5000)[:n], rng.integers(-50, 50, n))]
    frame = spark.createDataFrame(rows, "k string, p long, v long").withColumn("_r", F.floor(F.col("p") / 97))
    for down in (False, True):
        own = prefix.running(frame, ["k"], ["p"], F.col("v"), f, "x", down=down)
        before = prefix.running(frame, ["k"], ["p"], F.col("v"), f, "x", down=down, before=True)
        for k in "abc":
            mine = sorted([r[1:] for r in rows if r[0] == k], reverse=down)
            want = whole([v for _, v in mine]).tolist()
            assert {r.p: r.x for r in own.where(F.col("k") == k).collect()} == dict(zip([p for p, _ in mine], want))
            assert {r.p: r.x for r in before.where(F.col("k") == k).collect()} == dict(zip([p for p, _ in mine], [None, *want[:-1]]))
    ranged = prefix.in_ranges(frame.drop("_r"), "p")
    assert [r.x for r in prefix.running(ranged, [], ["p"], F.lit(1), F.sum, "x").orderBy("x").collect()] == list(range(1, 342))


def test_clusters_across_ranges(spark):
    rows = [("chr1", 10, 250_000), ("chr1", 120_000, 130_000), ("chr1", 249_999, 260_000), ("chr1", 400_000, 400_001), ("chr1", 400_001, 400_005)]
    got = intervals.clusters(spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long"), ["chrom"]).collect()
    assert sorted((r.start_pos, r.end_pos, r.n) for r in got) == [(10, 260_000, 3), (400_000, 400_005, 2)]


def test_files_are_not_overwritten(spark):
    path = tables.scratch(spark, "once")
    frame = spark.createDataFrame([("a", "x", 1.5)], "k string, c string, v double")
    tables.write_matrix(frame, "k", "c", "v", ["x", "y"], path)
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_matrix(frame, "k", "c", "v", ["x", "y"], path)
    tables.write_matrix(frame, "k", "c", "v", ["x", "y"], path, mode="overwrite")
    assert [tuple(r) for r in tables.read_matrix(spark, path, "c", "v").orderBy("c").collect()] == [("a", "x", 1.5), ("a", "y", None)]
    fam = tables.write_table(spark.createDataFrame([("f", "S1", "0", "0", 1, -9.0)]), tables.scratch(spark, "fam"), sep=" ", header=False)
    assert tables.read_fam(spark, fam).first().sample_id == "S1"
    top = tables.write_top(spark.createDataFrame([("a", 1 / 3)], "k string, v double"), tables.scratch(spark, "top"))
    assert tables.read_table(spark, top).first().v == "0.333333"


def test_fit_of_permutations_and_term(spark):
    v, s = view(spark, SF, "genotypes"), view(spark, SF, "samples")
    p = view(spark, SF, "phenotypes").where("phenotype_id = 'G7'")
    assert results.of_phenotype(v, p, (s, "cov1")).columns[-1] == "position"
    named = v.withColumn("variant_id", F.concat(F.lit("chr1_500_A_"), "variant_id"))
    assert results.of_phenotype(named, p).first().position == 500
