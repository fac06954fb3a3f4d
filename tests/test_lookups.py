"""Lookups by id, least p along a region, counts, statistics of robust networks and text results, on small rows."""

import statistics
from math import log2, log10

import pytest

from strandloom.operators import graphs as gr
from strandloom.operators import results as rs
from strandloom.sources import tables as tb


def test_variants_by_known_ids(spark):
    variants = spark.createDataFrame([("a", "1", 5, 1), ("b", "1", 5, 2), ("a", "2", 9, 3), (None, "1", 5, 4), ("c", "3", 1, 5)], "variant_id string, chrom string, pos long, _n int")
    known = spark.createDataFrame([("a", "1", 5), ("a", "1", 5), ("c", "3", 2), (None, "1", 5)], "variant_id string, chrom string, pos long")
    assert [r["_n"] for r in rs.with_ids(variants, known, ["a", "c", "z"]).collect()] == [1]
    assert rs.with_ids(variants.limit(0), known, ["a"]).count() == 0


def test_least_p_along_a_region(spark):
    found = spark.createDataFrame([("v", "p2", 0.01), ("v", "p1", 0.01), ("v", "p3", 0.5), ("w", "p1", None), ("x", "p1", 0.0), ("far", "p1", 0.1), ("lost", "p1", 0.1)], "variant_id string, phenotype_id string, pval_nominal double")
    positions = spark.createDataFrame([("v", "1", 10), ("v", "1", 10), ("w", "1", 11), ("x", "1", 20), ("far", "1", 21), ("far", "2", 15)], "variant_id string, chrom string, pos long")
    got = {r["variant_id"]: tuple(r)[1:] for r in rs.least_along(found, positions, "1:10-20").collect()}
    assert got == {"v": ("1", 10, "p1", pytest.approx(-log10(0.01))), "x": ("1", 20, "p1", None)}
    with pytest.raises(ValueError):
        rs.least_along(found, positions, "1:20-10")
    n = {r["which"]: tuple(r)[1:] for r in rs.counted(found, found.where("pval_nominal < 0.05")).collect()}
    assert n == {"all": (7, 3, 5), "significant": (3, 2, 2)}
    assert rs.counted(found.limit(0), found.limit(0)).count() == 2


def test_statistics_of_robust_networks(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("b", "d", 1.0), ("d", "e", 1.0)], "src string, dst string, cost double")
    rows = [("r1", "a", 0.5, 0.1), ("r1", "b", 0.9, 0.3), ("r1", "d", 0.7, 0.0), ("r2", "b", 1.0, 0.2), ("r2", "gone", 0.0, 1.0)]
    got = {r["run"]: r.asDict() for r in gr.robust_statistics(spark.createDataFrame(rows, "run string, node string, robustness double, specificity double"), edges).collect()}
    logs = [log2(1), log2(3), log2(2)]
    one = got["r1"]
    assert (one["size"], one["min_robustness"], one["max_specificity"]) == (3, 0.5, 0.3)
    assert [one["mean_robustness"], one["mean_specificity"], one["mean_log_degree"], one["std_log_degree"]] == pytest.approx([0.7, 0.4 / 3, sum(logs) / 3, statistics.stdev(logs)])
    assert one["ks"] == pytest.approx(3 / 5 - 1 / 3)  # degrees 1, 1, 1, 2, 3 of all nodes against 1, 2, 3
    assert (got["r2"]["size"], got["r2"]["std_log_degree"], got["r2"]["min_robustness"]) == (1, None, 1.0)


def test_text_results_by_chromosome(spark):
    df = spark.createDataFrame([("p1", 0.1 + 0.2, "1"), ("p2", None, "1"), ("p3", 1e-300, "X")], "phenotype_id string, p double, chrom string")
    path = tb.write_text_by_chromosome(df, tb.scratch(spark, "text"))
    schema = "phenotype_id string, p double"
    assert sorted(map(tuple, tb.read_text_by_chromosome(spark, path, schema).collect())) == sorted(map(tuple, df.collect()))
    one = tb.read_text_by_chromosome(spark, path, schema, ["1"])
    assert sorted(r["phenotype_id"] for r in one.collect()) == ["p1", "p2"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "chrom" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
