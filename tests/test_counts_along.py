"""Counts and bases of overlaps come from sums along the places, not from pairs."""

import random
from collections import Counter

import pytest

from strandloom.catalog import QUERIES
from strandloom.operators import intervals as iv

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("odd", [False, True])
def test_counts_and_bases_equal_pairs(spark, odd):
    r = random.Random(odd)

    def place(most):
        s = r.randrange(-30, 2000 if odd else 300_000, 7)
        return r.choice(["c1", "c2", None]), s, s + (r.choice([0, -20, 40]) if odd else r.randrange(1, most))

    regions = [(f"r{k % 90}", *place(90_000)) for k in range(100)] + [("none", "c3", 5, 9), ("null", "c1", None, 9)]
    features = [(r.choice(["x", "y", "z"]), *place(3000)) for _ in range(600)] + [("x", "c1", 40_000, 40_000), ("x", "c2", 40_000, 190_000), ("y", "c1", 7, None)]
    a = spark.createDataFrame(regions, "id string, chrom string, start_pos long, end_pos long")
    b = spark.createDataFrame(features, "kind string, chrom string, start_pos long, end_pos long")
    n, bases = Counter(), Counter()
    for k, c, s, e in regions:
        for kind, d, t, f in features:
            if None not in (c, s, e, d, t, f) and c == d and t < e and s < f:
                n[k, kind] += 1
                bases[k] += min(e, f) - max(s, t)
    got = [tuple(q) for q in iv.feature_counts(a, b, "id", "kind", ["x", "y"]).collect()]
    assert sorted(got) == sorted((k, n[k, "x"], n[k, "y"]) for k, *_ in regions) and sum(n.values()) > 100
    got = {q.id: (q.n, q.bases) for q in iv.overlap_totals(a, b, "id").collect()}
    assert got == {k: (sum(n[k, c] for c in "xyz"), bases[k]) for k, _ in n}


@pytest.mark.parametrize("name", ["i24_factor_matrix", "i15_stranded_overlaps", "i22_annotated", "i22_annotations"])
def test_no_pair_of_overlaps_is_made(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "_bin" not in text


@pytest.mark.parametrize("name", ["i15_stranded_overlaps", "i22_annotated", "i22_annotations"])
def test_nothing_is_written_between_places_and_counts(spark, name):
    df = QUERIES[name](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in text and "Join" not in text


@pytest.mark.parametrize("width", [7, 100])
def test_ranges_add_up_to_whole_regions(spark, width):
    from pyspark.sql import functions as F

    from strandloom.operators import along

    r = random.Random(width)
    place = lambda most: (lambda s: (r.choice(["c1", "c2"]), s, s + r.randrange(1, most)))(r.randrange(-60, 300))
    regions = [(f"r{k}", *place(120)) for k in range(80)]
    features = [(k % 2, *(place(90) if k % 5 else ("c1", k - 60, k - 60))) for k in range(300)]
    a = spark.createDataFrame(regions, "id string, chrom string, start_pos long, end_pos long")
    b = spark.createDataFrame(features, "_kind int, chrom string, start_pos long, end_pos long")
    got = along.totals(a, b, "id", 2, width).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("_first", "_n0", "_n1", "bases"))).collect()
    hits = {k: [(i, min(e, f) - max(s, t)) for i, d, t, f in features if c == d and t < e and s < f] for k, c, s, e in regions}
    assert {q.id: tuple(q)[1:] for q in got} == {k: (1, sum(i == 0 for i, _ in h), sum(i == 1 for i, _ in h), sum(n for _, n in h)) for k, h in hits.items()}
