"""Depths are summed within ranges of bases that know what is open before them."""

import random
from collections import Counter

import pytest

from strandloom.catalog import QUERIES
from strandloom.operators import reads as rd

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c6_pileup", "c8_both_pileups"])
def test_nothing_is_written_between(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "ExistingRDD" not in text


def test_pieces_over_borders_of_ranges(spark):
    r = random.Random(4)
    rows = [("S1", "c1", r.choice("+-"), s, s + r.choice([1, 60, 150_000, 420_000])) for s in (r.choice([0, 99_990, 100_000, 199_999, 250_000, -70]) for _ in range(90))]
    got = {tuple(q)[:4]: q.depth for q in rd.pileup(spark.createDataFrame(rows, "sample_id string, chrom string, strand string, start_pos long, end_pos long")).collect()}
    at = Counter()
    for sample, c, strand, s, e in rows:
        at[sample, c, strand, s] += 1
        at[sample, c, strand, e] -= 1
    assert got == {k: sum(v for p, v in at.items() if p[2] == k[2] and p[3] <= k[3]) for k in at}
