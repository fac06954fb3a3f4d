"""Order across ranges, cliques of any size, regions in words, clustered files, two planted signals in a group."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import graphs as gr
from strandloom.operators import mapping as mp
from strandloom.operators import prefix, results
from strandloom.sources import tables


@pytest.mark.parametrize("hops", [1, 3, -1, -4, 0])
def test_rows_some_hops_away(spark, hops):
    rng = random.Random(hops)
    rows = [(k, p, rng.choice([None, p * 10])) for k, n in (("a", 60), ("b", 2), (None, 9)) for p in rng.sample(range(400), n)]
    frame = spark.createDataFrame(rows, "k string, p long, v long").withColumn("_r", F.floor(F.col("p") / 13))
    got = {(r.k, r.p): r.x for r in prefix.shifted(frame, ["k"], ["p"], F.col("v"), "x", hops).collect()}
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        own = sorted(r[1:] for r in rows if r[0] == k)
        for i, (p, v) in enumerate(own):
            assert got[k, p] == (own[i + hops][1] if 0 <= i + hops < len(own) else None)


def test_cliques_and_their_communities(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(16), 2))) for _ in range(62)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs] + [("n0", "n0")] + [(f"n{b}", f"n{a}") for a, b in list(pairs)[:5]], "src string, dst string")
    near = defaultdict(set)
    for a, b in pairs:
        near[f"n{a}"].add(f"n{b}")
        near[f"n{b}"].add(f"n{a}")
    for k in (2, 3, 4, 5):
        want = [c for c in itertools.combinations(sorted(near), k) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
        if k != 5:
            assert sorted(tuple(r.nodes) for r in gr.cliques(edges, k).collect()) == sorted(want)
        group = {c: i for i, c in enumerate(want)}
        for a, b in itertools.combinations(want, 2):
            if len(set(a) & set(b)) == k - 1 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {c: new if g == old else g for c, g in group.items()}
        sets = defaultdict(set)
        for c, g in group.items():
            sets[g] |= set(c)
        got = defaultdict(set)
        for r in gr.clique_communities(edges, k).collect():
            got[r.community].add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, sets.values())), k


def test_regions_in_words():
    assert results.parsed_region("chr3") == ("chr3", None, None) and results.parsed_region("chrX:5-1,000") == ("chrX", 5, 1000)
    for bad in ("", None, "chr1:", "chr1:5", "chr1:9-5", "chr1:0-5", "chr1:a-b", "chr1:5-9-11", "chr 1", "chr1:-5"):
        with pytest.raises(ValueError, match="not a region"):
            results.parsed_region(bad)


def test_clustered_files(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("p"), (F.col("id") * 7 % 500).cast("string")).alias("phenotype_id"), "id")
    path = tables.write_clustered(rows, "phenotype_id", tables.scratch(spark, "clustered"))
    one = tables.select_clustered(spark, "phenotype_id", ["p77", "none"], path)
    assert one.columns == ["phenotype_id", "id"] and sorted(r.id for r in one.collect()) == [i for i in range(20_000) if i * 7 % 500 == 77]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_r#", plan) and tables.select_clustered(spark, "phenotype_id", ["zzz"], path).count() == 0


def test_two_signals_of_a_group(spark):
    rng = np.random.default_rng(12)
    g = rng.integers(0, 3, (6, 90))
    noise = rng.normal(0, 0.6, (2, 90))
    values = {"a": 1.2 * g[1] + noise[0], "b": 1.2 * g[4] + noise[1]}
    calls = spark.createDataFrame([(f"v{i}", f"S{j:03}", int(d)) for i, row in enumerate(g) for j, d in enumerate(row)], "variant_id string, sample_id string, dosage int")
    phenotypes = spark.createDataFrame([(k, f"S{j:03}", float(x)) for k, y in values.items() for j, x in enumerate(y)], "phenotype_id string, sample_id string, value double")
    pairs = spark.createDataFrame([(k, f"v{i}", i) for k in values for i in range(6)], "phenotype_id string, variant_id string, tss_distance long")
    groups = spark.createDataFrame([("a", "one"), ("b", "one")], "phenotype_id string, group_id string")
    found = mp.leads(calls, phenotypes, pairs, groups, threshold=0.01, permutations=400).collect()
    assert {r.variant_id for r in found} == {"v1", "v4"} and {r.group_size for r in found} == {2} and sorted(r["rank"] for r in found) == [1, 2]
