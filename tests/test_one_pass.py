"""Calls and terms are combined before they are shuffled, and passed over once."""

import random
from collections import defaultdict

import pytest

from strandloom.catalog import QUERIES
from strandloom.operators import graphs as gr
from strandloom.sources import formats as fm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 31, 70])
def test_lines_of_many_samples(spark, n):
    r, samples = random.Random(n), [f"S{k}" for k in range(n)]
    calls = {(v, s): r.choice([0, 1, 2, None, 7]) for v in range(12) for s in [*samples, "other"] if r.random() < 0.8}
    g = spark.createDataFrame([(f"rs{v}", s, d) for (v, s), d in calls.items()] + [("rs3", None, 1)], "variant_id string, sample_id string, dosage int")
    v = spark.createDataFrame([(f"rs{k}", "chr1", 90 - k, "A", "C") for k in range(12)], "variant_id string, chrom string, pos long, ref string, alt string")
    lines = [q.value for q in fm.vcf_lines(v, g, samples).collect()]
    assert lines[0].startswith("##") and lines[1].split("\t")[9:] == samples
    names = {0: "0/0", 1: "0/1", 2: "1/1"}
    want = [[names.get(calls.get((k, s)), "./.") for s in samples] for k in range(11, -1, -1) if any(c[0] == k for c in calls) or k == 3]
    assert [q.split("\t")[9:] for q in lines[2:]] == want
    assert "collect_list" not in fm.vcf_lines(v, g, samples)._jdf.queryExecution().optimizedPlan().toString()


def test_a_sample_twice_is_an_error(spark):
    g = spark.createDataFrame([("rs1", "S0", 1), ("rs1", "S0", 1)], "variant_id string, sample_id string, dosage int")
    v = spark.createDataFrame([("rs1", "chr1", 5, "A", "C")], "variant_id string, chrom string, pos long, ref string, alt string")
    with pytest.raises(Exception, match="a sample twice in rs1"):
        fm.vcf_lines(v, g, ["S0", "S1"]).collect()


@pytest.mark.parametrize("name", ["a1_vcf", "a33_passed"])
def test_calls_are_read_from_lines_once(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "Aggregate" not in text and "Sort" not in text


def test_second_level_of_terms_on_several_ways(spark):
    r = random.Random(5)
    rows = [(0, None)] + [(k, r.randrange(max(0, k // 4))) if k > 4 else (k, 0) for k in range(1, 60)] + [(9, 1), (9, 2), (33, 7), (50, 8)]
    terms = spark.createDataFrame(rows, "term_id long, parent_id long")
    found = [(f"G{r.randrange(9)}", r.randrange(64), r.randrange(1, 4)) for _ in range(400)] + [("only", 1, 3), (None, 20, 3)]
    ways, front = [], [(f, f, None) for f, p in rows if p == 0]
    while front:
        ways += front
        front = [(t, f, t if s is None else s) for up, f, s in front for t, p in rows if p == up]
    one, two = defaultdict(int), defaultdict(int)
    for gene, term, score in found:
        for t, f, s in ways:
            if t == term and gene:
                one[gene, f] += score
                two[gene, f, s] += score
    want = set()
    for gene in {k[0] for k in one}:
        f = min((-v, k[1]) for k, v in one.items() if k[0] == gene)[1]
        own = sorted((-v, k[2]) for k, v in two.items() if k[:2] == (gene, f) and k[2] is not None)
        want |= {(gene, f, own[0][1], -own[0][0])} if own else set()
    scored = spark.createDataFrame(found, "gene string, term_id long, score int")
    places = gr.two_levels(terms, terms.where("parent_id = 0"))
    assert {tuple(q) for q in gr.best_second(scored, places).collect()} == want and len(want) > 5


def test_terms_are_passed_over_once(spark):
    text = QUERIES["o5_second_level"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1
