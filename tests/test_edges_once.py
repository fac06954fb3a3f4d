"""Queries of edges derive them once, and shuffles that hold all of them grow in parts with the rows."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import forest as fo
from strandloom.operators import graphs as gr
from strandloom.operators import network as net
from strandloom.sources import views
from strandloom.sources.tables import dealt

PAIRS = [("a", "b", 0.5), ("b", "c", 1.0), ("c", "a", 0.7), ("d", "e", 0.2), ("b", "a", 0.5), ("f", "f", 0.1)]
PRIZES = [("a", 1.0, "TF"), ("a", 2.0, "protein"), ("d", 0.5, "TF"), ("x", 3.0, "TF")]
STEPS = {
    "penalised": lambda e, p: net.penalised(e),
    "node_table": lambda e, p: net.node_table(e, p),
    "checks": lambda e, p: fo.checks(e, p),
    "of_size": lambda e, p: gr.of_size(e, 3),
    "robust": lambda e, p: gr.robust_statistics(p.select(F.lit("r").alias("run"), F.col("name").alias("node"), F.lit(0.5).alias("robustness"), F.lit(0.1).alias("specificity")), e),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_the_edges_are_made_once(spark, name):
    made = spark.sparkContext.accumulator(0)

    def seen(row):
        made.add(1)
        return row

    edges = spark.sparkContext.parallelize(PAIRS, 2).map(seen).toDF("src string, dst string, cost double")
    assert STEPS[name](edges, spark.createDataFrame(PRIZES, "name string, prize double, type string")).collect()
    assert made.value == len(PAIRS)


def test_components_of_repeated_and_own_edges(spark):
    edges = spark.createDataFrame([*((a, b) for a, b, _ in PAIRS), ("g", None)], "src string, dst string")
    got = {tuple(r) for r in gr.components(edges.where("dst IS NOT NULL")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}
    assert {r.node for r in gr.of_size(edges, 3).collect()} == {"a", "b", "c"}


def test_parts_grow_with_the_rows(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    assert dealt(rows, 3_000_000, "k").rdd.getNumPartitions() <= 8
    assert dealt(rows, 30_000_000, "k").rdd.getNumPartitions() == 60


def test_names_of_edges_are_not_shuffled(spark):
    plan = views.view(spark, "/root/testdata/sf0.001", "edges")._jdf.queryExecution().executedPlan().toString()
    assert "concat" not in plan[plan.index("Exchange") :]
