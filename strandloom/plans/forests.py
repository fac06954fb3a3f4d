"""Queries of prize-collecting forests, node sets and sweeps, each with its SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import betweenness as bt
from ..operators import clusters as cl
from ..operators import forest as fo
from ..operators import graphs as gr
from ..operators.network import ends, prepared_prizes
from .graphs import NOISY, REACH
from .registry import query, rounded

W, B = 1.0, 1.0
SAMPLES = [f"S{k}" for k in range(25)]


def weighted(edges, prizes):
    return prepared_prizes(edges, prizes, B).where("prize > 0").select("node", "prize", F.lit(W).alias("w"))


def noisy_runs(counts):
    return counts.where("n > 30").select(F.col("gene_id").alias("node"), F.col("sample_id").alias("run")).distinct()


@query("g6_checks", "edges prizes", """SELECT * FROM (SELECT 'edge without node' AS problem, count(*) FILTER (src IS NULL OR dst IS NULL) AS "rows" FROM edges UNION ALL SELECT 'edge without cost', count(*) FILTER (cost IS NULL) FROM edges UNION ALL SELECT 'negative cost', count(*) FILTER (cost < 0) FROM edges UNION ALL SELECT 'edge to itself', count(*) FILTER (src = dst) FROM edges
UNION ALL SELECT 'node without prize', count(*) FILTER (prize IS NULL) FROM prizes UNION ALL SELECT 'negative prize', count(*) FILTER (prize < 0) FROM prizes UNION ALL SELECT 'repeated edge', (count(*) - count(DISTINCT least(src, dst) || ' ' || greatest(src, dst)))::BIGINT FROM edges UNION ALL SELECT 'prize without node', count(DISTINCT name) FILTER (name NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) FROM prizes) q""")
def checks(edges, prizes):
    return fo.checks(edges, prizes)


@query("g7_forest", "edges prizes", None)
def forest(edges, prizes):
    nodes, _ = fo.forest(edges, weighted(edges, prizes))
    return nodes


@query("g8_augmented", "edges prizes", None)
def augmented(edges, prizes):
    return fo.augmented(edges, *fo.forest(edges, weighted(edges, prizes)))


@query("g9_objective", "edges prizes", None)
def objective(edges, prizes):
    own = weighted(edges, prizes)
    return fo.objective(own, *fo.forest(edges, own), W)


@query("g10_noisy", "edges", None)
def noisy(edges):
    return fo.noisy(edges, 0.1, 0)


@query("g11_moved_terminals", "edges prizes", None)
def moved_terminals(edges, prizes):
    return fo.moved_terminals(edges, prepared_prizes(edges, prizes).select("node", "prize"), 0)


@query("g15_sweep", "edges prizes", None)
def sweep(edges, prizes):
    return fo.sweep(edges, prizes, [W], [B, 2.0], [0.0], noisy_runs=2, random_runs=2)


@query("g22_summary", "counts", f"""SELECT * FROM (SELECT node, {", ".join(f"(count(*) FILTER (run = '{s}'))::DOUBLE AS {s}" for s in SAMPLES)} FROM {NOISY} a GROUP BY node) w
WHERE {" + ".join(SAMPLES)} > coalesce((SELECT t FROM (SELECT count(*) AS t FROM {NOISY} b GROUP BY node ORDER BY t DESC OFFSET 20 LIMIT 1) l), -1)""")
def summary(counts):
    return fo.summary(noisy_runs(counts).withColumn("value", F.lit(1.0)), SAMPLES, 20)


@query("g23_robust_subgraph", "counts edges", None)
def robust_subgraph(counts, edges):
    held = noisy_runs(counts).groupBy("node").agg((F.count("*") / 25).alias("robustness")).withColumn("specificity", F.lit(0.0))
    nodes = held.join(ends(edges).distinct(), "node", "left_semi")
    return fo.robust_subgraph(edges, nodes, 100, 3)


LINKAGE = "(SELECT m + p_ord - lo AS id, 2 * (p_ord - lo) AS l, 2 * (p_ord - lo) + 1 AS r FROM people, (SELECT count(*) AS m, min(p_ord) AS lo FROM people) t WHERE p_ord - lo < m - 1)"


@query("g27_clades", "people", f"SELECT clade, sample FROM (WITH RECURSIVE k AS (SELECT count(*) AS m FROM people), c AS (SELECT id AS clade, l AS member FROM {LINKAGE} a UNION ALL SELECT id, r FROM {LINKAGE} a UNION ALL SELECT c.clade, unnest([l, r]) FROM c JOIN {LINKAGE} b ON b.id = c.member) SELECT clade, member AS sample FROM c, k WHERE member < m) q")
def clades(people):
    m, lo = people.agg(F.count("*"), F.min("p_ord")).first()
    s = F.col("p_ord") - (lo or 0)
    return fo.clades(people.where(s < m - 1).select((m + s).alias("id"), (2 * s).alias("left"), (2 * s + 1).alias("right")))


INNER = REACH.replace("SELECT src, dst FROM edges", "SELECT src, dst FROM held").replace("SELECT dst, src FROM edges", "SELECT dst, src FROM held")


@query("g29_with_originals", "edges prizes", f"SELECT * FROM (WITH held AS (SELECT src, dst FROM edges WHERE cost < 0.8) SELECT node, component FROM {INNER} c WHERE component IN (SELECT component FROM {INNER} d WHERE node IN (SELECT name FROM prizes WHERE type = 'TF'))) q")
def with_originals(edges, prizes):
    near = gr.kept(edges.where("cost < 0.8"), "near")
    return fo.with_originals(near, ends(near), prizes.where("type = 'TF'").select(F.col("name").alias("node")))


@query("g32_set_distances", "counts edges", None)
def set_distances(counts, edges):
    return rounded(fo.set_distances(edges, noisy_runs(counts).select(F.col("run").alias("name"), "node").join(ends(edges).distinct(), "node", "left_semi")), "mean", "distance")


@query("g17_betweenness", "edges", None)
def betweenness(edges):
    return rounded(bt.betweenness(edges), "betweenness")


@query("g17_sampled", "edges", None)
def sampled_betweenness(edges):
    return bt.sampled_betweenness(edges, 0.1)


@query("g18_communities", "edges", None)
def communities(edges):
    return cl.communities(edges)


@query("g20_power_clusters", "edges", None)
def power_clusters(edges):
    return cl.power_clusters(edges, 4)
