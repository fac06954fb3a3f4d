"""Queries of graphs, ontologies, clusters and lookups, each with its SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as gr
from ..operators import intervals as iv
from .fragments import DEGREES
from .registry import query, rounded

STEPS = "(SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
REACH = f"(WITH RECURSIVE r AS (SELECT src AS node, src AS other FROM {STEPS} s UNION SELECT r.node, s.dst FROM r JOIN {STEPS} s ON s.src = r.other) SELECT node, min(other) AS component FROM r GROUP BY node)"
TIER = "CASE WHEN evidence IN ('EXP', 'IDA', 'HTP') THEN 3 WHEN evidence IN ('IC', 'ISS', 'TAS') THEN 2 ELSE 1 END"
SOLID, SKETCHY = ["EXP", "IDA", "HTP"], ["IC", "ISS", "TAS"]
TOPS = "(WITH RECURSIVE t AS (SELECT term_id, term_id AS top FROM terms WHERE parent_id = (SELECT min(term_id) FROM terms) UNION ALL SELECT x.term_id, t.top FROM terms x JOIN t ON t.term_id = x.parent_id) SELECT * FROM t)"
TRIANGLES = f"(SELECT p.src AS a, p.dst AS b, q.dst AS c FROM {STEPS} p JOIN {STEPS} q ON q.src = p.dst JOIN {STEPS} r ON r.src = p.src AND r.dst = q.dst WHERE p.src < p.dst AND p.dst < q.dst)"


@query("g14_components", "edges", f"SELECT * FROM {REACH} r")
def components(edges):
    return gr.components(edges)


@query("g14_of_size", "edges", f"SELECT node, component FROM {REACH} r WHERE component IN (SELECT component FROM {REACH} s GROUP BY component HAVING count(*) >= 5)")
def of_size(edges):
    return gr.of_size(edges, 5)


@query("g31_distances", "edges", f"SELECT source, node, min(dist)::INTEGER AS dist FROM (WITH RECURSIVE b AS (SELECT node AS source, node, 0 AS dist FROM (SELECT node FROM {DEGREES} d ORDER BY degree DESC, node LIMIT 5) h UNION SELECT source, s.dst, dist + 1 FROM b JOIN {STEPS} s ON s.src = b.node WHERE dist < 30) SELECT * FROM b) q GROUP BY source, node")
def distances(edges):
    from ..operators.network import degrees

    return gr.distances(edges, degrees(edges).orderBy(F.desc("degree"), "node").limit(5).select("node"))


@query("g19_triangles", "edges", f"SELECT * FROM {TRIANGLES} t")
def triangles(edges):
    return gr.triangles(edges)


STRONG = "(SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE cost < 0.7 AND src <> dst)"


@query("g19_cliques", "edges", f"SELECT x.u AS a, x.v AS b, y.v AS c, z.v AS d FROM {STRONG} x JOIN {STRONG} y ON y.u = x.v JOIN {STRONG} xy ON xy.u = x.u AND xy.v = y.v JOIN {STRONG} z ON z.u = y.v JOIN {STRONG} xz ON xz.u = x.u AND xz.v = z.v JOIN {STRONG} yz ON yz.u = x.v AND yz.v = z.v")
def cliques(edges):
    """All sets of four nodes with links of a cost under 0.7."""
    return gr.cliques(edges.where("cost < 0.7"), 4).select(*(F.col("nodes")[i].alias(c) for i, c in enumerate("abcd")))


@query("g19_communities_of_four", "edges", None)
def communities_of_four(edges):
    return gr.clique_labels(edges.where("cost < 0.7"), 4)


@query("g19_communities", "edges", None)
def communities(edges):
    return gr.clique_communities(edges)


NOISY = "(SELECT DISTINCT gene_id AS node, sample_id AS run FROM counts WHERE n > 30)"


@query("g12_g13_randomised", "counts", f"SELECT node, round(coalesce(robustness, 0), 6) AS robustness, round(coalesce(specificity, 0), 6) AS specificity FROM (SELECT node, count(*) / 25.0 AS robustness FROM {NOISY} a GROUP BY node) x FULL JOIN (SELECT gene_id AS node, count(*) / 25.0 AS specificity FROM counts WHERE n % 3 = 1 GROUP BY gene_id) y USING (node)")
def randomised(counts):
    runs = counts.select(F.col("gene_id").alias("node"), F.col("sample_id").alias("run"), "n")
    return rounded(gr.randomised(runs.where("n > 30"), runs.where("n % 3 = 1"), 25, 25), "robustness", "specificity")


@query("g16_run_statistics", "counts edges", f"SELECT run, size, round(l, 6) AS mean_log_degree, round(ks, 6) AS ks FROM (SELECT run, max(abs(c / s - f)) AS ks, max(s)::BIGINT AS size, max(l) AS l FROM (SELECT run, degree, f, count(node) * 1.0 AS k, sum(count(node)) OVER (PARTITION BY run ORDER BY degree) AS c, sum(count(node)) OVER (PARTITION BY run) AS s, sum(count(node) * log2(degree)) OVER (PARTITION BY run) / sum(count(node)) OVER (PARTITION BY run) AS l FROM (SELECT * FROM (SELECT degree, sum(count(*)) OVER (ORDER BY degree) / sum(count(*)) OVER () AS f FROM {DEGREES} d GROUP BY degree) w, (SELECT DISTINCT run FROM {NOISY} a WHERE node IN (SELECT src FROM edges UNION SELECT dst FROM edges)) r) g LEFT JOIN (SELECT node, run, degree FROM {NOISY} a JOIN {DEGREES} d USING (node)) o USING (run, degree) GROUP BY run, degree, f) q GROUP BY run) z")
def run_statistics(counts, edges):
    runs = counts.where("n > 30").select(F.col("gene_id").alias("node"), F.col("sample_id").alias("run"))
    return rounded(gr.run_statistics(runs, edges), "mean_log_degree", "ks")


@query("g28_artificial_prizes", "counts prizes", f"SELECT name, round(prize, 6) AS prize FROM (SELECT name, max(prize) AS prize FROM prizes GROUP BY name UNION ALL SELECT node, power(0.8 * count(*) / 25.0, 2) FROM {NOISY} a WHERE node NOT IN (SELECT name FROM prizes) GROUP BY node) q")
def artificial_prizes(counts, prizes):
    runs = counts.where("n > 30").select(F.col("gene_id").alias("node"), F.col("sample_id").alias("run"))
    return rounded(gr.artificial_prizes(prizes, gr.frequencies(runs, 25, "frequency"), 0.8), "prize")


# Ontology


@query("o1_tiers", "gene_terms", f"SELECT {TIER} AS score, count(*) AS n FROM gene_terms GROUP BY 1")
def tiers(gene_terms):
    return gr.tiers(gene_terms, SOLID, SKETCHY).groupBy("score").agg(F.count("*").alias("n"))


def first_level(terms):
    root = terms.agg(F.min("term_id").alias("_r"))
    return terms.join(F.broadcast(root), F.col("parent_id") == F.col("_r"))


@query("o2_top_terms", "terms", f"SELECT * FROM {TOPS} t")
def top_terms(terms):
    return gr.top_terms(terms, first_level(terms))


@query("o4_best_terms", "terms gene_terms", f"SELECT gene, term, score, regexp_replace(name, ' activity$', '') AS name FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, term) AS i FROM (SELECT gene, top AS term, sum({TIER})::BIGINT AS score FROM gene_terms g JOIN {TOPS} t ON t.term_id = g.term_id GROUP BY gene, top) s) r JOIN terms n ON n.term_id = r.term WHERE i = 1")
def best_terms(terms, gene_terms):
    best = gr.best_term(gr.tiers(gene_terms, SOLID, SKETCHY), gr.top_terms(terms, first_level(terms)))
    names = terms.select(F.col("term_id").alias("term"), F.regexp_replace("name", " activity$", "").alias("name"))
    return best.join(names, "term").select("gene", "term", "score", "name")


@query("o3_genes_per_top_term", "terms gene_terms", f"SELECT top AS term, count(DISTINCT gene) AS genes, count(*) AS rows FROM gene_terms g JOIN {TOPS} t ON t.term_id = g.term_id GROUP BY top")
def genes_per_top_term(terms, gene_terms):
    both = gene_terms.join(gr.top_terms(terms, first_level(terms)), "term_id")
    return both.groupBy(F.col("top").alias("term")).agg(F.countDistinct("gene").alias("genes"), F.count("*").alias("rows"))


@query("k1_k_modes", "peaks tf_sites", None)
def k_modes(peaks, tf_sites):
    names = [f"TF{k}" for k in range(10)]
    n = iv.feature_counts(peaks, tf_sites, "peak_id", "tf", names)
    return gr.k_modes(n.select("peak_id", *((F.col(c) > 0).alias(c) for c in names)), "peak_id", names, 4)


# Lookups


@query("p1_interval", "variants", "SELECT * FROM variants WHERE chrom = 'chr2' AND pos BETWEEN 100000 AND 700000")
def in_interval(variants):
    return variants.where((F.col("chrom") == "chr2") & F.col("pos").between(100_000, 700_000))


@query("p12_mask", "counts phenotypes", "SELECT DISTINCT gene_id, gene_id IN (SELECT phenotype_id FROM phenotypes WHERE value > 10) AS kept FROM counts")
def mask(counts, phenotypes):
    own = phenotypes.where("value > 10").select(F.col("phenotype_id").alias("gene_id"), F.lit(True).alias("_k")).distinct()
    return counts.select("gene_id").distinct().join(own, "gene_id", "left").select("gene_id", F.coalesce("_k", F.lit(False)).alias("kept"))


@query("p15_least_by_order", "pvals", "SELECT bin, phenotype_id, round(-log10(pval_beta), 6) AS score FROM (SELECT *, CAST(substr(phenotype_id, 2) AS BIGINT) % 100 AS bin, row_number() OVER (PARTITION BY CAST(substr(phenotype_id, 2) AS BIGINT) % 100 ORDER BY pval_beta, phenotype_id) AS i FROM pvals) q WHERE i = 1")
def least_by_order(pvals):
    bins = pvals.withColumn("bin", F.substring("phenotype_id", 2, 20).cast("long") % 100)
    w = Window.partitionBy("bin").orderBy("pval_beta", "phenotype_id")
    return bins.withColumn("_i", F.row_number().over(w)).where("_i = 1").select("bin", "phenotype_id", F.round(-F.log10("pval_beta"), 6).alias("score"))
