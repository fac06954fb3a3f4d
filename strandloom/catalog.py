"""All registered queries of the omics and network operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import association as qtl
from .operators import intervals as iv
from .operators import network as net
from .operators import reads as rd
from .plans import features, forests, further, graphs, locations, mapping, results, tables  # noqa: F401  (each registers its own)
from .plans.fragments import BLOCKS, CIS, DEGREES, DEPTH, IMPUTED, NOMINAL, PREPARED, SPANS, STATS, TPM, USABLE
from .plans.registry import ORACLE, QUERIES, query, rounded, single  # noqa: F401

FLAGSHIP = "q7_nominal"


# Intervals


@query("i2_tags", "genes", "SELECT gene_id, chrom || ':' || start_pos || '-' || end_pos AS tag, end_pos - start_pos AS len FROM genes")
def tags(genes):
    return genes.select("gene_id", iv.tag().alias("tag"), iv.length().alias("len"))


@query("i4_anchors", "genes", "SELECT gene_id, CAST(floor((start_pos + end_pos) / 2) AS BIGINT) AS mid, CASE WHEN strand = '+' THEN start_pos ELSE end_pos END AS tss, CASE WHEN strand = '-' THEN start_pos ELSE end_pos END AS tes FROM genes")
def anchors(genes):
    return iv.anchors(genes).select("gene_id", "mid", "tss", "tes")


@query("i5_tss_regions", "genes", "SELECT gene_id, chrom, CASE WHEN strand = '-' THEN end_pos - 1 ELSE start_pos END AS start_pos, CASE WHEN strand = '-' THEN end_pos ELSE start_pos + 1 END AS end_pos FROM genes")
def tss_regions(genes):
    return iv.tss_regions(genes).select("gene_id", "chrom", "start_pos", "end_pos")


@query("i6_widen", "peaks", "SELECT peak_id, chrom, start_pos - 100 AS start_pos, end_pos + 100 AS end_pos FROM peaks")
def widen(peaks):
    return iv.widen(peaks, 100)


@query("i8_transform", "genes", "SELECT gene_id, start_pos - 50 + s AS start_pos, end_pos + 50 + s AS end_pos FROM (SELECT *, CASE WHEN strand = '-' THEN -30 ELSE 30 END AS s FROM genes) q")
def transform(genes):
    return iv.transform(genes, 50, 30).select("gene_id", "start_pos", "end_pos")


@query("i12_in_interval", "peaks", "SELECT * FROM peaks WHERE chrom = 'chr7' AND end_pos > 100000 AND start_pos < 400000")
def in_interval(peaks):
    return iv.in_interval(peaks, "chr7", 100_000, 400_000)


@query("i13_overlapping", "genes peaks", "SELECT * FROM genes g WHERE EXISTS (SELECT 1 FROM peaks p WHERE p.chrom = g.chrom AND p.start_pos < g.end_pos AND g.start_pos < p.end_pos)")
def overlapping(genes, peaks):
    return iv.overlapping(genes, peaks)


@query("i14_overlaps", "tf_sites peaks", "SELECT tf, peak_id, least(t.end_pos, p.end_pos) - greatest(t.start_pos, p.start_pos) AS overlap FROM tf_sites t JOIN peaks p ON p.chrom = t.chrom AND p.start_pos < t.end_pos AND t.start_pos < p.end_pos")
def overlaps(tf_sites, peaks):
    return iv.overlaps(tf_sites, peaks, "tf", "peak_id")


@query("i16_adjacent", "peaks", "SELECT * FROM (SELECT peak_id, lead(peak_id, 2) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, peak_id) AS next FROM peaks) q WHERE next IS NOT NULL")
def adjacent(peaks):
    return iv.adjacent(peaks, "peak_id", 2)


@query("i18_nearest", "peaks", "SELECT *, CAST(floor((start_pos + end_pos) / 2) AS BIGINT) - 500000 AS distance FROM peaks WHERE chrom = 'chr3' ORDER BY abs(CAST(floor((start_pos + end_pos) / 2) AS BIGINT) - 500000), start_pos, end_pos LIMIT 10")
def nearest(peaks):
    return iv.nearest(peaks, "chr3", 500_000, 10)


@query("i20_previous", "genes peaks", "SELECT gene_id, (SELECT max_by(peak_id, (p.start_pos, p.peak_id)) FROM peaks p WHERE p.chrom = g.chrom AND p.start_pos < g.start_pos) AS peak_id FROM genes g")
def previous(genes, peaks):
    return iv.previous(genes, peaks, "gene_id", "peak_id")


@query("i21_clusters", "tf_sites", "SELECT tf, chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY tf, chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN max(end_pos) OVER (PARTITION BY tf, chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_pos THEN 0 ELSE 1 END AS fresh FROM (SELECT tf, chrom, start_pos, end_pos, count(*) AS n FROM tf_sites GROUP BY ALL) o) a) b GROUP BY tf, chrom, i")
def clusters(tf_sites):
    return iv.clusters(tf_sites, ["tf", "chrom"])


# Reads


@query("c1_usable_reads", "reads", f"SELECT * FROM {USABLE} u")
def usable(reads):
    return rd.usable(reads)


@query("c3_coverage", "reads genes", f"SELECT gene_id, sample_id, r.strand, sum(CASE WHEN r.start_pos >= g.start_pos AND r.end_pos <= g.end_pos THEN 1 ELSE 0 END)::BIGINT AS complete_overlap, sum(CASE WHEN r.start_pos >= g.start_pos AND r.end_pos <= g.end_pos THEN 0 ELSE 1 END)::BIGINT AS partial_overlap FROM {SPANS} r JOIN genes g ON g.chrom = r.chrom AND r.start_pos < g.end_pos AND g.start_pos < r.end_pos GROUP BY ALL")
def coverage(reads, genes):
    return rd.coverage(reads, genes, "gene_id")


@query("c4_binned", "reads", f"SELECT sample_id, strand, CAST(floor((p - 200000) / 5000) AS BIGINT) AS bin, count(*) AS n FROM (SELECT *, CASE WHEN strand = '+' THEN start_pos ELSE end_pos END AS p FROM {SPANS} r WHERE chrom = 'chr5') q WHERE p >= 200000 AND p < 600000 GROUP BY ALL")
def binned(reads):
    return rd.binned(reads, "chr5", 200_000, 600_000, 5000)


@query("c5_blocks", "reads", f"SELECT * FROM {BLOCKS} b")
def blocks(reads):
    return rd.blocks(reads)


@query("c6_pileup", "reads", DEPTH.format(BLOCKS))
def pileup(reads):
    return rd.pileup(rd.blocks(reads))


@query("c7_filled_pileup", "reads", DEPTH.format(SPANS))
def filled(reads):
    return rd.pileup(rd.spans(reads))


@query("a35_depth", "reads", "SELECT sample_id, count(*) / 1e6 AS depth FROM reads GROUP BY sample_id")
def depth(reads):
    return rd.depth_per_million(reads)


# Counts and association


@query("n1_tpm", "counts genes", f"SELECT gene_id, sample_id, round(tpm, 6) AS tpm FROM {TPM} t")
def tpm(counts, genes):
    return rounded(qtl.tpm(counts, genes), "tpm")


@query("n2_cpm_factors", "counts", "SELECT sample_id, sum(n) / 1e6 AS factor FROM counts GROUP BY sample_id")
def cpm(counts):
    return qtl.cpm_factors(counts)


@query("n7_expressed", "counts genes", f"SELECT gene_id, avg(CASE WHEN n >= 6 THEN 1 ELSE 0 END) >= 0.2 AND avg(CASE WHEN tpm >= 0.1 THEN 1 ELSE 0 END) >= 0.2 AS kept FROM {TPM} t GROUP BY gene_id")
def expressed(counts, genes):
    return qtl.expressed(counts, genes)


@query("a34_covariates", "people", "SELECT sample_id, CASE condition WHEN 'CASE' THEN 1 ELSE -1 END AS condition, CASE sex WHEN 'Female' THEN 1 ELSE -1 END AS sex FROM people")
def covariates(people):
    return people.select("sample_id", F.when(F.col("condition") == "CASE", 1).otherwise(-1).alias("condition"), F.when(F.col("sex") == "Female", 1).otherwise(-1).alias("sex"))


@query("e4_imputed", "genotypes", f"SELECT variant_id, sample_id, round(d, 6) AS dosage FROM {IMPUTED} g")
def imputed(genotypes):
    return rounded(qtl.imputed(genotypes), "dosage")


@query("e2_e8_allele_stats", "genotypes", f"SELECT variant_id, round(CASE WHEN af <= 0.5 THEN af ELSE 1 - af END, 6) AS maf, CASE WHEN af <= 0.5 THEN up ELSE down END AS ma_samples, round(CASE WHEN af <= 0.5 THEN c ELSE 2 * n - s END, 6) AS ma_count FROM (SELECT variant_id, sum(d) / (2 * count(*)) AS af, count(*) AS n, sum(d) AS s, count(*) FILTER (d > 0.5) AS up, count(*) FILTER (d < 1.5) AS down, coalesce(sum(d) FILTER (d > 0.5), 0) AS c FROM {IMPUTED} g GROUP BY variant_id) q")
def allele_stats(genotypes):
    return rounded(qtl.allele_stats(genotypes), "maf", "ma_count")


@query("q4_cis_pairs", "variants genes", f"SELECT * FROM {CIS} c")
def cis_pairs(variants, genes):
    return qtl.cis_pairs(variants, genes)


@query("q5_constant", "phenotypes", "SELECT phenotype_id FROM phenotypes GROUP BY phenotype_id HAVING min(value) = max(value)")
def constant(phenotypes):
    return qtl.constant(phenotypes)


@query("q7_nominal", "genotypes phenotypes variants genes", f"SELECT phenotype_id, variant_id, tss_distance, dof, {STATS} FROM {NOMINAL} n")
def nominal(genotypes, phenotypes, variants, genes):
    return qtl.cis_nominal(genotypes, phenotypes, variants.select("variant_id", "chrom", "pos"), genes.select("gene_id", "chrom", "start_pos"), digits=dict.fromkeys(["r2", "slope", "slope_se", "tstat"], 6)).withColumn("dof", F.col("dof").cast("long"))


@query("q11_strongest", "genotypes phenotypes variants genes", f"SELECT phenotype_id, round(max(r2), 6) AS r2, count(*) AS n FROM {NOMINAL} n GROUP BY phenotype_id")
def strongest(genotypes, phenotypes, variants, genes):
    best = (["phenotype_id"], "r2", "variant_id")
    found = qtl.cis_nominal(genotypes, phenotypes, variants.select("variant_id", "chrom", "pos"), genes.select("gene_id", "chrom", "start_pos"), names=["r2"], best=best)
    return rounded(found.select("phenotype_id", "r2", "n"), "r2")


@query("q29_adjusted", "pvals", "SELECT phenotype_id, pval_beta, round(least(min(pval_beta * m / r) OVER (ORDER BY pval_beta DESC), 1.0), 9) AS adjusted FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY pval_beta) AS r FROM pvals) q")
def adjusted(pvals):
    return rounded(qtl.benjamini_hochberg(pvals.select("phenotype_id", "pval_beta"), "phenotype_id", "pval_beta"), "adjusted", digits=9)


@query("q30_bonferroni", "pvals", "SELECT phenotype_id, round(least(pval_beta * count(*) OVER (), 1.0), 9) AS adjusted FROM pvals")
def bonferroni(pvals):
    m = pvals.agg(F.count("*")).scalar()
    return pvals.select("phenotype_id", F.round(F.least(F.col("pval_beta") * m, F.lit(1.0)), 9).alias("adjusted"))


@query("n5_average_ranks", "phenotypes", "SELECT phenotype_id, sample_id, rank() OVER (PARTITION BY phenotype_id ORDER BY value) + (count(*) OVER (PARTITION BY phenotype_id, value) - 1) / 2.0 AS rank, round((rank() OVER (PARTITION BY phenotype_id ORDER BY value) + (count(*) OVER (PARTITION BY phenotype_id, value) - 1) / 2.0) / (count(*) OVER (PARTITION BY phenotype_id) + 1), 9) AS u FROM phenotypes")
def average_ranks(phenotypes):
    return rounded(qtl.average_ranks(phenotypes, "phenotype_id", "value"), "u", digits=9).select("phenotype_id", "sample_id", "rank", "u")


@query("e17_sample_correlation", "phenotypes", "SELECT a.sample_id AS a, b.sample_id AS b, round(corr(a.value, b.value), 6) AS r FROM phenotypes a JOIN phenotypes b ON a.phenotype_id = b.phenotype_id AND a.sample_id < b.sample_id GROUP BY ALL")
def sample_correlation(phenotypes):
    return rounded(qtl.sample_correlation(phenotypes, "phenotype_id", "value"), "r")


@query("e1_residualised", "phenotypes samples", "SELECT phenotype_id, p.sample_id, round(value - s * c, 6) AS value FROM phenotypes p JOIN (SELECT sample_id, cov1 - avg(cov1) OVER () AS c FROM samples) x ON x.sample_id = p.sample_id JOIN (SELECT phenotype_id AS k, sum(value * c) / sum(c * c) AS s FROM phenotypes p JOIN (SELECT sample_id, cov1 - avg(cov1) OVER () AS c FROM samples) x ON x.sample_id = p.sample_id GROUP BY phenotype_id) q ON q.k = p.phenotype_id")
def residualised(phenotypes, samples):
    return rounded(qtl.residualised(phenotypes, samples, "phenotype_id", "value", "cov1"), "value")


@query("e16_group_t", "phenotypes samples", "SELECT phenotype_id, round((m1 - m0) / sqrt(p * (1.0 / n1 + 1.0 / n0)), 6) AS t FROM (SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS p FROM (SELECT phenotype_id, count(*) FILTER (condition = 'CASE') AS n1, count(*) FILTER (condition <> 'CASE') AS n0, avg(value) FILTER (condition = 'CASE') AS m1, avg(value) FILTER (condition <> 'CASE') AS m0, var_samp(value) FILTER (condition = 'CASE') AS v1, var_samp(value) FILTER (condition <> 'CASE') AS v0 FROM phenotypes p JOIN samples s ON s.sample_id = p.sample_id GROUP BY phenotype_id) a) b WHERE p > 0")
def group_t(phenotypes, samples):
    return rounded(qtl.group_t(phenotypes, samples, "phenotype_id", "value", "condition", "CASE"), "t")


@query("q15_q18_trans", "genotypes phenotypes variants genes", f"SELECT g.variant_id, p.phenotype_id, round(regr_r2(value, d), 6) AS r2 FROM {IMPUTED} g JOIN phenotypes p ON p.sample_id = g.sample_id JOIN variants v ON v.variant_id = g.variant_id JOIN genes t ON t.gene_id = p.phenotype_id WHERE NOT (v.chrom = t.chrom AND abs(v.pos - t.start_pos) <= 200000) GROUP BY ALL HAVING regr_r2(value, d) >= 0.5 AND min(value) < max(value)")
def trans(genotypes, phenotypes, variants, genes):
    return rounded(qtl.trans_pairs(genotypes, phenotypes, variants, genes, 0.5, 200_000), "r2")


@query("p11_info", "gene_terms", "SELECT evidence, count(*) AS rows, count(DISTINCT gene) AS genes, count(DISTINCT term_id) AS terms FROM gene_terms GROUP BY evidence")
def info(gene_terms):
    return gene_terms.groupBy("evidence").agg(F.count("*").alias("rows"), F.countDistinct("gene").alias("genes"), F.countDistinct("term_id").alias("terms"))


# Networks


@query("g2_degrees", "edges", f"SELECT * FROM {DEGREES} d")
def degrees(edges):
    return net.degrees(edges)


@query("g3_penalised", "edges", f"SELECT src, dst, cost, round(1000.0 * a.degree * b.degree / ((n - a.degree - 1) * (n - b.degree - 1) + a.degree * b.degree), 6) AS penalty, round(cost + 1000.0 * a.degree * b.degree / ((n - a.degree - 1) * (n - b.degree - 1) + a.degree * b.degree), 6) AS total FROM edges JOIN {DEGREES} a ON a.node = src JOIN {DEGREES} b ON b.node = dst, (SELECT count(*) AS n FROM {DEGREES} d) t")
def penalised(edges):
    return rounded(net.penalised(edges), "penalty", "total")


@query("g4_prizes", "edges prizes", f"SELECT * FROM {PREPARED} p")
def prepared(edges, prizes):
    return net.prepared_prizes(edges, prizes)


@query("g4_unknown_prizes", "edges prizes", "SELECT DISTINCT name AS node FROM prizes WHERE name NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def unknown(edges, prizes):
    return net.unknown_prizes(edges, prizes)


@query("g5_root_edges", "edges prizes", f"SELECT 'DUMMY' AS src, node AS dst, CAST(5.0 AS DOUBLE) AS cost FROM {PREPARED} p WHERE terminal")
def root_edges(edges, prizes):
    return net.root_edges(edges, prizes)


@query("g8_induced", "edges prizes", f"SELECT src, dst, cost FROM edges WHERE src IN (SELECT node FROM {PREPARED} p WHERE terminal) AND dst IN (SELECT node FROM {PREPARED} p WHERE terminal)")
def induced(edges, prizes):
    return net.induced(edges, net.prepared_prizes(edges, prizes).where("terminal"))


@query("g25_degree_by_type", "edges prizes", f"SELECT e.src AS node, type, count(*) AS degree FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) e JOIN {PREPARED} p ON p.node = e.dst GROUP BY e.src, type")
def degree_by_type(edges, prizes):
    return net.degree_by_type(edges, net.prepared_prizes(edges, prizes))


@query("term_depths", "terms", "SELECT * FROM (WITH RECURSIVE d AS (SELECT term_id, 0 AS depth FROM terms WHERE parent_id IS NULL UNION ALL SELECT t.term_id, d.depth + 1 FROM terms t JOIN d ON d.term_id = t.parent_id) SELECT * FROM d) q")
def term_depths(terms):
    return net.term_depths(terms)


@query("term_sizes", "gene_terms", "SELECT term_id, count(DISTINCT gene) AS genes FROM gene_terms WHERE evidence IN ('EXP', 'IDA', 'HTP') GROUP BY term_id")
def term_sizes(gene_terms):
    return net.term_sizes(gene_terms, ["EXP", "IDA", "HTP"])
