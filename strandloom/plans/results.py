"""Queries of result tables, correlations, annotated regions, filled coverage, tracks and networks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as qtl
from ..operators import intervals as iv
from ..operators import mapping as mp
from ..operators import network as net
from ..operators import normalise as nm
from ..operators import reads as rd
from ..operators import results as rs
from ..operators import tiles
from ..operators import tracks as tr
from ..sources import tables as tb
from .fragments import BLOCKS, DEGREES, IMPUTED, NOMINAL, PREPARED, SPANS, STATS
from .mapping import MAF, SERIES_21, tail
from .registry import query, rounded, single, single_sql

# Results


@query("p5_selected", "genotypes phenotypes variants genes", f"SELECT phenotype_id, variant_id, {STATS} FROM {NOMINAL} n WHERE phenotype_id IN ('G3', 'G17', 'G40') OR variant_id IN ('rs5', 'rs17')")
def selected(genotypes, phenotypes, variants, genes):
    found = qtl.nominal(genotypes, phenotypes, qtl.cis_pairs(variants, genes))
    got = rs.select(found, ["G3", "rs5", "G17", "rs17", "G40"], {"G": "phenotype_id", "rs": "variant_id"})
    return rounded(single(got, "slope"), "r2", "slope_se", "tstat").drop("tss_distance", "dof")


@query("p7_by_distance", "variants genes", "SELECT gene_id AS phenotype_id, variant_id, pos - start_pos AS tss_distance FROM genes g JOIN variants v ON v.chrom = g.chrom AND abs(v.pos - g.start_pos) <= 50000")
def by_distance(variants, genes):
    return tiles.by_distance(variants, genes)


@query("q10_one_phenotype", "genotypes phenotypes", f"SELECT phenotype_id, g.variant_id, round(regr_r2(value, d), 6) AS r2, round(CAST(CAST(regr_slope(value, d) AS FLOAT) AS DOUBLE), 6) + 0.0 AS slope FROM {IMPUTED} g JOIN phenotypes p ON p.sample_id = g.sample_id WHERE phenotype_id = 'G7' GROUP BY phenotype_id, g.variant_id HAVING min(d) < max(d)")
def one_phenotype(genotypes, phenotypes):
    found = rs.of_phenotype(genotypes, phenotypes.where("phenotype_id = 'G7'"))
    return rounded(single(found, "slope"), "r2").select("phenotype_id", "variant_id", "r2", "slope")


COLUMNS = "round(r, 6) + 0.0 AS r, round(r * r, 6) AS r2, {slope}, round(slope / nullif(r * sqrt(dof / (1 - r * r)), 0), 6) AS slope_se, round(r * sqrt(dof / (1 - r * r)), 6) + 0.0 AS tstat, round(p, 6) AS pval".format(slope=single_sql("slope") + " AS slope")
PAIRWISE = f"(SELECT g.variant_id, p.phenotype_id, 23 AS dof, corr(value, d) AS r, regr_slope(value, d) AS slope FROM {IMPUTED} g JOIN phenotypes p ON p.sample_id = g.sample_id GROUP BY ALL HAVING min(d) < max(d) AND min(value) < max(value))"


@query("q1_q16_pairwise", "genotypes phenotypes", f"SELECT variant_id, phenotype_id, 25 AS n, {COLUMNS} FROM {tail(PAIRWISE)} t")
def pairwise(genotypes, phenotypes):
    return rounded(single(rs.pairwise(genotypes, phenotypes), "slope"), "r", "r2", "slope_se", "tstat", "pval").withColumns({c: F.col(c) + 0.0 for c in ("r", "tstat")})


# what two covariates leave: less the first, then less what the first leaves of the second
BESIDE = "(SELECT sample_id AS sid, c, s - c * (sum(c * s) OVER () / sum(c * c) OVER ()) AS s FROM (SELECT sample_id, cov1 - avg(cov1) OVER () AS c, (s_ord % 3) - avg(s_ord % 3) OVER () AS s FROM samples) x)"


def left(rows: str, key: str, value: str) -> str:
    return f"(SELECT {key}, sample_id, y - c * (sum(y * c) OVER w / sum(c * c) OVER w) - s * (sum(y * s) OVER w / sum(s * s) OVER w) AS y, y AS given FROM (SELECT {key}, sample_id, c, s, {value} - avg({value}) OVER (PARTITION BY {key}) AS y FROM {rows} r JOIN {BESIDE} b ON sid = r.sample_id) q WINDOW w AS (PARTITION BY {key}))"


@query("q1_covariates", "genotypes phenotypes samples", f"SELECT variant_id, phenotype_id, n, {COLUMNS}, round(maf, 6) AS maf, ma_samples, round(ma_count, 6) AS ma_count, round(var_g, 6) AS var_g, round(var_p, 6) AS var_p FROM (SELECT *, 1 - 2 / pi() * (th + si * ({SERIES_21})) AS p FROM (SELECT *, sin(th) AS si, cos(th) AS co FROM (SELECT *, atan(abs(r) / sqrt(greatest(1 - r * r, 1e-300))) AS th FROM (SELECT g.variant_id, p.phenotype_id, count(*) AS n, 21 AS dof, corr(p.y, g.y) AS r, regr_slope(p.y, g.y) AS slope, var_samp(g.y) AS var_g, var_samp(p.y) AS var_p FROM {left(IMPUTED, 'variant_id', 'd')} g JOIN {left('phenotypes', 'phenotype_id', 'value')} p ON p.sample_id = g.sample_id GROUP BY ALL HAVING min(g.given) < max(g.given) AND min(p.given) < max(p.given)) a) b) c) t JOIN {MAF} m USING (variant_id) WHERE abs(r) > 0.7")
def with_covariates(genotypes, phenotypes, samples):
    """Pairs beside two covariates, those of |r| over 0.7."""
    found = rs.pairwise(genotypes, phenotypes, samples.select("sample_id", "cov1", (F.col("s_ord") % 3).alias("third")), maf=True, variances=True, most_p=0.001)
    found = rounded(single(found.where("abs(r) > 0.7"), "slope"), "r", "r2", "slope_se", "tstat", "pval", "maf", "ma_count", "var_g", "var_p")
    return found.withColumns({c: F.col(c) + 0.0 for c in ("r", "tstat")})


@query("e3_interaction_maf", "genotypes samples", f"SELECT variant_id FROM (SELECT variant_id, avg(d) FILTER (up) / 2 AS a, avg(d) FILTER (NOT up) / 2 AS b, min(d) AS lo, max(d) AS hi FROM {IMPUTED} g JOIN (SELECT sample_id AS sid, cov1 > avg(cov1) OVER () AS up FROM samples) s ON sid = g.sample_id GROUP BY variant_id) q WHERE least(a, 1 - a) >= 0.3 - 1e-7 AND least(b, 1 - b) >= 0.3 - 1e-7 AND lo < hi")
def interaction_maf(genotypes, samples):
    return rs.interaction_maf(genotypes, samples, "cov1", 0.3)


@query("e12_by_pairs", "phenotypes counts edges", "SELECT src, dst, count(*) AS n, round(corr(value, c.n), 6) + 0.0 AS r FROM edges JOIN phenotypes p ON p.phenotype_id = src JOIN counts c ON c.gene_id = dst AND c.sample_id = p.sample_id GROUP BY src, dst HAVING min(value) < max(value) AND min(c.n) < max(c.n)")
def by_pairs(phenotypes, counts, edges):
    found = rs.correlation_by_pairs(phenotypes.withColumnRenamed("phenotype_id", "src"), counts.select(F.col("gene_id").alias("dst"), "sample_id", F.col("n").alias("value")), edges.select("src", "dst"), "src", "dst", "value", tested=False)
    return found.select("src", "dst", "n", (F.round("r", 6) + 0.0).alias("r"))


FLAGS = "(SELECT strand = '+' AS plus, end_pos - start_pos > 600 AS long, start_pos < 500000 AS left_half, chrom IN ('chr1', 'chr2', 'chr3') AS early FROM genes)"
FOUR = " UNION ALL ".join(f"SELECT '{a}' AS one, '{b}' AS other, count(*) FILTER ({a} AND {b}) AS w, count(*) FILTER ({a} AND NOT {b}) AS x, count(*) FILTER (NOT {a} AND {b}) AS y, count(*) FILTER (NOT {a} AND NOT {b}) AS z FROM {FLAGS} q" for a in ("plus", "long") for b in ("left_half", "early"))


@query("e15_pairwise_fisher", "genes", f"""SELECT one, other, w AS "both", x AS only_one, y AS only_other, z AS neither, round(w * z / nullif(x * y, 0), 6) AS odds, round(least(1.0, sum(p) FILTER (p <= p0 * (1 + 1e-7)) / sum(p)), 6) AS pval FROM (SELECT *, exp(l - max(l) OVER v) AS p, exp(max(l) FILTER (k = w) OVER v - max(l) OVER v) AS p0 FROM (
SELECT *, lgamma(w + x + 1) - lgamma(k + 1) - lgamma(w + x - k + 1) + lgamma(y + z + 1) - lgamma(w + y - k + 1) - lgamma(y + z - (w + y - k) + 1) AS l FROM (SELECT *, unnest(range(greatest(0, w - z), least(w + x, w + y) + 1)) AS k FROM ({FOUR}) t) s) r WINDOW v AS (PARTITION BY one, other)) q GROUP BY one, other, w, x, y, z""")
def pairwise_fisher(genes):
    flags = genes.select((F.col("strand") == "+").alias("plus"), (F.col("end_pos") - F.col("start_pos") > 600).alias("long"), (F.col("start_pos") < 500_000).alias("left_half"), F.col("chrom").isin("chr1", "chr2", "chr3").alias("early"))
    return rounded(rs.pairwise_fisher(flags, ["plus", "long"], ["left_half", "early"]), "odds", "pval")


@query("q20_applied", "genotypes phenotypes samples variants genes", None)
def applied(genotypes, phenotypes, samples, variants, genes):
    found = qtl.trans_pairs(genotypes, phenotypes, variants, genes, 0.5, chrom=True).select("phenotype_id", "variant_id", "r2", "chrom")
    return rs.applied(found, mp.permutation_maxima(genotypes, samples, variants, 10_000), samples.count() - 2)


@query("q23_q31_united", "pvals", "SELECT phenotype_id, chrom, round(pval_beta, 9) AS pval_beta FROM (SELECT *, 'chr' || CAST(CAST(substr(phenotype_id, 2) AS BIGINT) % 22 + 1 AS STRING) AS chrom FROM pvals) q")
def united(pvals):
    spark = pvals.sparkSession
    own = pvals.withColumn("chrom", F.concat(F.lit("chr"), (F.substring("phenotype_id", 2, 20).cast("long") % 22 + 1).cast("string")))
    got = mp.thresholds(tb.read_by_chromosome(spark, tb.write_by_chromosome(own, tb.scratch(spark, "cis"))))
    return got.select("phenotype_id", "chrom", F.round("pval_beta", 9).alias("pval_beta"))


@query("n8_masked_scores", "counts genes", None)
def masked_scores(counts, genes):
    kept = qtl.expressed(counts, genes).where("kept").select("gene_id")
    factors = nm.tmm_factors(counts).join(qtl.cpm_factors(counts).withColumnRenamed("factor", "depth"), "sample_id")
    value = counts.join(kept, "gene_id", "left_semi").join(factors, "sample_id").withColumn("value", F.col("n") / (F.col("factor") * F.col("depth")))
    return rounded(nm.normal_scores(value, "gene_id", "value"), "score").select("gene_id", "sample_id", "score")


# Regions


@query("i3_validated", "genes", "SELECT gene_id, chrom, start_pos, end_pos FROM genes")
def validated(genes):
    return iv.validated(genes.withColumn("chrom", iv.prefixed(F.col("chrom"), False))).select("gene_id", "chrom", "start_pos", "end_pos")


ANCHORS = {"start": ("start_pos", 1), "end": ("end_pos - 1", 1), "mid": ("CAST(floor((start_pos + end_pos) / 2) AS BIGINT)", 0), "tss": ("CASE strand WHEN '-' THEN end_pos - 1 ELSE start_pos END", 1), "tes": ("CASE strand WHEN '-' THEN start_pos ELSE end_pos - 1 END", 1)}


@query("i5_i9_anchor_regions", "genes", " UNION ALL ".join(f"SELECT gene_id, '{a}' AS anchor, chrom, {at} AS start_pos, {at} + {n} AS end_pos FROM genes" for a, (at, n) in ANCHORS.items()))
def anchor_regions(genes):
    parts = [iv.unstranded(iv.anchor_regions(genes, a)).select("gene_id", F.lit(a).alias("anchor"), "chrom", "start_pos", "end_pos") for a in ANCHORS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FEATURES = "(SELECT chrom, CASE strand WHEN '-' THEN end_pos - 1 ELSE start_pos END - 1000 AS start_pos, CASE strand WHEN '-' THEN end_pos - 1 ELSE start_pos END + 1001 AS end_pos, 'tss' AS feature FROM genes UNION ALL SELECT chrom, CASE strand WHEN '-' THEN start_pos ELSE end_pos - 1 END - 1000, CASE strand WHEN '-' THEN start_pos ELSE end_pos - 1 END + 1001, 'tes' FROM genes UNION ALL SELECT chrom, start_pos, start_pos + 40, 'exon' FROM genes UNION ALL SELECT chrom, start_pos + 60, end_pos, 'exon' FROM genes UNION ALL SELECT chrom, start_pos + 40, start_pos + 60, 'intron' FROM genes)"


@query("i22_annotations", "peaks genes", f"SELECT *, CASE WHEN tss + tes + exon + intron = 0 THEN 1 ELSE 0 END AS intergenic, CASE WHEN tss > 0 AND tes = 0 THEN 'tss' WHEN tes > 0 AND tss = 0 THEN 'tes' WHEN tss > 0 THEN 'tss_tes' WHEN exon > 0 THEN 'exon' WHEN intron > 0 THEN 'intron' ELSE 'intergenic' END AS label FROM (SELECT p.peak_id, " + ", ".join(f"count(*) FILTER (f.feature = '{k}') AS {k}" for k in ("tss", "tes", "exon", "intron")) + f" FROM peaks p LEFT JOIN {FEATURES} f ON f.chrom = p.chrom AND f.start_pos < p.end_pos AND p.start_pos < f.end_pos GROUP BY p.peak_id) q")
def annotations(peaks, genes):
    from ..sources import formats as fm
    from .features import gtf_lines

    return iv.annotations(peaks, fm.gene_features(fm.read_gtf(gtf_lines(genes))), "peak_id")


@query("i23_unversioned", "genes", "SELECT gene_id, chrom FROM genes")
def unversioned(genes):
    return genes.select(iv.unversioned(F.concat("gene_id", F.lit("."), F.col("start_pos") % 7, F.lit("."), "strand")).alias("gene_id"), "chrom")


@query("c2_prefixed", "reads", "SELECT read_id, chrom, replace(chrom, 'chr', '') AS bare FROM reads")
def prefixed(reads):
    bare = iv.prefixed(F.col("chrom"), False)
    return reads.select("read_id", iv.prefixed(bare).alias("chrom"), bare.alias("bare"))


COVERED = f"(SELECT gene_id, sample_id, r.strand, sum(CASE WHEN r.start_pos >= g.start_pos AND r.end_pos <= g.end_pos THEN 1 ELSE 0 END)::BIGINT AS c, sum(CASE WHEN r.start_pos >= g.start_pos AND r.end_pos <= g.end_pos THEN 0 ELSE 1 END)::BIGINT AS p FROM {SPANS} r JOIN genes g ON g.chrom = r.chrom AND r.start_pos < g.end_pos AND g.start_pos < r.end_pos GROUP BY ALL)"


@query("c3_filled_coverage", "reads genes", f"SELECT g.gene_id, s.sample_id, t.strand, coalesce(sum(c), 0)::BIGINT AS complete_overlap, coalesce(sum(p), 0)::BIGINT AS partial_overlap FROM genes g CROSS JOIN (SELECT DISTINCT sample_id FROM reads) s CROSS JOIN (VALUES ('+'), ('-'), ('both')) t(strand) LEFT JOIN {COVERED} o ON o.gene_id = g.gene_id AND o.sample_id = s.sample_id AND (o.strand = t.strand OR t.strand = 'both') GROUP BY ALL")
def filled_coverage(reads, genes):
    return rd.filled_coverage(rd.coverage(reads, genes, "gene_id"), genes, reads, "gene_id")


@query("c4_filled_bins", "reads", f"SELECT s.sample_id, t.strand, b.bin, 'chr5:' || (200000 + bin * 7000) || '-' || least(200000 + (bin + 1) * 7000, 600000) AS tag, count(r.p) AS n FROM (SELECT DISTINCT sample_id FROM reads) s CROSS JOIN (VALUES ('+'), ('-')) t(strand) CROSS JOIN (SELECT unnest(range(0, 58)) AS bin) b LEFT JOIN (SELECT sample_id, strand, CASE WHEN strand = '+' THEN start_pos ELSE end_pos END AS p FROM {SPANS} x WHERE chrom = 'chr5') r ON r.sample_id = s.sample_id AND r.strand = t.strand AND r.p >= 200000 AND r.p < 600000 AND floor((r.p - 200000) / 7000) = bin GROUP BY ALL")
def filled_bins(reads):
    return rd.filled_bins(rd.binned(reads, "chr5", 200_000, 600_000, 7000), reads, "chr5", 200_000, 600_000, 7000)


TRACK = f"(SELECT sample_id, chrom, start_pos AS pos, count(*) AS depth FROM {BLOCKS} b GROUP BY ALL)"


def track(reads):
    return rd.blocks(reads).groupBy("sample_id", "chrom", F.col("start_pos").alias("pos")).agg(F.count("*").alias("depth"))


@query("c12_c14_c18_coarser", "reads", f"SELECT sample_id, chrom, CAST(round(100000 + (greatest(ceil((pos - 100000) / 8000.0) - 1, 0) + 0.5) * 8000) AS BIGINT) - 500000 AS pos, round(avg(depth) * 2.5, 6) AS depth FROM {TRACK} t WHERE pos BETWEEN 100000 AND 900000 GROUP BY ALL")
def coarser(reads):
    return rounded(tr.scaled(tr.centred(tr.coarser(track(reads), ["sample_id", "chrom"], 100_000, 900_000, 100), 500_000), 2.5), "depth")


@query("c17_explained", "reads counts", f"SELECT chrom, bin, round(r, 6) + 0.0 AS r, round(r * abs(r), 6) + 0.0 AS signed_r2 FROM (SELECT chrom, CAST(floor(pos / 200000) AS BIGINT) AS bin, covar_pop(depth, value) / nullif(sqrt(var_pop(depth) * var_pop(value)), 0) AS r FROM {TRACK} t JOIN (SELECT sample_id, sum(n)::DOUBLE AS value FROM counts GROUP BY sample_id) v ON v.sample_id = t.sample_id GROUP BY ALL) q")
def explained(reads, counts):
    values = counts.groupBy("sample_id").agg(F.sum("n").alias("value"))
    found = tr.explained(track(reads).withColumn("bin", F.floor(F.col("pos") / 200_000)), values, ["chrom", "bin"])
    return found.select("chrom", "bin", (F.round("r", 6) + 0.0).alias("r"), (F.round("signed_r2", 6) + 0.0).alias("signed_r2"))


# Networks and ontology


@query("g5_root_to_all", "edges prizes", f"SELECT 'others' AS kind, 'DUMMY' AS src, node AS dst, CAST(2.0 AS DOUBLE) AS cost FROM {PREPARED} p WHERE NOT terminal UNION ALL SELECT 'all', 'DUMMY', node, CAST(2.0 AS DOUBLE) FROM {PREPARED} q")
def root_to_all(edges, prizes):
    return net.root_edges(edges, prizes, 2.0, "others").select(F.lit("others").alias("kind"), "*").union(net.root_edges(edges, prizes, 2.0, "all").select(F.lit("all").alias("kind"), "*"))


@query("g21_g24_node_table", "edges prizes genes", f"SELECT p.node, degree, prize, type, terminal, chrom, strand FROM {PREPARED} p JOIN {DEGREES} d ON d.node = p.node LEFT JOIN (SELECT gene_id, chrom, strand FROM genes WHERE start_pos < 500000) g ON g.gene_id = p.node")
def node_table(edges, prizes, genes):
    known = genes.where("start_pos < 500000").select(F.col("gene_id").alias("gene"), "chrom", "strand")
    return net.annotated(net.node_table(edges, prizes), known)


HELD = "(SELECT gene_id AS node, sum(n) % 5 AS weight FROM counts GROUP BY gene_id HAVING sum(n) % 5 <> 0)"


@query("g33_subnetwork", "edges counts", f"SELECT h.node, weight::BIGINT AS weight, count(e.o) AS degree FROM {HELD} h LEFT JOIN (SELECT src AS node, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges) e ON e.node = h.node AND e.o IN (SELECT node FROM {HELD} i) GROUP BY h.node, weight")
def subnetwork(edges, counts):
    weights = counts.groupBy(F.col("gene_id").alias("node")).agg((F.sum("n") % 5).alias("weight"))
    return net.weighted_subnetwork(edges, weights)[0]


@query("o7_namespaces", "gene_terms", "SELECT CASE term_id % 3 WHEN 0 THEN 'process' WHEN 1 THEN 'component' ELSE 'function' END AS namespace, term_id, count(DISTINCT gene) AS genes FROM gene_terms WHERE evidence IN ('EXP', 'IDA') GROUP BY term_id")
def namespaces(gene_terms):
    out = None
    for k, name in enumerate(("process", "component", "function")):
        own = net.term_sizes(gene_terms.where(F.col("term_id") % 3 == k), ["EXP", "IDA"]).select(F.lit(name).alias("namespace"), "term_id", "genes")
        out = own if out is None else out.union(own)
    return out
