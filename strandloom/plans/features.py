"""Queries of formats, intervals and tracks, each with its SQL. Lines of a format are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import reads as rd
from ..operators import tracks as tr
from ..sources import formats as fm
from ..sources import tables as tb
from ..operators.prefix import base_range, running
from .fragments import BLOCKS, DEPTH, SPANS
from .registry import query, rounded

SAMPLES = [f"S{i}" for i in range(25)]  # the derived tables' samples


# Formats


@query("a1_vcf", "variants genotypes", "SELECT v.chrom, v.pos, v.variant_id, ref, alt, sample_id, dosage FROM variants v JOIN genotypes g ON g.variant_id = v.variant_id")
def vcf(variants, genotypes):
    got = fm.read_vcf(tb.written(fm.vcf_lines(variants, genotypes, SAMPLES), "vcf"))
    return got.select("chrom", "pos", F.col("id").alias("variant_id"), "ref", "alt", "sample_id", fm.dosage(F.col("value")).alias("dosage"))


@query("a5_phenotype_bed", "genes phenotypes", "SELECT phenotype_id, sample_id, value, chrom, start_pos, end_pos FROM genes JOIN phenotypes ON phenotype_id = gene_id")
def phenotype_bed(genes, phenotypes):
    return fm.read_phenotypes(fm.phenotype_lines(genes.withColumnRenamed("gene_id", "phenotype_id"), phenotypes, SAMPLES), SAMPLES)


@query("a5_positions", "genes", "SELECT gene_id AS phenotype_id, chrom, CASE strand WHEN '+' THEN start_pos ELSE end_pos END AS tss FROM genes")
def positions(genes):
    return fm.phenotype_positions(genes.withColumnRenamed("gene_id", "phenotype_id"))


@query("a12_feature_counts", "counts genes", "SELECT c.gene_id, chrom, start_pos, end_pos + 50 AS end_pos, strand, end_pos - start_pos AS length, n FROM counts c JOIN genes g ON g.gene_id = c.gene_id WHERE sample_id = 'S3'")
def feature_counts(counts, genes):
    s = F.col("strand")
    two = [F.concat(F.regexp_replace("chrom", "^chr", ""), F.lit(";"), F.regexp_replace("chrom", "^chr", "")), F.concat_ws(";", "start_pos", F.col("start_pos") + 60), F.concat_ws(";", F.col("start_pos") + 40, F.col("end_pos") + 50), F.concat(s, F.lit(";"), s)]
    line = F.concat_ws("\t", "gene_id", *two, (F.col("end_pos") - F.col("start_pos")).cast("string"), F.col("n").cast("string"))
    return fm.read_feature_counts(counts.where("sample_id = 'S3'").join(genes, "gene_id").select(line.alias("value")))


@query("a20_a36_bed", "genes", "SELECT chrom, start_pos, end_pos, gene_id AS name, CAST(NULL AS VARCHAR) AS score, strand FROM genes")
def bed(genes):
    return fm.read_bed(fm.bed_lines(genes.withColumnRenamed("gene_id", "name")))


def gtf_lines(genes: DataFrame) -> DataFrame:
    """Each gene, and two exons of it: its first 40 bases and what follows base 60."""
    def line(feature: str, start, end):
        tail = F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; gene_name "N'), F.col("gene_id"), F.lit('"; transcript_id "T'), F.col("gene_id"), F.lit('";'))
        return genes.select(F.concat_ws("\t", "chrom", F.lit("own"), F.lit(feature), (start + 1).cast("string"), end.cast("string"), F.lit("."), "strand", F.lit("."), tail).alias("value"))

    s, e = F.col("start_pos"), F.col("end_pos")
    return line("gene", s, e).union(line("exon", s, s + 40)).union(line("exon", s + 60, e))


@query("a23_gene_features", "genes", "SELECT gene_id, 'tss' AS feature, chrom, CASE strand WHEN '-' THEN end_pos - 1 ELSE start_pos END - 1000 AS start_pos, CASE strand WHEN '-' THEN end_pos - 1 ELSE start_pos END + 1001 AS end_pos, strand FROM genes UNION ALL SELECT gene_id, 'tes', chrom, CASE strand WHEN '-' THEN start_pos ELSE end_pos - 1 END - 1000, CASE strand WHEN '-' THEN start_pos ELSE end_pos - 1 END + 1001, strand FROM genes UNION ALL SELECT gene_id, 'exon', chrom, start_pos, start_pos + 40, strand FROM genes UNION ALL SELECT gene_id, 'exon', chrom, start_pos + 60, end_pos, strand FROM genes UNION ALL SELECT gene_id, 'intron', chrom, start_pos + 40, start_pos + 60, strand FROM genes")
def gene_features(genes):
    return fm.gene_features(fm.read_gtf(gtf_lines(genes)))


@query("a24_gtf_genes", "genes", "SELECT gene_id, 'N' || gene_id AS gene_name, chrom, start_pos, end_pos, strand FROM genes")
def gtf_genes(genes):
    return fm.read_gtf(gtf_lines(genes)).where("feature = 'gene'").select("gene_id", "gene_name", "chrom", "start_pos", "end_pos", "strand")


@query("a17_factor_targets", "tf_sites", "SELECT 'v' || CAST(start_pos % 500 + o AS STRING) AS variant, string_agg(tf, ',' ORDER BY tf) AS tfs, string_agg(CAST(end_pos % 9 AS STRING), ',' ORDER BY CAST(end_pos % 9 AS STRING)) AS scores FROM tf_sites, (VALUES (0), (1)) x(o) GROUP BY ALL")
def factor_targets(tf_sites):
    variants = F.concat(F.lit("v"), F.col("start_pos") % 500, F.lit(";v"), F.col("start_pos") % 500 + 1)
    got = fm.factor_targets(tf_sites.select(F.concat_ws("\t", "chrom", "start_pos", "end_pos", F.lit("."), variants, F.lit("."), "tf", F.col("end_pos") % 9).alias("value")))
    return got.select("variant", *(F.array_join(F.array_sort(F.split(c, ",")), ",").alias(c) for c in ("tfs", "scores")))  # SQL has no order of lines


@query("a32_ids", "variants", "SELECT chrom, pos, ref, alt, CASE WHEN pos % 2 = 0 THEN 'k' || variant_id ELSE variant_id END AS variant_id FROM variants")
def ids(variants):
    known = variants.where("pos % 2 = 0").withColumn("variant_id", F.concat(F.lit("k"), "variant_id"))
    return fm.with_ids(variants, known).select("chrom", "pos", "ref", "alt", "variant_id")


# Intervals


@query("i1_parsed_tags", "genes", "SELECT gene_id, chrom, start_pos, end_pos, strand FROM genes")
def parsed_tags(genes):
    text = F.concat(iv.tag(), F.lit("_"), F.col("strand"))
    return iv.parsed(genes.select("gene_id", text.alias("tag")), "tag").select("gene_id", "chrom", "start_pos", "end_pos", "strand")


@query("i10_is_sorted", "peaks", "SELECT chrom, bool_and(prev IS NULL OR start_pos > prev) AS sorted FROM (SELECT *, lag(start_pos) OVER (PARTITION BY chrom ORDER BY peak_id) AS prev FROM peaks) q GROUP BY chrom")
def is_sorted(peaks):
    return iv.is_sorted(peaks, "peak_id")


@query("i11_order", "peaks", "SELECT peak_id, row_number() OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, peak_id) AS place FROM peaks")
def order(peaks):
    rows = peaks.withColumn("_r", base_range(F.col("start_pos")))
    return running(rows, ["chrom"], ["start_pos", "end_pos", "peak_id"], F.lit(1).cast("long"), F.sum, "place").select("peak_id", "place")


@query("i11_genome_order", "peaks", "SELECT peak_id, row_number() OVER (ORDER BY chrom NOT IN (" + ", ".join(f"'chr{c}'" for c in (*range(1, 23), "X", "Y")) + "), replace(chrom, 'chr', ''), start_pos, end_pos, peak_id) AS place FROM peaks")
def genome_order(peaks):
    return iv.ordered(peaks, "peak_id").select("peak_id", "place")


@query("c8_both_pileups", "reads", f"""SELECT sample_id, chrom, strand, pos, (sum(g) OVER w)::BIGINT AS gapped, (sum(f) OVER w)::BIGINT AS filled, s::BIGINT AS starts, e::BIGINT AS ends FROM (SELECT sample_id, chrom, strand, pos, sum(g) AS g, sum(f) AS f, sum(s) AS s, sum(e) AS e FROM (
SELECT sample_id, chrom, strand, start_pos AS pos, 1 AS g, 0 AS f, 0 AS s, 0 AS e FROM {BLOCKS} a UNION ALL SELECT sample_id, chrom, strand, end_pos, -1, 0, 0, 0 FROM {BLOCKS} b UNION ALL SELECT sample_id, chrom, strand, start_pos, 0, 1, 1, 0 FROM {SPANS} c UNION ALL SELECT sample_id, chrom, strand, end_pos, 0, -1, 0, 1 FROM {SPANS} d) x GROUP BY ALL) y WINDOW w AS (PARTITION BY sample_id, chrom, strand ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def both_pileups(reads):
    return rd.both_pileups(reads)


@query("i15_stranded_overlaps", "reads genes", "SELECT gene_id, count(*) AS n, sum(least(r.e, g.end_pos) - greatest(r.pos, g.start_pos))::BIGINT AS bases FROM (SELECT *, pos + 50 AS e, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM reads) r JOIN genes g ON g.chrom = r.chrom AND g.strand = r.strand AND r.pos < g.end_pos AND g.start_pos < r.e GROUP BY gene_id")
def stranded_overlaps(reads, genes):
    r = reads.withColumn("strand", F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")).select("read_id", "chrom", "strand", F.col("pos").alias("start_pos"), (F.col("pos") + 50).alias("end_pos"))
    return iv.overlap_totals(iv.stranded(genes), iv.stranded(r), "gene_id")


@query("i17_distances", "peaks", "SELECT peak_id, -(start_pos - 500000) AS distance FROM peaks WHERE chrom = 'chr4'")
def distances(peaks):
    return iv.distances(peaks, "chr4", 500_000, "-", F.col("start_pos")).select("peak_id", "distance")


@query("i19_adjacent_to", "peaks", "SELECT peak_id FROM (SELECT *, row_number() OVER (ORDER BY start_pos, end_pos, peak_id) AS i FROM peaks WHERE chrom = 'chr4') q, (SELECT count(*) AS before FROM peaks WHERE chrom = 'chr4' AND start_pos < 500000) c WHERE i > before - 5 AND i <= before + 5")
def adjacent_to(peaks):
    return iv.adjacent_to(peaks, "chr4", 500_000, 5).select("peak_id")


LABELS = "SELECT peak_id, CASE WHEN plus > 0 AND minus > 0 THEN 'both' WHEN plus > 0 THEN 'plus' WHEN minus > 0 THEN 'minus' ELSE 'intergenic' END AS label, plus, minus FROM (SELECT p.peak_id, count(*) FILTER (g.strand = '+') AS plus, count(*) FILTER (g.strand = '-') AS minus FROM peaks p LEFT JOIN genes g ON g.chrom = p.chrom AND g.start_pos < p.end_pos AND p.start_pos < g.end_pos GROUP BY p.peak_id) q"


@query("i22_annotated", "peaks genes", LABELS)
def annotated(peaks, genes):
    kinds = genes.withColumn("feature", F.when(F.col("strand") == "+", "plus").otherwise("minus"))
    n = iv.feature_counts(peaks, kinds, "peak_id", "feature", ["plus", "minus"])
    label = F.when((F.col("plus") > 0) & (F.col("minus") > 0), "both").when(F.col("plus") > 0, "plus").when(F.col("minus") > 0, "minus").otherwise("intergenic")
    return n.select("peak_id", label.alias("label"), "plus", "minus")


@query("i24_factor_matrix", "peaks tf_sites", "SELECT p.peak_id, " + ", ".join(f"coalesce(bool_or(t.tf = 'TF{k}'), false) AS tf{k}" for k in range(10)) + " FROM peaks p LEFT JOIN tf_sites t ON t.chrom = p.chrom AND t.start_pos < p.end_pos AND p.start_pos < t.end_pos GROUP BY p.peak_id")
def factor_matrix(peaks, tf_sites):
    n = iv.feature_counts(peaks, tf_sites, "peak_id", "tf", [f"TF{k}" for k in range(10)])
    return n.select("peak_id", *((F.col(f"TF{k}") > 0).alias(f"tf{k}") for k in range(10)))


# Tracks


@query("c10_unstranded", "reads", f"SELECT sample_id, chrom, pos, sum(change) OVER (PARTITION BY sample_id, chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM (SELECT sample_id, chrom, pos, sum(d) AS change FROM (SELECT sample_id, chrom, start_pos AS pos, 1 AS d FROM {BLOCKS} a UNION ALL SELECT sample_id, chrom, end_pos, -1 FROM {BLOCKS} b) e GROUP BY ALL) f")
def unstranded(reads):
    return rd.pileup(rd.blocks(reads).withColumn("strand", F.lit("both"))).drop("strand")


@query("c11_binned_track", "reads", f"SELECT sample_id, strand, bin, round(sum(depth * n) / sum(n), 6) AS depth FROM (SELECT *, generate_series AS bin, least(e, 200000 + (generate_series + 1) * 4000) - greatest(pos, 200000 + generate_series * 4000) AS n FROM (SELECT *, lead(pos) OVER (PARTITION BY sample_id, strand ORDER BY pos) AS e FROM ({DEPTH.format(BLOCKS)}) d WHERE chrom = 'chr5') s, generate_series(0, 99) WHERE e > 200000 + generate_series * 4000 AND pos < 200000 + (generate_series + 1) * 4000) q GROUP BY sample_id, strand, bin")
def binned_track(reads):
    return rounded(tr.binned(rd.pileup(rd.blocks(reads)), "chr5", 200_000, 600_000, 4000), "depth")


@query("c15_track_summary", "reads", f"SELECT strand, bin, round(avg(depth), 6) AS mean, round(stddev_samp(depth) / avg(depth), 6) AS norm_variance FROM (SELECT sample_id, strand, bin, count(*) AS depth FROM (SELECT sample_id, strand, CAST(floor(start_pos / 100000) AS BIGINT) AS bin FROM {BLOCKS} b) x GROUP BY ALL) y GROUP BY strand, bin")
def track_summary(reads):
    n = rd.blocks(reads).groupBy("sample_id", "strand", F.floor(F.col("start_pos") / 100_000).alias("bin")).agg(F.count("*").alias("depth"))
    return rounded(tr.summary(n, ["strand", "bin"]), "mean", "norm_variance")


@query("c16_by_genotype", "reads genotypes", f"SELECT dosage, bin, round(avg(depth), 6) AS depth FROM (SELECT sample_id, CAST(floor(start_pos / 100000) AS BIGINT) AS bin, count(*) AS depth FROM {BLOCKS} b GROUP BY ALL) t JOIN genotypes g ON g.sample_id = t.sample_id WHERE variant_id = 'rs5' AND dosage IS NOT NULL GROUP BY dosage, bin")
def by_genotype(reads, genotypes):
    n = rd.blocks(reads).groupBy("sample_id", F.floor(F.col("start_pos") / 100_000).alias("bin")).agg(F.count("*").alias("depth"))
    return rounded(tr.by_genotype(n, genotypes.where("variant_id = 'rs5'"), ["bin"]), "depth")
