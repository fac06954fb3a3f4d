"""Queries of tables in files: each is written by Spark from the given tables and read again, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import formats as fm
from ..sources import tables as tb
from .registry import query

SAMPLES = [f"S{i}" for i in range(25)]  # the derived tables' samples
FEW = SAMPLES[:5]


def listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query("a4_plink", "variants genotypes", f"SELECT g.variant_id, sample_id, v.chrom, v.pos, dosage FROM genotypes g JOIN variants v ON v.variant_id = g.variant_id WHERE chrom <> 'chr3' AND pos % 10 <> 0 AND sample_id IN ({listed(FEW)})")
def plink(variants, genotypes):
    spark = variants.sparkSession
    bim = tb.write_table(variants.select("chrom", "variant_id", F.lit(0.0), "pos", "alt", "ref"), tb.scratch(spark, "bim"), header=False)
    calls = genotypes.select("variant_id", "sample_id", F.coalesce(2 - F.col("dosage"), F.lit(-1)).alias("bed"))
    own = genotypes.select("sample_id").distinct().where(F.col("sample_id").isin(FEW))
    return tb.selected(tb.flipped(calls), tb.read_bim(spark, bim), own, variants.where("pos % 10 = 0"), ["chr3"]).select("variant_id", "sample_id", "chrom", "pos", "dosage")


@query("a6_window_regions", "genes", "SELECT gene_id AS phenotype_id, chrom, CASE strand WHEN '-' THEN end_pos ELSE start_pos END AS tss, CASE strand WHEN '-' THEN start_pos ELSE end_pos END AS tes, strand FROM genes")
def window_regions(genes):
    return tb.window_regions(genes.withColumnRenamed("gene_id", "phenotype_id"))


@query("a7_covariates", "counts", "SELECT sample_id, 'total' AS covariate, sum(n)::DOUBLE AS value FROM counts GROUP BY sample_id UNION ALL SELECT sample_id, 'largest', max(n)::DOUBLE FROM counts GROUP BY sample_id")
def covariates(counts):
    spark = counts.sparkSession
    own = counts.groupBy("sample_id").agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    long = own.unpivot("sample_id", ["total", "largest"], "covariate", "value")
    path = tb.write_table(long.groupBy("covariate").pivot("sample_id", SAMPLES).agg(F.first("value")), tb.scratch(spark, "covariates"))
    return tb.transposed(tb.read_table(spark, path), "covariate", "value")


@query("a8_groups", "genes", "SELECT group_id, chrom, count(*) AS n, sum(new)::BIGINT AS runs FROM (SELECT *, CASE WHEN lag(group_id) OVER (PARTITION BY chrom ORDER BY start_pos, gene_id) IS NOT DISTINCT FROM group_id THEN 0 ELSE 1 END AS new FROM (SELECT *, 'K' || CAST(floor(start_pos / 50000) % 5 AS INTEGER) AS group_id FROM genes) a) b GROUP BY group_id, chrom")
def groups(genes):
    spark = genes.sparkSession
    own = genes.select(F.col("gene_id").alias("phenotype_id"), F.concat(F.lit("K"), (F.floor(F.col("start_pos") / 50_000) % 5).cast("string")).alias("group_id"))
    path = tb.write_table(own, tb.scratch(spark, "groups"))
    return tb.group_runs(tb.read_table(spark, path), genes.withColumnRenamed("gene_id", "phenotype_id"))


@query("a10_a29_by_chromosome", "peaks", "SELECT chrom, peak_id, start_pos FROM peaks")
def by_chromosome(peaks):
    spark = peaks.sparkSession
    return tb.read_by_chromosome(spark, tb.write_by_chromosome(peaks, tb.scratch(spark, "peaks")), ["chrom", "peak_id", "start_pos"])


@query("a11_matrix", "counts", "SELECT gene_id, sample_id, round(n / 3.0, 6) AS value FROM counts")
def matrix(counts):
    spark = counts.sparkSession
    path = tb.write_matrix(counts.withColumn("value", F.col("n") / 3.0), "gene_id", "sample_id", "value", SAMPLES, tb.scratch(spark, "matrix"))
    return tb.read_matrix(spark, path, "sample_id", "value")


EVERY = [f"S{k}" for k in range(25)]


@query("a13_merged_counts", "counts", "SELECT gene_id, " + ", ".join(f"sum(n) FILTER (sample_id = '{s}')::BIGINT AS {s}" for s in EVERY) + " FROM counts GROUP BY gene_id")
def merged_counts(counts):
    spark = counts.sparkSession
    path = tb.scratch(spark, "samples")
    counts.repartition("sample_id").write.partitionBy("sample_id").csv(path, sep="\t")
    return tb.merged_counts(spark, path, EVERY)


@query("a14_peak_counts", "peaks", "SELECT chrom || ':' || start_pos || '-' || end_pos AS peak_id, (end_pos - start_pos)::DOUBLE AS S0, (start_pos % 7)::DOUBLE AS S1 FROM peaks")
def peak_counts(peaks):
    spark = peaks.sparkSession
    own = peaks.select("chrom", "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos")).alias("S0"), (F.col("start_pos") % 7).alias("S1"))
    return tb.read_peak_counts(spark, tb.write_table(own, tb.scratch(spark, "peaks")))


@query("a15_named", "variants", "SELECT chrom, pos, variant_id FROM variants WHERE pos % 3 <> 0")
def named(variants):
    some = variants.withColumn("variant_id", F.when(F.col("pos") % 3 == 0, ".").otherwise(F.col("variant_id")))
    return tb.named(some).select("chrom", "pos", "variant_id")


@query("a16_p9_symbols", "genes counts", "SELECT c.gene_id, sample_id, CASE WHEN strand = '+' THEN 'N' || c.gene_id END AS symbol FROM counts c LEFT JOIN genes g ON g.gene_id = c.gene_id")
def symbols(genes, counts):
    spark = genes.sparkSession
    own = genes.where("strand = '+'").select(F.col("gene_id").alias("ensembl"), F.concat(F.lit("N"), "gene_id").alias("name"))
    symbol = tb.read_table(spark, tb.write_table(own, tb.scratch(spark, "symbols"))).toDF("gene_id", "symbol")
    return counts.join(symbol, "gene_id", "left").select("gene_id", "sample_id", "symbol")


@query("a18_short_names", "genes", "SELECT gene_id, chrom AS name FROM genes")
def short_names(genes):
    return tb.short_names(genes.select(F.col("gene_id").alias("target.gene.gene_id"), F.col("chrom").alias("target.name")))


@query("a19_eqtl", "variants", "SELECT chrom || '_' || pos AS \"SNP_id\", 'G' || CAST(pos % 50 AS STRING) AS gene, ref FROM variants")
def eqtl(variants):
    spark = variants.sparkSession
    own = variants.select(F.concat_ws("_", F.regexp_replace("chrom", "^chr", ""), "pos").alias("SNP_id"), F.concat(F.lit("G"), F.col("pos") % 50, F.lit("."), F.col("pos") % 3).alias("gene"), "ref")
    return tb.read_eqtl(spark, tb.write_table(own, tb.scratch(spark, "eqtl")))


@query("a21_gwas", "pvals", "SELECT phenotype_id, pval_beta AS p FROM pvals")
def gwas(pvals):
    spark = pvals.sparkSession
    text = tb.write_table(pvals.select("phenotype_id", F.col("pval_beta").cast("string").alias("p")), tb.scratch(spark, "gwas"), sep=" ")
    path = tb.scratch(spark, "gwas")
    tb.read_table(spark, text, " ").withColumn("p", F.col("p").cast("double")).write.parquet(path)
    return spark.read.parquet(path)


@query("a22_chromosomes", "peaks", "SELECT chrom || ':0-' || max(end_pos) AS tag, chrom, 0::BIGINT AS start_pos, max(end_pos) AS end_pos FROM peaks GROUP BY chrom")
def chromosomes(peaks):
    sizes = peaks.groupBy("chrom").agg(F.max("end_pos").alias("size"))
    return tb.chromosome_regions(sizes.union(sizes.select(F.concat("chrom", F.lit("_random")), "size")))


@query("a25_same_samples", "counts phenotypes genotypes", "SELECT 'phenotypes' AS name, (SELECT count(DISTINCT sample_id) FROM counts WHERE n > 40 AND sample_id NOT IN (SELECT sample_id FROM phenotypes WHERE value > 5)) AS lacking, (SELECT count(DISTINCT sample_id) FROM phenotypes WHERE value > 5 AND sample_id NOT IN (SELECT sample_id FROM counts WHERE n > 40)) AS further UNION ALL SELECT 'genotypes', (SELECT count(DISTINCT sample_id) FROM counts WHERE n > 40 AND sample_id NOT IN (SELECT sample_id FROM genotypes WHERE dosage = 2)), (SELECT count(DISTINCT sample_id) FROM genotypes WHERE dosage = 2 AND sample_id NOT IN (SELECT sample_id FROM counts WHERE n > 40))")
def same_samples(counts, phenotypes, genotypes):
    return tb.differing({"counts": counts.where("n > 40"), "phenotypes": phenotypes.where("value > 5"), "genotypes": genotypes.where("dosage = 2")}, "sample_id")


@query("a26_a27_interactome", "edges", "SELECT src, dst, round(cost, 6) AS cost FROM edges")
def interactome(edges):
    spark = edges.sparkSession
    own = tb.costs(edges.withColumn("confidence", F.lit(1.5) - F.col("cost")), "confidence").select(F.col("src").alias("protein1"), F.col("dst").alias("protein2"), "cost")
    got = tb.read_interactome(spark, tb.write_table(own, tb.scratch(spark, "interactome")))
    return got.withColumn("cost", F.round("cost", 6))


@query("a26_prizes", "prizes", "SELECT name, round(prize, 6) AS prize, type FROM prizes")
def prizes_table(prizes):
    spark = prizes.sparkSession
    got = tb.read_prizes(spark, tb.write_table(prizes.toDF("protein", "value", "type"), tb.scratch(spark, "prizes")))
    return got.withColumn("prize", F.round("prize", 6))


@query("a33_passed", "variants genotypes", "SELECT variant_id, sample_id FROM genotypes JOIN variants USING (variant_id) WHERE pos % 4 <> 0")
def passed(variants, genotypes):
    lines = fm.vcf_lines(variants, genotypes, SAMPLES)
    low = (F.get(F.split("value", "\t"), F.lit(1)).try_cast("long") % 4) == 0
    lines = lines.withColumn("value", F.when(low, F.regexp_replace("value", "\tPASS\t", "\tLowQual\t")).otherwise(F.col("value")))
    return tb.passed(fm.read_vcf(tb.written(lines, "vcf"))).select(F.col("id").alias("variant_id"), "sample_id")


@query("a37_annotation", "genes counts gene_terms", "SELECT gene, location, process, function FROM (SELECT gene_id AS gene, chrom AS location FROM genes WHERE strand = '+') l FULL JOIN (SELECT gene, max(evidence) AS process FROM gene_terms GROUP BY gene) p USING (gene) FULL JOIN (SELECT gene_id AS gene, max(n) AS function FROM counts WHERE n > 40 GROUP BY gene_id) f USING (gene)")
def annotation(genes, counts, gene_terms):
    location = genes.where("strand = '+'").select(F.col("gene_id").alias("gene"), F.col("chrom").alias("location"))
    process = gene_terms.groupBy("gene").agg(F.max("evidence").alias("process"))
    return tb.merged_annotation(location, process, counts.where("n > 40").groupBy(F.col("gene_id").alias("gene")).agg(F.max("n").alias("function")))


@query("a30_k2_saved", "pvals", "SELECT phenotype_id, pval_beta FROM pvals WHERE pval_beta < 0.5")
def saved(pvals):
    spark = pvals.sparkSession
    path = tb.scratch(spark, "saved")
    tb.kept_if_there(spark, path, lambda: pvals.where("pval_beta < 0.5"))
    return tb.kept_if_there(spark, path, lambda: pvals).select("phenotype_id", "pval_beta")
