"""Text formats of variants, regions, counts and features, as lines in a DataFrame's column `value` or as files.

Readers take what spark.read.text gives, so any store that Spark reads will do; writers give lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAB = "\t"
STANDARD = [f"chr{c}" for c in [*range(1, 23), "X", "Y"]]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def fields(rows: DataFrame, names: list[str], sep: str = TAB) -> DataFrame:
    """The first fields of each line under the given names; missing ones are null."""
    parts = F.split("value", sep)
    return rows.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def dosage(gt: Column) -> Column:
    """0, 1 or 2 alternate alleles; null for missing and for anything else."""
    return F.when(gt.isin("0/0", "0|0"), 0).when(gt.isin("0/1", "0|1", "1|0", "1/0"), 1).when(gt.isin("1/1", "1|1"), 2)


def format_field(value: Column, form: Column, name: str) -> Column:
    """The named field of a sample's colon list; null where the format lacks it."""
    at = F.array_position(F.split(form, ":"), name)
    return F.when(at > 0, F.get(F.split(value, ":"), (at - 1).cast("int")))


VCF = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]


def read_vcf(rows: DataFrame, field: str = "GT") -> DataFrame:
    """(variant fields, sample_id, value): one row per variant and sample, from the named format field.

    Sample names are the last header line's fields from the tenth on; that line alone reaches the driver.
    """
    header = rows.where(F.col("value").startswith("#CHROM")).limit(1).collect()
    names = header[0]["value"].split(TAB)[9:] if header else []
    parts = F.split("value", TAB)
    body = rows.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    samples = F.array(*(F.lit(n) for n in names)).cast("array<string>")
    got = body.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(VCF)), F.explode(F.arrays_zip(samples.alias("s"), F.slice(parts, 10, max(1, len(names))).alias("v"))).alias("x"))
    return got.select(*(F.col(n) for n in VCF[:1]), F.col("pos").cast("long").alias("pos"), *VCF[2:7], F.col("x.s").alias("sample_id"), format_field(F.col("x.v"), F.col("format"), field).alias("value"))


def vcf_lines(variants: DataFrame, genotypes: DataFrame, samples: list[str]) -> DataFrame:
    """VCF lines of the variants in the samples' order, the header first. A genotype that is missing is ./. ; two of one sample are an error.

    A variant's calls are two bits each in numbers of 31 samples, which are combined before the shuffle; lines are made
    of them in order.
    """
    parts, at = range(-(-len(samples) // 31)), F.col("_at")
    call = F.when(F.col("dosage").isin(0, 1, 2), F.col("dosage").cast("int") + 1).otherwise(0).cast("long")
    own = genotypes.withColumn("_at", F.array_position(F.array(*map(F.lit, samples)).cast("array<string>"), F.col("sample_id")).cast("int") - 1)

    def bits(i: int, value: Column, each: int) -> Column:
        return F.when((at >= 31 * i) & (at < 31 * (i + 1)), F.call_function("shiftleft", value, (at - 31 * i) * each)).otherwise(0)

    one = F.lit(1).cast("long")
    sums = [f(bits(i, v, each)).alias(f"{n}{i}") for i in parts for n, f, v, each in (("_p", F.bit_or, call, 2), ("_h", F.bit_or, one, 1))]
    packed = own.groupBy("variant_id").agg(*sums, F.count_if(at >= 0).alias("_rows"))
    seen = sum((F.bit_count(f"_h{i}") for i in parts), F.lit(0))
    twice = F.when(F.col("_rows") != seen, F.raise_error(F.concat(F.lit("a sample twice in "), F.col("variant_id"))).cast("string"))
    codes = F.array(*map(F.lit, ("./.", "0/0", "0/1", "1/1")))

    def unpacked(i: int) -> Column:
        places = F.sequence(F.lit(0), F.lit(min(31, len(samples) - 31 * i) - 1))
        return F.transform(places, lambda k: F.get(codes, F.call_function("shiftright", F.col(f"_p{i}"), k * 2).bitwiseAND(3).cast("int")))

    body = variants.join(packed.select("variant_id", *(f"_p{i}" for i in parts), twice.alias("_twice")), "variant_id")
    line = F.concat_ws(TAB, "chrom", F.col("pos").cast("string"), "variant_id", "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *map(unpacked, parts), "_twice")
    columns = ["chrom", "pos", "variant_id", "ref", "alt", *(f"_p{i}" for i in parts), "_twice"]
    head = variants.sparkSession.createDataFrame([(0, 0, "##fileformat=VCFv4.2"), (0, 1, TAB.join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))], "_o int, pos long, _head string")
    both = head.unionByName(body.select(F.lit(1).alias("_o"), *columns), allowMissingColumns=True)
    return both.orderBy("_o", "chrom", "pos").select(F.coalesce("_head", line).alias("value"))


def kept_format(rows: DataFrame, keep: str = "GT") -> DataFrame:
    """Variant lines with one format field of each sample, header lines of other format fields left out.

    A projection of lines: nothing is read as a genotype, and lines stay in their places in their files. A sample
    without the field, or a line whose format lacks it, has . for it; lines without samples stay as they are.
    """
    line, parts = F.col("value"), F.split("value", TAB)
    at = F.array_position(F.split(F.get(parts, F.lit(8)), ":"), keep).cast("int")
    own = F.transform(F.slice(parts, F.lit(10), F.greatest(F.size(parts) - 9, F.lit(0))), lambda v: F.when(at > 0, F.coalesce(F.get(F.split(v, ":"), at - 1), F.lit("."))).otherwise("."))
    short = F.concat_ws(TAB, F.slice(parts, 1, 8), F.lit(keep), own)
    other = line.startswith("##FORMAT=") & ~line.rlike(f"^##FORMAT=<ID={keep}[,>]")
    return rows.where(~other).withColumn("value", F.when(line.startswith("#") | (F.size(parts) < 10), line).otherwise(short))


def without_filter(rows: DataFrame) -> DataFrame:
    """Variant lines with . in place of their filters, header lines of filters left out."""
    line, parts = F.col("value"), F.split("value", TAB)
    bare = F.concat_ws(TAB, F.transform(parts, lambda v, i: F.when(i == 6, F.lit(".")).otherwise(v)))
    return rows.where(~line.startswith("##FILTER=")).withColumn("value", F.when(line.startswith("#"), line).otherwise(bare))


def with_ids(variants: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of known variants of the same place and alleles; others keep their own."""
    place = ["chrom", "pos", "ref", "alt"]
    return variants.join(known.select(*place, F.col("variant_id").alias("_k")).dropDuplicates(place), place, "left").withColumn("variant_id", F.coalesce("_k", "variant_id")).drop("_k")


BED = ["chrom", "start_pos", "end_pos", "name", "score", "strand"]


def read_bed(rows: DataFrame) -> DataFrame:
    """Regions of BED lines; comments and track lines are left out; absent columns and . are null."""
    body = rows.where(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0))
    got = fields(body, BED)
    return got.select("chrom", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), *(F.nullif(n, F.lit(".")).alias(n) for n in BED[3:]))


def bed_lines(regions: DataFrame) -> DataFrame:
    """BED lines; what a region lacks is . ."""
    own = [F.coalesce(F.col(n).cast("string"), F.lit(".")) if n in regions.columns else F.lit(".") for n in BED]
    return regions.select(F.concat_ws(TAB, *own).alias("value"))


def phenotype_positions(regions: DataFrame) -> DataFrame:
    """(phenotype_id, chrom, tss): the start on +, the end on -, else the middle."""
    middle = F.floor((F.col("start_pos") + F.col("end_pos")) / 2).cast("long")
    return regions.select("phenotype_id", "chrom", F.when(F.col("strand") == "+", F.col("start_pos")).when(F.col("strand") == "-", F.col("end_pos")).otherwise(middle).alias("tss"))


def phenotype_lines(regions: DataFrame, values: DataFrame, samples: list[str]) -> DataFrame:
    """Phenotype BED lines: chromosomes without chr, a column per sample, six decimals, NA for missing ones."""
    packed = values.groupBy("phenotype_id").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "value"))).alias("m"))
    own = [F.coalesce(F.when(F.col("m")[n].isNotNull(), F.format_string("%.6f", F.col("m")[n])), F.lit("NA")) for n in samples]
    line = F.concat_ws(TAB, F.regexp_replace("chrom", "^chr", ""), F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), "phenotype_id", *own)
    return regions.join(packed, "phenotype_id").orderBy("chrom", "start_pos").select(line.alias("value"))


def read_phenotypes(rows: DataFrame, samples: list[str]) -> DataFrame:
    """(phenotype_id, chrom, start_pos, end_pos, sample_id, value) of phenotype BED lines."""
    parts = F.split("value", TAB)
    names = F.array(*(F.lit(n) for n in samples))
    got = rows.where(~F.col("value").startswith("#")).select(F.concat(F.lit("chr"), parts[0]).alias("chrom"), parts[1].cast("long").alias("start_pos"), parts[2].cast("long").alias("end_pos"), parts[3].alias("phenotype_id"), F.explode(F.arrays_zip(names.alias("s"), F.slice(parts, 5, len(samples)).alias("v"))).alias("x"))
    return got.select("phenotype_id", "chrom", "start_pos", "end_pos", F.col("x.s").alias("sample_id"), F.col("x.v").try_cast("double").alias("value"))


def read_feature_counts(rows: DataFrame) -> DataFrame:
    """(gene_id, chrom, start_pos, end_pos, strand, length, n): lists of exons give the first start and the last end."""
    got = fields(rows.where(~F.col("value").startswith("#") & ~F.col("value").startswith("Geneid")), ["gene_id", "c", "s", "e", "t", "length", "n"])

    def item(name: str, at: int) -> Column:
        return F.element_at(F.split(name, ";"), at)

    return got.select("gene_id", F.concat(F.lit("chr"), item("c", 1)).alias("chrom"), item("s", 1).cast("long").alias("start_pos"), item("e", -1).cast("long").alias("end_pos"), item("t", 1).alias("strand"), F.col("length").cast("long").alias("length"), F.col("n").cast("long").alias("n"))


def read_gtf(rows: DataFrame) -> DataFrame:
    """GTF lines as half-open regions with gene_id, gene_name and transcript_id."""
    got = fields(rows.where(~F.col("value").startswith("#")), ["chrom", "source", "feature", "start_pos", "end_pos", "score", "strand", "frame", "attributes"])

    def attribute(name: str) -> Column:
        return F.nullif(F.regexp_extract("attributes", f'{name} "([^"]*)"', 1), F.lit("")).alias(name)

    return got.select("chrom", "feature", (F.col("start_pos").cast("long") - 1).alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), "strand", attribute("gene_id"), attribute("gene_name"), attribute("transcript_id"))


def gene_features(gtf: DataFrame, around: int = 1000) -> DataFrame:
    """(gene_id, feature, chrom, start_pos, end_pos, strand): tss and tes of genes widened, exons, and introns between a transcript's exons."""
    genes = gtf.where("feature = 'gene'")
    plus = F.col("strand") != "-"
    out = ["gene_id", "feature", "chrom", "start_pos", "end_pos", "strand"]

    def around_end(name: str, at: Column) -> DataFrame:
        return genes.withColumn("_p", at).select("gene_id", F.lit(name).alias("feature"), "chrom", (F.col("_p") - around).alias("start_pos"), (F.col("_p") + 1 + around).alias("end_pos"), "strand")

    first, last = F.col("start_pos"), F.col("end_pos") - 1
    exons = gtf.where("feature = 'exon'")
    w = Window.partitionBy("transcript_id").orderBy("start_pos", "end_pos")
    introns = exons.withColumn("_next", F.lead("start_pos").over(w)).where("_next > end_pos").select("gene_id", F.lit("intron").alias("feature"), "chrom", F.col("end_pos").alias("start_pos"), F.col("_next").alias("end_pos"), "strand")
    return around_end("tss", F.when(plus, first).otherwise(last)).union(around_end("tes", F.when(plus, last).otherwise(first))).union(exons.select(*out)).union(introns)


def factor_targets(rows: DataFrame) -> DataFrame:
    """(variant, tfs, scores): columns 5, 7 and 8 of each line, variants split at ;, joined with commas in line order."""
    parts = F.split("value", TAB)
    own = rows.select(F.monotonically_increasing_id().alias("o"), F.explode(F.split(parts[4], ";")).alias("variant"), parts[6].alias("tf"), parts[7].cast("int").cast("string").alias("score"))
    packed = own.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("o", "tf", "score"))).alias("x"))
    return packed.select("variant", F.array_join("x.tf", ",").alias("tfs"), F.array_join("x.score", ",").alias("scores"))
