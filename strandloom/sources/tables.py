"""Tables in files: matrices, covariates, results by chromosome, networks and external tables, read and written by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import STANDARD, TAB, lines


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may leave it unset."""
    import tempfile

    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, gone when the session's JVM ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def dealt(df: DataFrame, n: int, *keys: str, most: int = 500_000) -> DataFrame:
    """The rows apart by keys; n of them (about) go to more tasks than the session's shuffles have, if these got over `most` each."""
    parts = -(-n // most)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def written(rows: DataFrame, name: str = "lines") -> DataFrame:
    """The lines written once as text in the shared folder, and read from there."""
    path = scratch(rows.sparkSession, name)
    rows.write.text(path)
    return lines(rows.sparkSession, path)


def write_table(df: DataFrame, path: str, sep: str = TAB, header: bool = True, mode: str = "errorifexists") -> str:
    """Separated text, gzipped; an existing path is an error unless mode says otherwise."""
    df.write.mode(mode).csv(path, sep=sep, header=header, compression="gzip", emptyValue="", nullValue="NA")
    return path


def read_table(spark: SparkSession, path: str, sep: str = TAB, schema: str | None = None) -> DataFrame:
    """Separated text with a header (no header where a schema is given). NA and empty fields are null."""
    options = {"sep": sep, "nullValue": "NA", "emptyValue": "", "header": schema is None}
    return spark.read.csv(path, schema=schema, **options)


# Genotypes


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema="chrom string, variant_id string, cm double, pos long, alt string, ref string")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, sep=" ", schema="family string, sample_id string, father string, mother string, sex int, phenotype double")


def flipped(calls: DataFrame) -> DataFrame:
    """dosage from bed, the count of the other allele; -1 is missing."""
    return calls.withColumn("dosage", F.when(F.col("bed") >= 0, 2 - F.col("bed"))).drop("bed")


def selected(genotypes: DataFrame, variants: DataFrame, samples: DataFrame | None = None, without: DataFrame | None = None, without_chroms: list[str] = ()) -> DataFrame:
    """The genotypes of the given samples, less some variants and chromosomes, with the variants' places."""
    own = variants.where(~F.col("chrom").isin(*without_chroms)) if without_chroms else variants
    own = own if without is None else own.join(without.select("variant_id"), "variant_id", "left_anti")
    got = genotypes.join(own.select("variant_id", "chrom", "pos"), "variant_id")
    return got if samples is None else got.join(samples.select("sample_id"), "sample_id", "left_semi")


def named(variants: DataFrame) -> DataFrame:
    """Variants with an id; . is none."""
    return variants.where(F.col("variant_id") != ".")


def passed(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("filter") == "PASS")


# Samples and phenotypes


def transposed(wide: DataFrame, name: str, value: str, key: str = "sample_id") -> DataFrame:
    """(key, name, value) of a table with a column per key: covariates by samples."""
    first, *rest = wide.columns
    return wide.unpivot(first, rest, key, value).select(key, F.col(first).alias(name), F.col(value).cast("double").alias(value))


def differing(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(name, lacking, further): how many keys of the first table each other one lacks, and has beyond it."""
    (_, first), *others = tables.items()
    first = first.select(key).distinct()
    out = None
    for name, other in others:
        own = other.select(key).distinct()
        lacking, further = first.join(own, key, "left_anti").agg(F.count("*").alias("lacking")), own.join(first, key, "left_anti").agg(F.count("*").alias("further"))
        row = lacking.crossJoin(further).select(F.lit(name).alias("name"), "lacking", "further")
        out = row if out is None else out.union(row)
    return out


def window_regions(regions: DataFrame) -> DataFrame:
    """(phenotype_id, chrom, tss, tes, strand): both ends, swapped on -."""
    back = F.col("strand") == "-"
    return regions.select("phenotype_id", "chrom", F.when(back, F.col("end_pos")).otherwise(F.col("start_pos")).alias("tss"), F.when(back, F.col("start_pos")).otherwise(F.col("end_pos")).alias("tes"), "strand")


def group_runs(groups: DataFrame, regions: DataFrame) -> DataFrame:
    """(group_id, chrom, n, runs) of groups(phenotype_id, group_id): a group is contiguous in genome order if runs is 1."""
    from ..operators.prefix import base_range, shifted

    own = groups.join(regions.select("phenotype_id", "chrom", "start_pos"), "phenotype_id").withColumn("_r", base_range(F.col("start_pos")))
    new = shifted(own, ["chrom"], ["start_pos", "phenotype_id"], F.struct("group_id"), "_before", -1)
    first = (F.col("_before").isNull() | ~F.col("_before.group_id").eqNullSafe(F.col("group_id"))).cast("int")
    return new.groupBy("group_id", "chrom").agg(F.count("*").alias("n"), F.sum(first).alias("runs"))


# Matrices and counts


def write_matrix(rows: DataFrame, key: str, column: str, value: str, columns: list[str], path: str, mode: str = "errorifexists") -> str:
    """A row per key, a column per given name, six decimals, tabs, gzipped."""
    wide = rows.groupBy(key).pivot(column, columns).agg(F.first(value))
    return write_table(wide.select(key, *(F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c).cast("double"))).alias(c) for c in columns)), path, mode=mode)


def read_matrix(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """(key, column, value) of such a file; the key is its first column."""
    wide = read_table(spark, path)
    return transposed(wide, wide.columns[0], value, column).select(wide.columns[0], column, value)


def merged_counts(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """gene_id and a column per sample, of files under path/sample_id=.../ with lines of gene and count."""
    rows = spark.read.csv(path, sep=TAB, schema="gene_id string, n long, sample_id string")
    return rows.groupBy("gene_id").pivot("sample_id", samples).agg(F.sum("n"))


def read_peak_counts(spark: SparkSession, path: str) -> DataFrame:
    """peak_id, the tag of the first three columns, and the counts in the others."""
    wide = read_table(spark, path)
    chrom, start, end, *rest = wide.columns
    return wide.select(F.format_string("%s:%s-%s", chrom, start, end).alias("peak_id"), *(F.col(c).cast("double").alias(c) for c in rest))


# Results by chromosome


def write_by_chromosome(df: DataFrame, path: str, mode: str = "errorifexists", parts: int = 16) -> str:
    """Parquet in a folder per chromosome, of up to `parts` files each; a chromosome is written by as many tasks."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    df.repartition("chrom", salt).write.mode(mode).partitionBy("chrom").parquet(path)
    return path


def write_clustered(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> str:
    """Parquet sorted by key in a folder per range of keys, beside an index of the first and last key of each range."""
    from ..operators.prefix import in_ranges

    rows = in_ranges(df, key)
    rows.repartition("_r").sortWithinPartitions("_r", key).write.mode(mode).partitionBy("_r").parquet(f"{path}/rows")
    rows.groupBy("_r").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).write.mode(mode).parquet(f"{path}/index")
    return path


def select_clustered(spark: SparkSession, key: str, ids: list, path: str) -> DataFrame:
    """The rows of some keys of such a table; only the folders whose range may hold one are read."""
    index = spark.read.parquet(f"{path}/index")
    hit = F.lit(False)
    for i in ids:
        hit = hit | F.lit(i).between(F.col("lo"), F.col("hi"))
    folders = [r["_r"] for r in index.where(hit).select("_r").collect()]  # as many as keys, about
    return spark.read.parquet(f"{path}/rows").where(F.col("_r").isin(folders) & F.col(key).isin(ids)).drop("_r")


def write_by_range(df: DataFrame, path: str, position: str = "pos", width: int = 1_000_000, files: int = 4, mode: str = "errorifexists") -> str:
    """Parquet in a folder per chromosome and in it one per range of `width` positions, sorted by position.

    A range is dealt to up to `files` tasks by its rows' hashes, so neither a chromosome nor a crowded range is one
    task's. Rows without a chromosome or position are kept in folders of their own. The width is written beside the rows.
    """
    if "range" in df.columns:
        raise ValueError("a column is named range")
    own = df.withColumn("range", F.floor(F.col(position) / width))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    own.repartition("chrom", "range", salt).sortWithinPartitions("chrom", "range", position).write.mode(mode).partitionBy("chrom", "range").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(position, width)], "position string, width long").coalesce(1).write.mode(mode).parquet(f"{path}/index")
    return path


def read_by_range(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    """All rows of such a table, or those of a region (chr or chr:first-last); only the folders that it meets are read."""
    from ..operators.results import parsed_region

    position, width = spark.read.parquet(f"{path}/index").first()
    schema = "chrom string, range long"
    found = spark.read.parquet(f"{path}/rows")
    rows = spark.read.schema(f"{found.drop('chrom', 'range').schema.toDDL()}, {schema}").parquet(f"{path}/rows")
    if region is not None:
        chrom, first, last = parsed_region(region)
        rows = rows.where(F.col("chrom") == chrom)
        if first is not None:
            rows = rows.where(F.col("range").between(first // width, last // width) & F.col(position).between(first, last))
    return rows.drop("range")


def write_trans(found: DataFrame, path: str, text: bool = False, mode: str = "errorifexists") -> str:
    """Pairs of far variants as Parquet, or as text with six significant digits."""
    if text:
        return write_top(found, path, mode=mode)
    found.write.mode(mode).parquet(path)
    return path


def read_trans(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What write_trans wrote; with a schema, text whose columns it names, in order, under a header."""
    return spark.read.csv(path, schema=schema, sep=TAB, header=True, nullValue="NA", emptyValue="") if schema else spark.read.parquet(path)


def write_text_by_chromosome(df: DataFrame, path: str, parts: int = 4, mode: str = "errorifexists") -> str:
    """Gzipped text under headers, all digits kept, in a folder per chromosome, of up to `parts` files each."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    df.repartition("chrom", salt).write.mode(mode).partitionBy("chrom").csv(path, sep=TAB, header=True, compression="gzip", emptyValue="", nullValue="NA")
    return path


def read_text_by_chromosome(spark: SparkSession, path: str, schema: str, chroms: list[str] | None = None) -> DataFrame:
    """The results of all chromosomes, or of the named ones, as one table; only their folders are read. schema names the columns in order, without chrom."""
    rows = spark.read.csv(path, schema=f"{schema}, chrom string", sep=TAB, header=True, nullValue="NA", emptyValue="")
    return rows if chroms is None else rows.where(F.col("chrom").isin(chroms))


def read_by_chromosome(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All chromosomes as one table; a filter on chrom reads that folder alone, columns what is asked for."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path).withColumn("chrom", F.col("chrom").cast("string"))
    return rows.select(*columns) if columns else rows


def write_top(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Text with six significant digits."""
    own = [F.when(F.col(n).isNotNull(), F.format_string("%.6g", F.col(n))).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    return write_table(df.select(*own), path, mode=mode)


def kept_if_there(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made by make() only if there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.parquet(path)
    return spark.read.parquet(path)


# External tables


def short_names(df: DataFrame) -> DataFrame:
    """Columns named by what follows the last dot."""
    return df.toDF(*(c.rpartition(".")[2] for c in df.columns))


def read_eqtl(spark: SparkSession, path: str) -> DataFrame:
    """SNP_id with chr before it, gene without its version."""
    rows = read_table(spark, path)
    return rows.withColumns({"SNP_id": F.concat(F.lit("chr"), "SNP_id"), "gene": F.substring_index("gene", ".", 1)})


def chromosome_regions(sizes: DataFrame) -> DataFrame:
    """(tag, chrom, start_pos, end_pos) of the standard chromosomes, from 0 to their size."""
    own = sizes.where(F.col("chrom").isin(*STANDARD))
    return own.select(F.format_string("%s:0-%d", "chrom", F.col("size")).alias("tag"), "chrom", F.lit(0).cast("long").alias("start_pos"), F.col("size").alias("end_pos"))


# Networks


def read_interactome(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, cost) of a table with protein1, protein2, cost."""
    return read_table(spark, path).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst"), F.col("cost").cast("double").alias("cost"))


def read_prizes(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns as name and prize, the others as they are."""
    rows = read_table(spark, path)
    return rows.toDF("name", "prize", *rows.columns[2:]).withColumn("prize", F.col("prize").cast("double"))


def costs(edges: DataFrame, confidence: str | None = None) -> DataFrame:
    """cost: 1.5 less the confidence, or 1 throughout."""
    return edges.withColumn("cost", F.lit(1.5) - F.col(confidence) if confidence else F.lit(1.0))


def merged_annotation(location: DataFrame, process: DataFrame, function: DataFrame, key: str = "gene") -> DataFrame:
    """The three tables side by side, every gene of any."""
    return location.join(process, key, "full_outer").join(function, key, "full_outer").orderBy(key)
