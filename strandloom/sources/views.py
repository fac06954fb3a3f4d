"""Tables of the omics and network operators, derived from the given tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dealt

BASE = ("nation", "part", "orders", "customer", "lineitem", "supplier")

VIEWS = {
    "samples": """SELECT CAST(n_nationkey AS BIGINT) AS s_ord, 'S' || CAST(n_nationkey AS STRING) AS sample_id, CASE WHEN n_nationkey % 2 = 0 THEN 'CASE' ELSE 'CTRL' END AS condition, CASE WHEN n_nationkey % 3 = 0 THEN 'Female' ELSE 'Male' END AS sex, CAST((n_nationkey * 7) % 11 AS DOUBLE) AS cov1 FROM {nation}""",
    "people": """SELECT c_custkey AS p_ord, 'C' || CAST(c_custkey AS STRING) AS sample_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CASE' ELSE 'CTRL' END AS condition, CASE WHEN c_nationkey % 3 = 0 THEN 'Female' ELSE 'Male' END AS sex FROM {customer}""",
    "genes": """SELECT 'G' || CAST(p_partkey AS STRING) AS gene_id, 'chr' || CAST(p_partkey % 22 + 1 AS STRING) AS chrom, (p_partkey * 7919) % 1000000 AS start_pos, (p_partkey * 7919) % 1000000 + CAST(p_size AS BIGINT) * 20 + 100 AS end_pos, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {part}""",
    "peaks": """SELECT 'P' || CAST(o_orderkey AS STRING) AS peak_id, 'chr' || CAST(o_orderkey % 22 + 1 AS STRING) AS chrom, (o_orderkey * 104729) % 1000000 AS start_pos, (o_orderkey * 104729) % 1000000 + 200 + (o_orderkey % 7) * 50 AS end_pos FROM {orders}""",
    "variants": """SELECT 'rs' || CAST(c_custkey AS STRING) AS variant_id, 'chr' || CAST(c_custkey % 22 + 1 AS STRING) AS chrom, (c_custkey * 6151) % 1000000 + 1 AS pos, CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS ref, CASE c_custkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'T' WHEN 2 THEN 'A' ELSE 'C' END AS alt FROM {customer}""",
    "genotypes": """SELECT 'rs' || CAST(c_custkey AS STRING) AS variant_id, 'S' || CAST(n_nationkey AS STRING) AS sample_id, CASE WHEN h < 50 THEN 0 WHEN h < 82 THEN 1 WHEN h < 97 THEN 2 ELSE NULL END AS dosage FROM (SELECT c_custkey, n_nationkey, ((c_custkey * 31 + 7) * (n_nationkey * 17 + 3) + c_custkey * n_nationkey * n_nationkey) % 101 AS h FROM {customer} CROSS JOIN {nation}) q""",
    "phenotypes": """SELECT 'G' || CAST(p_partkey AS STRING) AS phenotype_id, 'S' || CAST(n_nationkey AS STRING) AS sample_id, CAST(((p_partkey * 13 + 5) * (n_nationkey * n_nationkey + 11 * n_nationkey + 1)) % 1009 AS DOUBLE) / 100.0 AS value FROM {part} CROSS JOIN {nation}""",
    "counts": """SELECT 'G' || CAST(p_partkey AS STRING) AS gene_id, 'S' || CAST(n_nationkey AS STRING) AS sample_id, COALESCE(q.n, 0) AS n FROM {part} CROSS JOIN {nation} LEFT JOIN (SELECT l_partkey, l_orderkey % 25 AS s, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM {lineitem} GROUP BY l_partkey, l_orderkey % 25) q ON q.l_partkey = p_partkey AND q.s = n_nationkey""",
    "reads": """SELECT l_orderkey * 8 + l_linenumber AS read_id, 'S' || CAST(l_orderkey % 25 AS STRING) AS sample_id, 'chr' || CAST(l_partkey % 22 + 1 AS STRING) AS chrom, (l_partkey * 7919 + l_orderkey * 13) % 1000000 AS pos, (CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END) + (CASE WHEN l_linenumber = 7 THEN 1024 ELSE 0 END) + (CASE WHEN l_orderkey % 97 = 0 THEN 256 ELSE 0 END) AS flag, CASE l_linenumber % 5 WHEN 0 THEN '50M' WHEN 1 THEN '20M100N30M' WHEN 2 THEN '10S40M' WHEN 3 THEN '30M5D20M' ELSE '25M5I20M' END AS cigar FROM {lineitem}""",
    "edges": """SELECT DISTINCT 'G' || CAST(a.l_partkey AS STRING) AS src, 'G' || CAST(b.l_partkey AS STRING) AS dst, 1.5 - CAST((a.l_partkey * 3 + b.l_partkey * 5) % 100 AS DOUBLE) / 100.0 AS cost FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey""",
    "prizes": """SELECT 'G' || CAST(p_partkey AS STRING) AS name, p_retailprice / 1000.0 AS prize, CASE WHEN p_size % 2 = 0 THEN 'TF' ELSE 'protein' END AS type FROM {part} WHERE p_size > 40 UNION ALL SELECT 'X' || CAST(s_suppkey AS STRING), 1.0, 'protein' FROM {supplier} WHERE s_suppkey < 3 UNION ALL SELECT 'G' || CAST(p_partkey AS STRING), 0.5, 'protein' FROM {part} WHERE p_size > 48""",
    "pvals": """SELECT 'F' || CAST(o_orderkey AS STRING) AS phenotype_id, CASE WHEN o_orderkey % 5 = 0 THEN CAST((o_orderkey * 7919) % 1009 + 1 AS DOUBLE) / 1000000.0 ELSE CAST((o_orderkey * 7919) % 100003 + 1 AS DOUBLE) / 100004.0 END AS pval_beta, 1.0 + CAST(o_orderkey % 3 AS DOUBLE) / 10.0 AS beta_shape1, 5.0 + CAST(o_orderkey % 40 AS DOUBLE) AS beta_shape2 FROM {orders}""",
    "terms": """SELECT p_partkey AS term_id, 'term ' || CAST(p_partkey AS STRING) || ' activity' AS name, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor((p_partkey - 1) / 5) AS BIGINT) END AS parent_id FROM {part}""",
    "gene_terms": """SELECT DISTINCT 'G' || CAST(l_suppkey AS STRING) AS gene, l_partkey AS term_id, CASE l_linenumber WHEN 1 THEN 'EXP' WHEN 2 THEN 'IDA' WHEN 3 THEN 'HTP' WHEN 4 THEN 'IC' WHEN 5 THEN 'ISS' WHEN 6 THEN 'IEA' ELSE 'TAS' END AS evidence FROM {lineitem}""",
    "tf_sites": """SELECT 'TF' || CAST(l_suppkey % 10 AS STRING) AS tf, 'chr' || CAST(l_orderkey % 22 + 1 AS STRING) AS chrom, (l_orderkey * 104729 + l_linenumber * 400) % 1000000 AS start_pos, (l_orderkey * 104729 + l_linenumber * 400) % 1000000 + 150 AS end_pos FROM {lineitem}""",
}

EDGES = "SELECT 'G' || CAST(a AS STRING) AS src, 'G' || CAST(b AS STRING) AS dst, 1.5 - CAST((a * 3 + b * 5) % 100 AS DOUBLE) / 100.0 AS cost FROM {pairs}"


def pairs(lineitem: DataFrame) -> DataFrame:
    """(a, b): the different pairs of parts that some order has, a below b."""
    n = lineitem.count()
    rows = dealt(lineitem.select("l_orderkey", "l_partkey"), n, "l_orderkey")
    met = rows.select("l_orderkey", F.col("l_partkey").alias("a")).join(rows.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").where("a < b")
    return dealt(met.select("a", "b"), 2 * n, "a", "b").distinct()

GENE_TERMS = "SELECT 'G' || CAST(l_suppkey AS STRING) AS gene, l_partkey AS term_id, CASE line WHEN 1 THEN 'EXP' WHEN 2 THEN 'IDA' WHEN 3 THEN 'HTP' WHEN 4 THEN 'IC' WHEN 5 THEN 'ISS' WHEN 6 THEN 'IEA' ELSE 'TAS' END AS evidence FROM {rows}"


def gene_lines(lineitem: DataFrame) -> DataFrame:
    """(l_suppkey, l_partkey, line): the different ones, lines beyond the sixth as the seventh; a part's rows lie together."""
    line = F.when(F.col("l_linenumber").between(1, 6), F.col("l_linenumber")).otherwise(7).alias("line")
    return dealt(lineitem.select("l_suppkey", "l_partkey", line), lineitem.count(), "l_partkey").distinct()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet files in sf_dir."""
    text = VIEWS[name]
    if name == "edges":  # the same rows; numbers are shuffled, not the names made of them, to as many tasks as they need
        return spark.sql(EDGES, pairs=pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
    if name == "gene_terms":  # likewise
        return spark.sql(GENE_TERMS, rows=gene_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
    return spark.sql(text, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE if "{" + b + "}" in text})


def with_views(query: str, *names: str) -> str:
    """The query with the named tables before it, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**{b: b for b in BASE})})" for n in names) + " " + query
