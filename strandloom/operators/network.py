"""Interaction networks: nodes, degrees, penalties, prizes, ontology counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def penalised(edges: DataFrame, g: float = 3.0) -> DataFrame:
    """Adds penalty and cost plus penalty: hubs cost more. The edges are written once."""
    from .graphs import kept

    edges = kept(edges.select("src", "dst", "cost"), "edges")
    d = kept(degrees(edges), "degrees")
    n = d.agg(F.count("*").alias("_n"))
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("da")), d.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    total = F.lit(n.first()[0])
    both = edges.join(a, "src").join(b, "dst")
    product = F.col("da") * F.col("db")
    penalty = F.lit(10.0**g) * product / ((total - F.col("da") - 1) * (total - F.col("db") - 1) + product)
    return both.select("src", "dst", "cost", penalty.alias("penalty"), (F.col("cost") + penalty).alias("total"))


def prepared_prizes(edges: DataFrame, prizes: DataFrame, b: float = 1.0) -> DataFrame:
    """Every node with its largest prize times b, type and whether it is a terminal."""
    return prized(ends(edges).distinct(), prizes, b)


def prized(nodes: DataFrame, prizes: DataFrame, b: float = 1.0, *more: str) -> DataFrame:
    """(node, more, prize, type, terminal) of different nodes."""
    best = prizes.groupBy(F.col("name").alias("node")).agg(F.max("prize").alias("prize"), F.max("type").alias("type"))
    return nodes.join(best, "node", "left").select("node", *more, (F.coalesce("prize", F.lit(0.0)) * b).alias("prize"), F.coalesce("type", F.lit("protein")).alias("type"), F.col("prize").isNotNull().alias("terminal"))


def unknown_prizes(edges: DataFrame, prizes: DataFrame) -> DataFrame:
    return prizes.select(F.col("name").alias("node")).distinct().join(ends(edges).distinct(), "node", "left_anti")


def root_edges(edges: DataFrame, prizes: DataFrame, w: float = 5.0, to: str = "terminals") -> DataFrame:
    """Edges from an added root to the terminals, to the others, or to all."""
    some = {"terminals": "terminal", "others": "NOT terminal", "all": "true"}[to]
    return prepared_prizes(edges, prizes).where(some).select(F.lit("DUMMY").alias("src"), F.col("node").alias("dst"), F.lit(w).alias("cost"))


def degree_by_type(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many neighbours of each type a node has."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return both.join(nodes.select(F.col("node").alias("dst"), "type"), "dst").groupBy(F.col("src").alias("node"), "type").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between given nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "cost")


def term_depths(terms: DataFrame) -> DataFrame:
    """Depth below the root, by a join per level, until a level is empty."""
    from .graphs import cut

    out = level = cut(terms.where("parent_id IS NULL").select("term_id", F.lit(0).alias("depth")))
    while not level.isEmpty():
        level = cut(terms.join(level.select(F.col("term_id").alias("parent_id"), (F.col("depth") + 1).alias("depth")), "parent_id").select("term_id", "depth"))
        out = out.union(level)
    return out


def term_sizes(gene_terms: DataFrame, evidence: list[str]) -> DataFrame:
    """Genes per term, by trusted evidence."""
    return gene_terms.where(F.col("evidence").isin(*evidence)).groupBy("term_id").agg(F.countDistinct("gene").alias("genes"))


def annotated(nodes: DataFrame, annotation: DataFrame, key: str = "gene") -> DataFrame:
    """The nodes with the columns of an annotation by gene; null where there is none."""
    return nodes.join(annotation.withColumnRenamed(key, "node"), "node", "left")


def node_table(edges: DataFrame, prizes: DataFrame) -> DataFrame:
    """(node, degree, prize, type, terminal) of a graph."""
    return prized(degrees(edges).where("node IS NOT NULL"), prizes, 1.0, "degree")


def weighted_subnetwork(edges: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of weights(node, weight) that are not 0, with their degree among them, and the edges between them."""
    nodes = weights.where(F.col("weight") != 0)
    own = induced(edges, nodes)
    return nodes.join(degrees(own), "node", "left").fillna(0, ["degree"]), own
