"""Genes named by their general and specific terms, for all namespaces of an ontology at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import cut, tiers


def descent(terms: DataFrame, roots: DataFrame) -> DataFrame:
    """(namespace, term_id, depth, first, second): every term below roots(namespace, term_id), with those one and two steps below the root that it is below or at.

    A join per level for all namespaces. A term on several ways has a row for each different first and second; terms that
    no root reaches have none. Rounds end on cycles too, since a row counts at its least depth only.
    """
    down = terms.where("parent_id IS NOT NULL").select("term_id", "parent_id").distinct()
    keys = ["namespace", "term_id", "first", "second"]
    none = F.lit(None).cast(terms.schema["term_id"].dataType)
    seen = frontier = cut(roots.select("namespace", "term_id", F.lit(0).alias("depth"), none.alias("first"), none.alias("second")).distinct())
    while True:
        step = frontier.withColumnRenamed("term_id", "parent_id").join(down, "parent_id")
        step = step.select("namespace", "term_id", (F.col("depth") + 1).alias("depth"), F.when(F.col("depth") == 0, F.col("term_id")).otherwise(F.col("first")).alias("first"), F.when(F.col("depth") == 1, F.col("term_id")).otherwise(F.col("second")).alias("second")).distinct()
        known = seen.select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        frontier = cut(step.join(known, same, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))


def best(scores: DataFrame, by: list[str], term: str) -> DataFrame:
    """The term of the largest sum of scores; ties to the smaller term. Sums are combined first, so a key has a row per term."""
    sums = scores.groupBy(*by, term).agg(F.sum("score").alias("score"))
    return sums.groupBy(*by).agg(F.min_by(F.struct(F.col(term).alias("t"), "score"), F.struct(-F.col("score"), F.col(term))).alias("_b")).select(*by, F.col("_b.t").alias(term), F.col("_b.score").alias("score"))


def whole_annotation(terms: DataFrame, gene_terms: DataFrame, roots: DataFrame, solid: list[str], sketchy: list[str], suffix: dict[str, str] | None = None) -> DataFrame:
    """(namespace, gene, general_id, general, general_score, specific_id, specific, specific_score), a row per namespace and gene that has a term below a root's.

    General is the best of the terms one step below the roots by its genes' evidence, specific the best two steps below
    and under the general one; null where there is none. suffix names what is cut from the ends of a namespace's names.
    A repeated row of gene_terms counts again; rows whose term no root reaches, and roots' own, count for nothing.
    """
    found = tiers(gene_terms, solid, sketchy).select("gene", "term_id", "score").where("gene IS NOT NULL")
    below = descent(terms, roots)
    one = below.where("first IS NOT NULL").select("namespace", "term_id", "first").distinct()
    two = below.where("second IS NOT NULL").select("namespace", "term_id", "first", "second").distinct()
    key = ["namespace", "gene"]
    general = cut(best(found.join(one, "term_id"), key, "first").withColumnRenamed("score", "general_score"))
    own = found.join(two, "term_id").join(general.select(*key, "first"), [*key, "first"])
    specific = best(own, key, "second").withColumnRenamed("score", "specific_score")
    names = terms.groupBy("term_id").agg(F.min("name").alias("name"))

    def named(name: str):
        text = F.col(name)
        for space, end in (suffix or {}).items():
            text = F.when((F.col("namespace") == space) & F.endswith(F.col(name), F.lit(end)), F.expr(f"left({name}, length({name}) - {len(end)})")).otherwise(text)
        return text.alias(name)

    both = general.join(specific, key, "left")
    both = both.join(names.toDF("first", "general"), "first", "left").join(names.toDF("second", "specific"), "second", "left")
    return both.select(*key, F.col("first").alias("general_id"), named("general"), "general_score", F.col("second").alias("specific_id"), named("specific"), "specific_score")


def evidence_by_tier(gene_terms: DataFrame, terms: DataFrame, roots: DataFrame, solid: list[str], sketchy: list[str]) -> DataFrame:
    """(namespace, score, n): how many rows of each tier a namespace has."""
    place = descent(terms, roots).select("namespace", "term_id").distinct()
    return tiers(gene_terms, solid, sketchy).join(place, "term_id").groupBy("namespace", "score").agg(F.count("*").alias("n"))
