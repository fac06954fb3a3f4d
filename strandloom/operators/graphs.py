"""Graph algorithms as joins: components, distances, cliques, run frequencies; and clusters of feature rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..sources.tables import scratch, shared
from .network import degrees, ends
from .tiles import pieces, spread


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir, so that iterations don't grow the plan."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder, a fraction of a checkpoint's size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable.

    Stars: each node's larger neighbours are linked to its smallest one, then its smaller ones, until no edge
    changes. A node's edges are grouped by a minimum, which is combined before the shuffle, and no list of
    neighbours is gathered, so hubs don't matter.
    """
    edges = kept(edges.select("src", "dst"), "edges")
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))

    state = None
    for _ in range(most):
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = e.join(least(both).hint("merge"), "u").select(F.col("m").alias("u"), "v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each node's smaller neighbours
        m = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(m.hint("merge"), "u").where("v <> m").select(F.col("m").alias("u"), "v").union(m.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        e = kept(small, "stars")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return ends(edges).distinct().join(e.select(F.col("v").alias("node"), "u").hint("merge"), "node", "left").select("node", F.coalesce("u", "node").alias("component"))


def of_size(edges: DataFrame, least: int) -> DataFrame:
    """The nodes whose component has at least `least` nodes, with it."""
    c = kept(components(edges), "components")
    big = c.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("component")
    return c.join(big, "component", "left_semi").select("node", "component")


def distances(edges: DataFrame, sources: DataFrame, most: int = 100) -> DataFrame:
    """(source, node, dist): edges on the shortest way from each source, by a frontier that is joined per level.

    The edges are written once. Up to 64 sources are bits of a number, so that a step sends one row over an edge for all
    of them, and what reaches a node is combined before the shuffle.
    """
    links = cut(edges.select("src", "dst"))
    steps = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ids = cut(sources.select(F.col("node").alias("source")).distinct()).withColumn("_id", F.monotonically_increasing_id())
    ids = cut(ids.select("source", F.expr("_id div 64").alias("_part"), (F.col("_id") % 64).cast("int").alias("_bit")))
    none = F.lit(0).cast("long")
    state = cut(ids.select(F.col("source").alias("node"), "_part", none.alias("_old"), F.expr("shiftleft(1L, _bit)").alias("_new")))
    found = None
    for d in range(most + 1):
        new = state.where("_new <> 0")
        if new.isEmpty():
            return found.select("_part", "node", "dist", F.expr("explode(filter(sequence(0, 63), b -> getbit(_new, b) = 1))").alias("_bit")).join(ids, ["_part", "_bit"]).select("source", "node", "dist")
        level = new.select("_part", "node", "_new", F.lit(d).alias("dist"))
        found = level if found is None else found.union(level)
        grown = new.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "_part", none.alias("_old"), "_new")
        held = state.select("node", "_part", F.col("_old").bitwiseOR(F.col("_new")).alias("_old"), none.alias("_new"))
        both = held.union(grown).groupBy("node", "_part").agg(F.bit_or("_old").alias("_old"), F.bit_or("_new").alias("_new"))
        state = cut(both.withColumn("_new", F.expr("_new & ~_old")))
    raise RuntimeError("the search did not end")


def colours_of(n: int, most: int = 12_000_000) -> int:
    """Of how many colours three have at most about `most` of n edges among them; four at least, for twenty tasks."""
    return max(4, ceil((6 * n / most) ** 0.5))


def triangles(edges: DataFrame, colours: int | None = None) -> DataFrame:
    """(a, b, c), each once.

    Nodes have colours. A task holds the edges among three colours, so an edge goes to as many tasks as there are colours
    and no path of two is shuffled. There edges point from lower to higher degree, which bounds the paths that a hub starts.
    """
    e = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())
    n = colours or colours_of(e.count())
    nodes = e.select(F.col("u").alias("name")).union(e.select("v")).distinct()
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id())).withColumn("colour", F.pmod(F.xxhash64("name"), F.lit(n)))
    ids = e
    for c, k in (("u", "a"), ("v", "b")):
        ids = ids.join(nodes.select(F.col("name").alias(c), F.col("id").alias(k), F.col("colour").alias(f"_{k}")), c).drop(c)

    def task(*three):
        i = F.array_sort(F.array(*three))
        return (i[0] * n + i[1]) * n + i[2]

    kind = edges.schema["src"].dataType
    every = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    links = ids.withColumn("_c", F.explode(every)).select(task("_a", "_b", "_c").alias("task"), "a", "b", F.lit(None).cast(kind).alias("name"))
    known = nodes.withColumn("_p", F.explode(every)).withColumn("_q", F.explode(F.sequence(F.col("_p"), F.lit(n - 1).cast("long"))))
    known = known.select(task("colour", "_p", "_q").alias("task"), F.col("id").alias("a"), F.col("colour").alias("b"), "name")
    schema = StructType([StructField(c, kind) for c in "abc"])
    arrow = to_arrow_schema(schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own = t.filter(pc.is_valid(t["name"])).sort_by("name").combine_chunks()  # a node's code is its place by name
        rows = t.filter(pc.is_null(t["name"]))
        if not rows.num_rows:
            return
        first = t["task"][0].as_py()
        del t
        id_, colour, size = own["a"].to_numpy(), own["b"].to_numpy(), own.num_rows
        by = np.argsort(id_)
        ends_ = [by[np.searchsorted(id_, rows[c].to_numpy(), sorter=by)] for c in "ab"]
        del rows
        at = np.argsort(np.bincount(ends_[0], minlength=size) + np.bincount(ends_[1], minlength=size), kind="stable")
        place = np.empty(size, np.int64)
        place[at] = np.arange(size)
        x, y = (place[c] for c in ends_)
        keys = np.sort(np.minimum(x, y) * size + np.maximum(x, y))
        del x, y, ends_
        low, high = keys // size, keys % size
        last = np.searchsorted(low, np.arange(size), "right")
        starts = np.bincount(low, minlength=size)
        n_paths = np.where(starts[high] > 0, last[low] - np.arange(len(keys)) - 1, 0)
        wanted = [first // (n * n), first // n % n, first % n]
        for s, e in pieces(n_paths):
            edge, other = spread(n_paths[s:e], np.arange(s, e) + 1)
            edge = edge + s
            asked = high[edge] * size + high[other]
            hit = np.searchsorted(keys, asked)
            hit = np.flatnonzero(keys[np.minimum(hit, len(keys) - 1)] == asked)
            three = np.sort(at[np.stack([low[edge[hit]], high[edge[hit]], high[other[hit]]], 1)], axis=1)
            if wanted[0] == wanted[1] or wanted[1] == wanted[2]:  # such a task sees triangles of fewer colours, too
                three = three[(np.sort(colour[three], axis=1) == wanted).all(1)]
            if len(three):
                yield from pa.Table.from_arrays([own["name"].take(pa.array(c)).combine_chunks().cast(f.type) for c, f in zip(three.T, arrow)], schema=arrow).combine_chunks().to_batches()

    # both annotations by name: the future import would hide them from Spark
    meet.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return links.union(known).groupBy("task").applyInArrow(meet, schema)


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """(nodes): the sets of k nodes that are all linked, each once, sorted; k at least 2.

    Edges point from lower to higher degree, so a node has few that follow it. A clique carries those that follow all
    its nodes and grows by each of them: a step is a join of cliques with their last node's followers.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    d = degrees(edges)
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    e = e.join(d.select(F.col("node").alias("u"), F.col("degree").alias("_du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("_dv")), "v")
    up = F.struct("_du", "u") < F.struct("_dv", "v")
    e = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y"))
    follow = cut(e.groupBy("x").agg(F.collect_list("y").alias("after")))  # at most about the root of twice the edges
    held = follow.select(F.array("x").alias("nodes"), F.col("after").alias("left"))
    for size in range(2, k + 1):
        grown = held.select("nodes", "left", F.explode("left").alias("x"))
        if size == k:
            return grown.select(F.array_sort(F.concat("nodes", F.array("x"))).alias("nodes"))
        grown = grown.join(follow, "x").select(F.concat("nodes", F.array("x")).alias("nodes"), F.array_intersect("left", "after").alias("left"))
        held = cut(grown.where(F.size("left") >= k - size))


def clique_communities(edges: DataFrame, k: int = 3) -> DataFrame:
    """(node, community): cliques of k nodes that share k - 1; a node may be in several communities.

    A community is named by the smallest k - 1 nodes that it shares, joined by bars.
    """
    clean = F.transform("nodes", lambda x: F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), r"\|", r"\\|"))
    parts = F.transform(F.reverse(F.sequence(F.lit(0), F.lit(k - 1))), lambda i: F.array_join(F.filter(clean, lambda x, j: j != i), "|"))
    t = cut(cliques(edges, k).select("nodes", parts.alias("parts")))
    links = t.select(F.element_at("parts", 1).alias("src"), F.explode(F.slice("parts", 2, k - 1)).alias("dst"))
    c = components(links).withColumnsRenamed({"node": "_part", "component": "community"})
    return t.withColumn("_part", F.element_at("parts", 1)).join(c, "_part").select(F.explode("nodes").alias("node"), "community").distinct()


def clique_labels(edges: DataFrame, k: int = 3) -> DataFrame:
    """(node, community): one community a node, the last by name of those that it is in."""
    return clique_communities(edges, k).groupBy("node").agg(F.max("community").alias("community"))


def frequencies(runs: DataFrame, total: int, name: str) -> DataFrame:
    """(node, name): the share of runs that hold a node."""
    return runs.groupBy("node").agg((F.count_distinct("run") / F.lit(total)).alias(name))


def randomised(noisy: DataFrame, random: DataFrame, n_noisy: int, n_random: int) -> DataFrame:
    """(node, robustness, specificity) of runs with noisy edges and with random terminals; 0 where a node is in none."""
    return frequencies(noisy, n_noisy, "robustness").join(frequencies(random, n_random, "specificity"), "node", "full_outer").fillna(0.0, ["robustness", "specificity"])


def run_statistics(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """(run, size, mean_log_degree, ks): ks is the largest distance between the degree distributions of a run and of all nodes.

    Degrees are counted before the windows run, so these see a row per run and different degree.
    """
    return degree_statistics(runs, kept(degrees(edges), "degrees"))


def degree_statistics(runs: DataFrame, d: DataFrame) -> DataFrame:
    """run_statistics of given degrees (node, degree)."""
    all_ = d.groupBy("degree").agg(F.count("*").alias("n"))
    up = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = all_.select("degree", (F.sum("n").over(up) / F.sum("n").over(Window.partitionBy())).alias("f"))
    own = runs.join(d, "node").groupBy("run", "degree").agg(F.count("*").alias("n"))
    sizes = own.groupBy("run").agg(F.sum("n").alias("size"), (F.sum(F.col("n") * F.log2("degree")) / F.sum("n")).alias("mean_log_degree"))
    grid = sizes.select("run").crossJoin(whole)  # runs x different degrees
    w = Window.partitionBy("run").orderBy("degree").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = grid.join(own, ["run", "degree"], "left").withColumn("_c", F.sum(F.coalesce("n", F.lit(0))).over(w))
    far = f.join(sizes, "run").groupBy("run").agg(F.max(F.abs(F.col("_c") / F.col("size") - F.col("f"))).alias("ks"))
    return sizes.join(far, "run")


def robust_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run, size, min_robustness, mean_robustness, max_specificity, mean_specificity, mean_log_degree, std_log_degree, ks) of nodes(run, node, robustness, specificity).

    Degrees are those in the whole graph; nodes that it lacks are left out. std is of the sample, null for one node.
    """
    d = kept(degrees(edges), "degrees")
    own = nodes.join(d, "node")
    log = F.log2("degree")
    whole = own.groupBy("run").agg(F.min("robustness").alias("min_robustness"), F.avg("robustness").alias("mean_robustness"), F.max("specificity").alias("max_specificity"), F.avg("specificity").alias("mean_specificity"), F.stddev_samp(log).alias("std_log_degree"))
    return degree_statistics(nodes.select("run", "node"), d).join(whole, "run")


def artificial_prizes(prizes: DataFrame, frequency: DataFrame, similarity: float, scale: float = 1.0, power: float = 2.0) -> DataFrame:
    """(name, prize): the given prizes, and scale (similarity x frequency)^power for other nodes that forests hold."""
    own = prizes.groupBy("name").agg(F.max("prize").alias("prize"))
    new = frequency.join(own, F.col("node") == F.col("name"), "left_anti").select(F.col("node").alias("name"), (F.lit(scale) * F.pow(F.lit(similarity) * F.col("frequency"), power)).alias("prize"))
    return own.unionByName(new)


def top_terms(terms: DataFrame, level: DataFrame) -> DataFrame:
    """(term_id, top): every term below (or at) the given ones, with the one above it; a join per level of the tree."""
    seen = frontier = cut(level.select("term_id", F.col("term_id").alias("top")))
    while True:
        frontier = cut(terms.join(frontier.select(F.col("term_id").alias("parent_id"), "top"), "parent_id").select("term_id", "top"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def two_levels(terms: DataFrame, level: DataFrame) -> DataFrame:
    """(term_id, first, second): every term below (or at) the given ones, with the one above it and that one's child on the way (null for the given ones)."""
    seen = frontier = cut(level.select("term_id", F.col("term_id").alias("first"), F.lit(None).cast(level.schema["term_id"].dataType).alias("second")))
    while True:
        above = frontier.withColumnRenamed("term_id", "parent_id")
        frontier = cut(terms.join(above, "parent_id").select("term_id", "first", F.coalesce("second", "term_id").alias("second")))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def best_second(scored: DataFrame, places: DataFrame) -> DataFrame:
    """(gene, first, second, score): of the first-level term of the largest sum of scores the second-level term of the largest one; ties to the smaller term.

    One pass over the scored rows: sums by second are added up to those by first.
    """
    sums = scored.where("gene IS NOT NULL").join(places, "term_id").groupBy("gene", "first", "second").agg(F.sum("score").alias("score"))
    own = F.when(F.col("second").isNotNull(), F.struct((-F.col("score")).alias("less"), "second"))
    firsts = sums.groupBy("gene", "first").agg(F.sum("score").alias("all"), F.min(own).alias("best"))
    found = firsts.groupBy("gene").agg(F.min(F.struct(-F.col("all"), "first", "best")).alias("_f")).where("_f.best IS NOT NULL")
    return found.select("gene", F.col("_f.first").alias("first"), F.col("_f.best.second").alias("second"), (-F.col("_f.best.less")).alias("score"))


def tiers(gene_terms: DataFrame, solid: list[str], sketchy: list[str]) -> DataFrame:
    """Adds score: 3 for solid evidence, 2 for sketchy, 1 for the rest."""
    return gene_terms.withColumn("score", F.when(F.col("evidence").isin(*solid), 3).when(F.col("evidence").isin(*sketchy), 2).otherwise(1))


def best_term(scored: DataFrame, tops: DataFrame) -> DataFrame:
    """(gene, term, score): the top term of the largest sum of scores; ties to the smaller term."""
    sums = scored.join(tops, "term_id").groupBy("gene", F.col("top").alias("term")).agg(F.sum("score").alias("score"))
    w = Window.partitionBy("gene").orderBy(F.desc("score"), "term")
    return sums.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def k_modes(rows: DataFrame, key: str, columns: list[str], k: int, rounds: int = 20) -> DataFrame:
    """(key, cluster, distance): boolean rows by their nearest of k modes, each column's majority among its rows.

    The first modes are the most frequent different rows. Only k rows of modes reach the driver.
    """
    distinct = cut(rows.groupBy(*columns).agg(F.count("*").alias("_w")))
    modes = [tuple(bool(r[c]) for c in columns) for r in distinct.orderBy(F.desc("_w"), *columns).limit(k).collect()]

    def placed(df: DataFrame) -> DataFrame:
        far = [F.struct(sum((F.col(c) != F.lit(m)).cast("int") for c, m in zip(columns, mode)).alias("distance"), F.lit(i).alias("cluster")) for i, mode in enumerate(modes)]
        return df.withColumn("_near", F.least(*far) if len(far) > 1 else far[0])

    for _ in range(rounds):
        majority = placed(distinct).groupBy("_near.cluster").agg(*((2 * F.sum(F.when(F.col(c), F.col("_w")).otherwise(0)) > F.sum("_w")).alias(c) for c in columns)).collect()
        found = {r["cluster"]: tuple(r[c] for c in columns) for r in majority}
        new = [found.get(i, m) for i, m in enumerate(modes)]
        if new == modes:
            break
        modes = new
    return placed(rows).select(key, "_near.cluster", "_near.distance")
