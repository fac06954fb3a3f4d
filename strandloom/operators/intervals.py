"""Genomic intervals: half-open [start_pos, end_pos) rows on a chromosome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import along
from .prefix import base_range, in_ranges, running, shifted

BIN = 10_000


def tag() -> Column:
    return F.concat(F.col("chrom"), F.lit(":"), F.col("start_pos"), F.lit("-"), F.col("end_pos"))


def length() -> Column:
    return F.col("end_pos") - F.col("start_pos")


def anchors(regions: DataFrame) -> DataFrame:
    """Adds mid, tss and tes positions: tss is the start on +, else the end; tes the start on -, else the end."""
    s, e, strand = F.col("start_pos"), F.col("end_pos"), F.col("strand")
    return regions.withColumns({"mid": F.floor((s + e) / 2).cast("long"), "tss": F.when(strand == "+", s).otherwise(e), "tes": F.when(strand == "-", s).otherwise(e)})


def tss_regions(regions: DataFrame) -> DataFrame:
    """One-base regions at the 5' ends."""
    start = F.when(F.col("strand") == "-", F.col("end_pos") - 1).otherwise(F.col("start_pos"))
    return regions.withColumn("start_pos", start).withColumn("end_pos", F.col("start_pos") + 1)


def widen(regions: DataFrame, w: int) -> DataFrame:
    return regions.withColumns({"start_pos": F.col("start_pos") - w, "end_pos": F.col("end_pos") + w})


def slide(regions: DataFrame, s: int) -> DataFrame:
    """Moves right on +, left on -."""
    by = F.when(F.col("strand") == "-", -s).otherwise(s) if "strand" in regions.columns else F.lit(s)
    return regions.withColumns({"start_pos": F.col("start_pos") + by, "end_pos": F.col("end_pos") + by})


def transform(regions: DataFrame, w: int, s: int) -> DataFrame:
    return slide(widen(regions, w), s)


def in_interval(regions: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return regions.where((F.col("chrom") == chrom) & (F.col("end_pos") > start) & (F.col("start_pos") < end))


def binned(regions: DataFrame, size: int = BIN) -> DataFrame:
    """One row for each bin that a region touches."""
    return regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_pos") / size), F.floor((F.greatest("end_pos", F.col("start_pos") + 1) - 1) / size))))


def overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, size: int = BIN) -> DataFrame:
    """(a_id, b_id, overlap) of all overlapping pairs, by an equi-join on chromosome and bin.

    A pair counts in the bin where its overlap starts, so no distinct is needed.
    """
    x = binned(a, size).select(a_id, F.col("chrom").alias("_c"), F.col("start_pos").alias("_as"), F.col("end_pos").alias("_ae"), F.col("_bin").alias("_ab"))
    y = binned(b, size).select(b_id, F.col("chrom").alias("_d"), F.col("start_pos").alias("_bs"), F.col("end_pos").alias("_be"), "_bin")
    start = F.greatest("_as", "_bs")
    hit = (F.col("_c") == F.col("_d")) & (F.col("_ab") == F.col("_bin")) & (F.col("_as") < F.col("_be")) & (F.col("_bs") < F.col("_ae")) & (F.floor(start / size) == F.col("_bin"))
    return x.join(y, hit).select(a_id, b_id, (F.least("_ae", "_be") - start).alias("overlap"))


def overlapping(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of a that overlap b, as often as a has them: the regions, each once, are matched, then the rows by theirs."""
    place = ["chrom", "start_pos", "end_pos"]
    y = binned(b, size).select(F.col("chrom").alias("_d"), F.col("start_pos").alias("_bs"), F.col("end_pos").alias("_be"), F.col("_bin").alias("_bb"))
    x = binned(a.select(*place).distinct(), size)
    hit = (x["chrom"] == y["_d"]) & (x["_bin"] == y["_bb"]) & (x["start_pos"] < y["_be"]) & (y["_bs"] < x["end_pos"])
    return a.join(x.join(y, hit, "left_semi").select(*place).distinct(), place, "left_semi")


def adjacent(regions: DataFrame, key: str, hops: int = 1) -> DataFrame:
    """(key, next): pairs `hops` apart on a chromosome."""
    rows = regions.select(key, "chrom", "start_pos", "end_pos").withColumn("_r", base_range(F.col("start_pos")))
    return shifted(rows, ["chrom"], ["start_pos", "end_pos", key], F.col(key), "next", hops).where(F.col("next").isNotNull()).select(key, "next")


def ordered(regions: DataFrame, key: str) -> DataFrame:
    """Adds place, from 1 on: chromosomes 1-22, X and Y first, then by the chromosome's name without chr as text, start, end and key."""
    standard = F.col("chrom").isin(*(f"chr{c}" for c in (*range(1, 23), "X", "Y")))
    order = {"_odd": ~standard, "_name": F.regexp_replace("chrom", "^chr", "")}
    rows = in_ranges(regions.withColumns(order), *order, "start_pos", "end_pos", key)
    return running(rows, [], [*order, "start_pos", "end_pos", key], F.lit(1).cast("long"), F.sum, "place").drop(*order, "_r")


def previous(queries: DataFrame, features: DataFrame, query: str, feature: str) -> DataFrame:
    """For each query position the last feature that starts before it: a union sorted in ranges, no pair is made."""
    q = queries.select(F.col("chrom"), F.col("start_pos").alias("p"), F.col(query).alias("q"), F.lit(None).cast("string").alias("f"), F.lit(0).alias("kind"))
    f = features.select("chrom", F.col("start_pos").alias("p"), F.lit(None).cast("string").alias("q"), F.col(feature).alias("f"), F.lit(1).alias("kind"))
    rows = q.union(f).withColumn("_r", base_range(F.col("p")))
    last = running(rows, ["chrom"], ["p", "kind", "f"], F.when(F.col("kind") == 1, F.struct("p", "f")), F.max, "before")
    return last.where("kind = 0").select(F.col("q").alias(query), F.col("before.f").alias(feature))


def clusters(regions: DataFrame, by: list[str]) -> DataFrame:
    """Unions of touching or overlapping regions per key, with how many went in. Equal regions are counted first."""
    once = regions.groupBy(*by, "start_pos", "end_pos").agg(F.count("*").alias("n")).withColumn("_r", base_range(F.col("start_pos")))
    order = ["start_pos", "end_pos"]
    marked = running(once, by, order, F.col("end_pos"), F.max, "_reach", before=True).withColumn("_new", F.when(F.col("_reach") >= F.col("start_pos"), 0).otherwise(1))
    return running(marked, by, order, F.col("_new"), F.sum, "_i").groupBy(*by, "_i").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum("n").alias("n")).drop("_i")


def nearest(regions: DataFrame, chrom: str, position: int, k: int) -> DataFrame:
    """The k regions whose middles are nearest to a position; ties in genome order."""
    d = F.floor((F.col("start_pos") + F.col("end_pos")) / 2).cast("long") - position
    return regions.where(F.col("chrom") == chrom).withColumn("distance", d).orderBy(F.abs("distance"), "start_pos", "end_pos").limit(k)


def parsed(rows: DataFrame, tag: str) -> DataFrame:
    """Adds chrom, start_pos, end_pos and strand of tags such as chr1:5-9_+; without strand, null."""
    form = r"^(chr.{1,2}):([0-9]+)-([0-9]+)_?([+-]?)$"
    at = [F.regexp_extract(tag, form, k) for k in range(1, 5)]
    return rows.withColumns({"chrom": F.nullif(at[0], F.lit("")), "start_pos": at[1].try_cast("long"), "end_pos": at[2].try_cast("long"), "strand": F.nullif(at[3], F.lit(""))})


def is_sorted(regions: DataFrame, order: str) -> DataFrame:
    """(chrom, sorted): whether each start lies after the one before it in the given order."""
    rows = shifted(in_ranges(regions.select("chrom", "start_pos", order), "chrom", order), ["chrom"], [order], F.col("start_pos"), "_before", -1)
    return rows.groupBy("chrom").agg(F.bool_and(F.col("_before").isNull() | (F.col("start_pos") > F.col("_before"))).alias("sorted"))


def stranded(regions: DataFrame) -> DataFrame:
    """With the strand as a part of chrom, so that only one strand's regions overlap."""
    return regions.withColumn("chrom", F.concat("chrom", "strand"))


def distances(regions: DataFrame, chrom: str, position: int, strand: str, anchor: Column) -> DataFrame:
    """Adds distance from a position on a chromosome to the regions' anchors, negated on -."""
    d = anchor - position
    return regions.where(F.col("chrom") == chrom).withColumn("distance", -d if strand == "-" else d)


def adjacent_to(regions: DataFrame, chrom: str, position: int, k: int) -> DataFrame:
    """The k regions that start before a position and the k from it on."""
    own = regions.where(F.col("chrom") == chrom)
    names = ["start_pos", "end_pos", *(c for c in regions.columns if c.endswith("_id"))]
    before = own.where(F.col("start_pos") < position).orderBy(*(F.desc(n) for n in names)).limit(k)
    return before.union(own.where(F.col("start_pos") >= position).orderBy(*names).limit(k))


def in_order(regions: DataFrame, strictly: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The regions that end after they start (or there, if not strictly), and the others, None where there are none."""
    good = F.col("start_pos") < F.col("end_pos") if strictly else F.col("start_pos") <= F.col("end_pos")
    odd = regions.where(~good)
    return regions.where(good), None if odd.isEmpty() else odd


def by_parts(regions: DataFrame, features: DataFrame, sums: Callable[[DataFrame, DataFrame], DataFrame], pairs: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """sums of the regions and features whose ends are in order, and with them pairs of the others, where there are any."""
    (own, odd), (kept, turned) = in_order(regions), in_order(features, strictly=False)
    out = sums(own, kept)
    if odd is not None:
        out = out.unionByName(pairs(odd, features))
    if turned is not None:
        out = out.unionByName(pairs(own, turned))
    return out


def feature_counts(regions: DataFrame, features: DataFrame, key: str, feature: str, kinds: list[str]) -> DataFrame:
    """(key, a column per kind): how many features of each kind a region overlaps; 0 where none. A row per row of regions.

    The counts come from running sums along the places. Only regions without length, and features that end before they
    start, are joined in pairs.
    """
    of = F.lit(None).cast("int")
    for i, k in enumerate(kinds):
        of = F.when(F.col(feature) == k, i).otherwise(of)
    names = [f"_n{i}" for i in range(len(kinds))]
    none = [F.lit(0).cast("long").alias(n) for n in names]

    def sums(own: DataFrame, kept: DataFrame) -> DataFrame:
        placed = along.totals(own, kept.withColumn("_kind", of), key, len(kinds)).select(key, "_first", *names)
        return placed.union(own.where("chrom IS NULL").select(key, F.lit(1).cast("long"), *none))

    def pairs(own: DataFrame, others: DataFrame) -> DataFrame:
        return overlaps(own, others, key, feature).select(key, F.lit(0).cast("long").alias("_first"), *(F.when(F.col(feature) == k, 1).otherwise(0).cast("long").alias(n) for n, k in zip(names, kinds)))

    others = regions.where(~F.coalesce(F.col("start_pos") < F.col("end_pos"), F.lit(False))).select(key, F.lit(1).cast("long").alias("_first"), *none)
    counts = by_parts(regions, features, sums, pairs).union(others).groupBy(key).agg(F.sum("_first").cast("int").alias("_m"), *(F.sum(F.when(F.col(key).isNotNull(), F.col(n)).otherwise(0)).alias(k) for n, k in zip(names, kinds)))
    return counts.withColumn("_m", F.explode(F.array_repeat(F.lit(0), F.col("_m")))).drop("_m")


def overlap_totals(regions: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(key, n, bases): how many features the regions of a key overlap, and by how many bases in all; no row where none.

    Both come from running sums along the places.
    """

    def sums(own: DataFrame, kept: DataFrame) -> DataFrame:
        return along.totals(own, kept.withColumn("_kind", F.lit(0)), key, 1).select(key, F.col("_n0").alias("n"), "bases")

    def pairs(own: DataFrame, others: DataFrame) -> DataFrame:
        return overlaps(own, others.withColumn("_f", F.lit(0)), key, "_f").select(key, F.lit(1).cast("long").alias("n"), F.col("overlap").cast("long").alias("bases"))

    return by_parts(regions, features, sums, pairs).groupBy(key).agg(F.sum("n").alias("n"), F.sum("bases").alias("bases")).where("n > 0")


def validated(regions: DataFrame) -> DataFrame:
    """With chr before the chromosome; an end that is not after the start, or an unknown strand, is an error."""
    strand = F.col("strand").isin("+", "-", ".") | F.col("strand").isNull() if "strand" in regions.columns else F.lit(True)
    good = F.coalesce(F.col("end_pos") > F.col("start_pos"), F.lit(False)) & strand
    end = F.when(good, F.col("end_pos")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not a region:"), "chrom", "start_pos", "end_pos")))
    return regions.withColumns({"chrom": prefixed(F.col("chrom")), "end_pos": end})


def prefixed(chrom: Column, with_chr: bool = True) -> Column:
    """Chromosome names with chr, or without."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return F.concat(F.lit("chr"), bare) if with_chr else bare


def anchor_regions(regions: DataFrame, anchor: str) -> DataFrame:
    """The one-base regions at start, end, tss or tes; at mid one of no length."""
    s, e, back = F.col("start_pos"), F.col("end_pos"), F.col("strand") == "-"
    first = {"start": s, "end": e - 1, "mid": F.floor((s + e) / 2).cast("long"), "tss": F.when(back, e - 1).otherwise(s), "tes": F.when(back, s).otherwise(e - 1)}[anchor]
    return regions.withColumn("start_pos", first).withColumn("end_pos", F.col("start_pos") + (0 if anchor == "mid" else 1))


def unstranded(regions: DataFrame) -> DataFrame:
    return regions.drop("strand")


def unversioned(gene: Column) -> Column:
    """A gene id without what follows its first dot."""
    return F.substring_index(gene, ".", 1)


def annotations(regions: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(key, tss, tes, exon, intron, intergenic, label): overlaps per kind of features(feature, ...), intergenic 1 where there
    are none, and one label by priority: only tss, only tes, both, exon, intron, intergenic."""
    kinds = ["tss", "tes", "exon", "intron"]
    n = feature_counts(regions, features, key, "feature", kinds)
    tss, tes, exon, intron = (F.col(k) > 0 for k in kinds)
    label = F.when(tss & ~tes, "tss").when(tes & ~tss, "tes").when(tss & tes, "tss_tes").when(exon, "exon").when(intron, "intron").otherwise("intergenic")
    return n.withColumn("intergenic", (~(tss | tes | exon | intron)).cast("int")).withColumn("label", label)
