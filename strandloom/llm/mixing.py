"""Mixing sources to target weights along a low-discrepancy schedule; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, ranked, stored

WORD = "[^\\x20\\x09-\\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) for sizes(source, source_size).

    The sources in code point order, null last, take the weights in turn. Their targets sum to share times all
    sizes and stop at `most` times the source's size; what exceeds is shared again by weight. That is a level
    that rises until it fills: sources fill up in the order of cap over weight, the rest get weight times level.
    """
    all_of = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_cap = Window.orderBy("_fill", "_i")
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("double")
    out = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("weight", w)
    out = out.withColumn("_cap", F.col("source_size") * most).withColumn("_fill", F.col("_cap") / F.col("weight"))
    out = out.withColumn("_left", F.sum("source_size").over(all_of) * share - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
    out = out.withColumn("_w", F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    out = out.withColumn("_full", F.col("_left") / F.col("_w") >= F.col("_fill"))
    level = F.max(F.when(~F.col("_full"), F.col("_left") / F.col("_w"))).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("_level", level)
    return out.withColumn("target", F.when(F.col("_full") | F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_level")))).select("source", "source_size", "weight", "target")


def points(slots: int, spark: SparkSession) -> DataFrame:
    """(slot, at): the van der Corput points of base 2, numbers with reversed bits, that visit 0..slots-1 once each, evenly."""
    bits = max(1, (max(1, slots) - 1).bit_length())
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    return spark.range(1 << bits).select(F.col("id").alias("slot"), point.alias("at")).where(F.col("at") < slots)


def schedule(needs: DataFrame, slots: int, reach: int = 20_000) -> DataFrame:
    """(slot, _s, place, rank): the source that a slot's point falls to, the point's place in the source's interval, and the
    slot's number among the source's.

    needs: (_s, first, need), the intervals that the sources take of 0..slots-1, their cumulative weights. Intervals
    and points meet in ranges of `reach` positions, each read once in order, whatever the number of sources.
    """
    drawn = points(slots, needs.sparkSession).select("slot", "at", F.lit(1).alias("kind"), F.floor(F.col("at") / reach).alias("_r"), F.lit(None).cast("string").alias("_s"), F.lit(None).cast("long").alias("first"))
    held = needs.where("need > 0").select("_s", "first", F.explode(F.sequence(F.floor(F.col("first") / reach), F.floor((F.col("first") + F.col("need") - 1) / reach))).alias("_r"))
    starts = held.select(F.lit(None).cast("long").alias("slot"), F.greatest(F.col("first"), F.col("_r") * reach).alias("at"), F.lit(0).alias("kind"), "_r", "_s", "first")
    before = Window.partitionBy("_r").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = drawn.unionByName(starts).withColumn("_own", F.last(F.when(F.col("kind") == 0, F.struct("_s", "first")), ignorenulls=True).over(before))
    drawn = both.where("kind = 1").select("slot", "_own._s", (F.col("at") - F.col("_own.first")).alias("place"))
    return ranked(drawn, ["_s"], ["slot"], "rank", slots, bucket=F.floor(F.col("slot") / 20_000))


def mix(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, slot) for every row; options and results as of drawn_words()."""
    return drawn_words(documents, **options).drop("_h")


def drawn_words(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 9) -> DataFrame:
    """(_h, doc_id, source, size, source_size, target, taken, slot) for every row; _h is a hash of doc_id, text and seed.

    Each source's documents, shuffled by a hash of doc_id, text and seed, lie end to end on a line of words that
    is cut into blocks of `block` words. A source needs as many slots of the schedule as blocks fill its target, and has
    an interval as long. The point of a slot says, by the interval it falls to, whose slot it is, and by its place there
    which block is taken, counted on from the start after the last one; the source's last slots in the schedule's order are
    cut where its target is full. taken is how many of a document's words lie in taken blocks, repeats counted: never over
    most (2) times its size, and per source the target rounded down. slot is the first slot that holds words of the
    document; null if none does. A null text has no words; null sources are a source, the last one.
    Repeated rows are mixed as often as they come; no rows give no rows.
    """
    size = words_in(F.col("text"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_h"))
    rows = stored(rows, "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, weights, share, most)
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    take = F.floor(F.col("target") + 1e-6).cast("long")
    passes = F.floor(take / F.greatest("source_size", F.lit(1))).cast("long")
    rest = F.when(F.col("source_size") > 0, take % F.greatest("source_size", F.lit(1))).otherwise(0)
    goal = goal.select("*", n_blocks.alias("n_blocks"), take.alias("take"), passes.alias("passes"), rest.alias("rest"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_s"))
    goal = goal.withColumn("need", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / block))
    goal = stored(goal.withColumn("first", F.sum("need").over(Window.orderBy("_s")) - F.col("need")), "goal")
    totals = goal.agg(F.sum("need"), F.count("*")).first()
    slots, n_rows = int(totals[0] or 0), rows.count()
    drawn = schedule(goal, slots).join(goal.select("_s", "n_blocks", "take", "source_size"), "_s")
    drawn = stored(drawn.withColumn("b", F.col("place") % F.greatest("n_blocks", F.lit(1))), "drawn")
    # a line's last block is short; its visits, most + 1 at most, come off what the slots before give
    short = F.col("source_size") - (F.col("n_blocks") - 1) * block
    visits = drawn.where("b = n_blocks - 1").groupBy("_s").agg(F.collect_list("rank").alias("visits"))
    drawn = drawn.join(visits, "_s", "left")
    given_before = F.col("rank") * block - (block - short) * F.coalesce(F.size(F.filter("visits", lambda r: r < F.col("rank"))), F.lit(0))
    own = F.when(F.col("b") == F.col("n_blocks") - 1, short).otherwise(block)
    words = F.least(own, F.greatest(F.col("take") - given_before, F.lit(0)))
    given = drawn.select("_s", "b", F.struct((F.col("b") * block + words).alias("upto"), "slot").alias("visit"))
    given = given.groupBy("_s", "b").agg(F.collect_list("visit").alias("given"))  # most + 1 at most
    # where each document lies on its source's line
    tagged = rows.withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    n_buckets = max(1, -(-n_rows // 20_000))
    tagged = tagged.withColumn("_b", F.pmod(F.xxhash64("_h", "doc_id"), F.lit(n_buckets)).cast("int"))
    within = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = tagged.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    lying = tagged.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["_s", "_b"]).withColumn("at", F.col("at") + F.col("_o"))
    lying = lying.withColumn("to", F.col("at") + F.col("size"))
    last = F.floor((F.greatest("to", F.col("at") + 1) - 1) / block)
    parts = lying.where("size > 0").select("_s", "at", "to", F.explode(F.sequence(F.floor(F.col("at") / block), last)).alias("b"))
    inside = F.transform("given", lambda v: F.struct(F.greatest(F.least(F.col("to"), v["upto"]) - F.greatest(F.col("at"), F.col("b") * block), F.lit(0)).cast("long").alias("n"), v["slot"].alias("slot")))
    got = parts.join(given, ["_s", "b"]).select("_s", "at", F.filter(inside, lambda v: v["n"] > 0).alias("in"))
    got = got.select("_s", "at", F.aggregate("in", F.lit(0).cast("long"), lambda s, v: s + v["n"]).alias("taken"), F.array_min(F.transform("in", lambda v: v["slot"])).alias("slot"))
    got = got.groupBy("_s", "at").agg(F.sum("taken").alias("taken"), F.min("slot").alias("slot"))
    spots = lying.select("_h", "doc_id", "source", "size", "_s", F.when(F.col("size") > 0, F.col("at")).alias("at"))
    out = spots.join(got, ["_s", "at"], "left").join(goal.select("_s", "source_size", "target"), "_s")
    return out.select("_h", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot")


def mixed_documents(documents: DataFrame, seed: int = 9, **options) -> DataFrame:
    """The documents as often as the mix takes them, in whole numbers: taken over size, rounded; those without words once.

    Columns as given. Equal rows share the largest of their numbers.
    """
    m, times_, copy = apart(documents, "_m", "_times", "_copy")
    ratio = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    times = drawn_words(documents, seed=seed, **options).groupBy(F.col("_h").alias(m)).agg(F.max(ratio).alias(times_)).where(F.col(times_) > 0)
    out = documents.join(times, F.xxhash64("doc_id", "text", F.lit(seed)) == F.col(m))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), times_))).select(*documents.columns)
