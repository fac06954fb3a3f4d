"""How far the sources of a language differ in their words, by bitmaps of the terms at each count."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored

# Bytes of UTF-8 outside [\x00-\x40\x5B-\x60\x7B-\x7F] make terms; of them A-Z are lower-cased, the others become spaces.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
WORD = 64  # terms of a word of bits
PIECE = 4_000_000  # bytes of a text that are split at once


def terms_in(text: bytes, counts: Counter) -> None:
    """Counts a text's terms, in pieces cut between terms."""
    at = 0
    while at < len(text):
        cut = GAP.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        counts.update(text[at:end].translate(TERMS).split())
        at = end


def counted(documents: DataFrame, held: int = 500_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed within tasks as far as `held` of them
    go; a group without terms has one row of an empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], dict[bytes, int]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in sums.items():
                terms, both = [b"", *own], np.array([0, *own.values()], np.int64)
                for lo in range(0, len(terms), 20_000):
                    part = terms[lo : lo + 20_000]
                    named = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*named, pa.array(part, pa.binary()), pa.array(both[lo : lo + 20_000] >> 24), pa.array(both[lo : lo + 20_000] & (1 << 24) - 1)], ["lang", "source", "term", "n", "docs"])
            sums.clear()

        size, docs = 0, 0
        for batch in batches:
            for part in sliced(batch):
                for text, lang, source in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source"))):
                    own = sums.setdefault((lang, source), {})
                    counts: Counter = Counter()
                    terms_in(text, counts)
                    size -= len(own)
                    for t, n in counts.items():  # occurrences above, documents in the lower 24 bits
                        own[t] = own.get(t, 0) + (n << 24) + 1
                    size, docs = size + len(own), docs + 1
                    if size > held or docs > 1 << 23:
                        yield from told()
                        size = docs = 0
        yield from told()

    filled = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))).withColumn("text", F.col("text").cast("binary"))
    return filled.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), in whole numbers."""
    over = F.lit(1_000_000_000).cast("decimal(38,0)") * (n + 5).cast("decimal(20,0)")
    return F.call_function("div", over, (total + 5 * terms).cast("decimal(20,0)")) + 1


def met(left: pa.Table, right: pa.Table, rows: int = 1024) -> dict[str, np.ndarray]:
    """(a, b, value) of sources of one block of terms: the joint cells of the levels of two sources, each counted by AND and
    popcount, times the difference of their shares. Levels are (source, word, bits, p)."""
    sums: Counter = Counter()

    def read(t: pa.Table) -> dict[str, np.ndarray]:
        order = np.lexsort((t["source_no"].to_numpy(), t["word"].to_numpy()))
        return {c: t[c].to_numpy()[order] for c in ("source_no", "word", "p")} | {"bits": t["bits"].to_numpy()[order].view(np.uint64)}

    a, b = read(left), read(right)
    for w in np.intersect1d(a["word"], b["word"]):
        i, j = (slice(*np.searchsorted(x["word"], [w, w + 1])) for x in (a, b))
        names, starts = np.unique(b["source_no"][j], return_index=True)
        for lo in range(i.start, i.stop, rows):
            k = slice(lo, min(lo + rows, i.stop))
            cells = np.bitwise_count(a["bits"][k, None] & b["bits"][None, j]).astype(np.int64)
            cells *= np.abs(a["p"][k, None] - b["p"][None, j])
            per = np.add.reduceat(cells, starts, axis=1)
            own, first = np.unique(a["source_no"][k], return_index=True)
            per = np.add.reduceat(per, first, axis=0)
            for x, line in zip(own.tolist(), per):
                for y, v in zip(names.tolist(), line.tolist()):
                    sums[x, y] += v
    keys = [x for x in sums if x[0] != x[1]]
    return {"a": np.array([x[0] for x in keys], np.int64), "b": np.array([x[1] for x in keys], np.int64), "value": np.array([sums[x] for x in keys], np.int64)}


def divergences(documents: DataFrame, least: int = 30, top: int = 50, block: int = 4096, sources: int = 32) -> DataFrame:
    """(lang, source, part, item, value, rank) as the query's contract has them.

    Terms that `least` documents of a language hold are dealt by a hash to blocks of about `block`, and within one, by falling
    count, to words of 64. A source's terms of one count in a word are a bitmap; those of count zero are what the others
    leave. A task meets the bitmaps of one block of terms of `sources` sources with those of as many others, so no task
    holds a language; only the pairs' sums are shuffled on. Values are exact: shares are divided as decimals, sums are longs.
    Null texts, languages and sources are empty strings; rows with the same id count as often as they come. A language
    without kept terms has pairs of value 0; a source alone in its language has none. No documents give no rows.
    """
    # dealt by language and term only, the sums by source and by language need no further shuffle
    dealt = counted(documents).repartition("lang", "term")
    by = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    by = by.withColumn("_docs", F.sum("docs").over(of)).withColumn("all", F.sum("n").over(of))
    empty = F.col("term") == F.lit(b"")
    rows = stored(by.where(empty | (F.col("_docs") >= least)).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "all"), "terms")
    kept, every = rows.where("term <> ''"), rows.where("term = ''").select("lang", "source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_total"))
    groups = every.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    numbered = Window.partitionBy("lang").orderBy("source")  # a row per source
    groups = stored(groups.withColumn("source_no", F.row_number().over(numbered).cast("long")), "groups")

    terms = kept.groupBy("lang", "term").agg(F.max("all").alias("all")).join(vocabulary, "lang")
    terms = terms.withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / block)).cast("int")).repartition("lang", "block")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("all"), "term")) - 1
    terms = terms.withColumn("place", place).select("lang", "term", "block", F.floor(F.col("place") / WORD).cast("int").alias("word"), (F.col("place") % WORD).cast("int").alias("bit"))
    own = groups.select("lang", "source", "source_no", "total", "v")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    levels = kept.join(terms, ["lang", "term"]).groupBy("lang", "source", "block", "word", "n").agg(F.bit_or(bit).alias("bits"))
    words = terms.groupBy("lang", "block", "word").agg(F.bit_or(bit).alias("_valid"))
    seen = levels.groupBy("lang", "source", "block", "word").agg(F.bit_or("bits").alias("_seen"))
    zero = words.join(groups.select("lang", "source"), "lang").join(seen, ["lang", "source", "block", "word"], "left")
    zero = zero.select("lang", "source", "block", "word", F.lit(0).cast("long").alias("n"), F.col("_valid").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0)))).alias("bits")).where("bits <> 0")
    levels = levels.unionByName(zero).join(own, ["lang", "source"])
    levels = levels.select("lang", "block", "word", "bits", "source_no", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), F.floor((F.col("source_no") - 1) / sources).alias("i"))
    parts = groups.groupBy("lang").agg(F.floor((F.max("source_no") - 1) / sources).alias("_last"))
    levels = stored(levels.join(parts, "lang"), "levels")
    columns = ["lang", "block", "word", "bits", "source_no", "p"]
    # each block of sources meets itself and the later ones
    left = levels.withColumn("j", F.explode(F.sequence("i", "_last"))).select(*columns, "i", "j")
    right = levels.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "j"))).select(*columns, "i", "j")

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found = met(a, b) if a.num_rows and b.num_rows else {"a": [], "b": [], "value": []}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(found["a"]), pa.string())} | {c: pa.array(v, pa.int64()) for c, v in found.items()})

    on = ["lang", "block", "i", "j"]
    sums = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, "lang string, a long, b long, value long")
    both = F.explode(F.when(F.floor((F.col("a") - 1) / sources) == F.floor((F.col("b") - 1) / sources), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    sums = sums.select("lang", "value", both.alias("x")).groupBy("lang", "x.a", "x.b").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "source", F.col("source_no").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("source_no").alias("b"))
    pairs = one.join(other, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    shares = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("all"), F.col("lang_total"), F.col("v"))
    above = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(above)


def oracle(least: int = 30, top: int = 50) -> str:
    """The query in SQL, over all pairs of sources and terms."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

    def p(n: str, total: str) -> str:
        return f"CAST(1 + (CAST(1000000000 AS HUGEINT) * ({n} + 5)) // ({total} + 5 * v) AS BIGINT)"

    return f"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
vocab AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= {least}),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM docs) JOIN vocab USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM vocab GROUP BY lang) USING (lang)),
cells AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "total")} AS p FROM groups JOIN vocab USING (lang) LEFT JOIN counts USING (lang, source, term)),
langs AS (SELECT lang, term, {p("n", "total")} AS q FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN (SELECT lang, sum(n) AS total, count(DISTINCT term) AS v FROM counts GROUP BY lang) USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, (SELECT CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM cells JOIN langs USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts) WHERE part = 'pair' OR rank <= {top}"""
