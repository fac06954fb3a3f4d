"""Personal data: fixed forms by regex, and further identifiers by bootstrapped contexts; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, stored

# The forms. They match what the plain forms match: a run is entered at its start or where the
# last match ended, and what cannot be given back is possessive, so that long runs cost no more than their length.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# What stands for each character of a base span, and the words that hold none of it: one, or several in a row.
MASK = "\ue000"
WORD = rf"[^\s0-9@{MASK}]*+[0-9@][^\s{MASK}]*+(?!\S)"
CANDIDATE = rf"(?<!\S){WORD}"
SEVERAL = rf"{CANDIDATE}\x20++{WORD}"
RUN = rf"(?<!\S){WORD}(?:\x20++{WORD})++"


BLOCK = 512  # code points that are read at once around a place
BEFORE, AFTER = 60, 30  # code points around a candidate that contexts are taken from


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The values of an array joined from the first to each (sums, maxima), in steps of 1, 2, 4, ..."""

    def step(acc: Column, by: Column) -> Column:
        return F.concat(F.slice(acc, 1, by), F.zip_with(F.slice(acc, by + 1, F.size(acc)), F.slice(acc, 1, F.size(acc) - by), join))

    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda by: by < F.size(values))
    return F.aggregate(steps, values, step)


def larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def matches(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<start,end,match,tied>> of the leftmost non-overlapping matches, in code points.

    tied: whether only spaces lie between the match and one beside it. The text between the matches comes from
    splitting; the lengths add up to the places.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string,tied:boolean>>")

    def placed(found: Column, ends: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            end = F.get(ends, i)
            tied = ((i > 0) & F.get(found["gap"], i).rlike("^\\x20+$")) | ((i + 1 < F.size(ends)) & F.get(found["gap"], i + 1).rlike("^\\x20+$"))
            return F.struct((end - F.char_length(hit)).alias("start"), end.alias("end"), hit.alias("match"), tied.alias("tied"))

        return F.transform(found["hit"], one)

    def of(found: Column) -> Column:
        lengths = F.zip_with(found["hit"], F.slice(found["gap"], 1, F.size(found["hit"])), lambda h, g: F.char_length(h) + F.char_length(g))
        return F.when(F.size(found["hit"]) > 0, let(running(lengths, lambda x, y: x + y), lambda ends: placed(found, ends))).otherwise(none)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"), F.split(text, pattern, -1).alias("gap"))
    return F.when(when, let(both, of)).otherwise(none)


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The text of blocks() from start to end; its cost is that of the piece, wherever it lies."""
    a, b = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    first = F.substring(F.get(parts, a), (start % BLOCK + 1).cast("int"), F.least(end - start, F.lit(BLOCK)))
    more = F.concat(first, F.array_join(F.slice(parts, a + 2, b - a - 1), ""), F.left(F.get(parts, b), end - b * BLOCK))
    return F.when(end <= start, "").when(a == b, first).otherwise(more)


def spliced(text: Column, spans: Column, name: Callable[[Column, Column], Column]) -> Column:
    """The text with name(span, end of those before it) in place of each of the spans, which are sorted by start."""

    def of(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            last = F.coalesce(F.get(x["ends"], i - 1), F.lit(0))
            return F.concat(cut(x["parts"], last, s["start"]), name(s, last))

        return F.concat(F.array_join(F.transform(spans, one), ""), cut(x["parts"], F.element_at(x["ends"], -1), x["n"]))

    ends = running(F.transform(spans, lambda s: s["end"]), larger)
    whole = F.struct(blocks(text).alias("parts"), ends.alias("ends"), F.char_length(text).alias("n"))
    return F.when(F.size(spans) > 0, let(whole, of)).otherwise(text)


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end,token>> in order; kind is the place in KINDS, token the span's text."""

    def digits(m: Column) -> Column:
        return F.regexp_replace(m, "[^0-9]", "")

    def card(m: Column) -> Column:
        n = F.char_length(digits(m["match"]))
        return F.when(n.between(12, 19), luhn(digits(m["match"]))).otherwise(False)

    def ip(m: Column) -> Column:
        return F.forall(F.split(m["match"], r"\."), lambda p: p.rlike(f"^{PART}$"))

    found = [
        matches(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), ip),
        F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), card),
        F.filter(matches(text, PHONE, text.rlike(r"\+[0-9]")), lambda m: F.char_length(digits(m["match"])).between(9, 15)),
    ]

    def of_kind(k: int) -> Column:
        return F.transform(found[k], lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["match"].alias("token")))

    return F.array_sort(F.concat(*map(of_kind, range(len(KINDS)))))


def masked(text: Column, spans: Column) -> Column:
    """The text with MASK in place of every character of the spans."""
    return spliced(text, spans, lambda s, last: F.repeat(F.lit(MASK), F.greatest(s["end"] - F.greatest(s["start"], last), F.lit(0))))


def contexts(bare: Column, parts: Column, to: Column, rows: Column, spans: Column) -> Column:
    """array<struct<start,end,token,kind,patterns>>: the base spans, each as one, and what else may be an identifier:
    words that hold a digit or @, and runs of them, at least six characters; with the contexts around them.
    kind is null where it is no base span. bare: as of masked(), parts its blocks, to its length. rows: the runs. A word of a run
    leaves the contexts to the run. Context words lie whole within BEFORE and AFTER code points; one that does not
    makes no pattern."""

    def words(x: Column) -> Column:
        named = F.filter(F.split(F.regexp_replace(F.lower(x), f"{MASK}+", "#"), r"\s+"), lambda w: w != "")
        return F.filter(named, lambda w: w.rlike(r"[\p{L}\p{N}#]"))  # bars and other marks alone are no context

    def one(start: Column, end: Column, last: Column, token: Column, kind: Column, alone: Column) -> Column:
        before = F.regexp_replace(cut(parts, F.greatest(start - BEFORE, F.lit(0)), start), r"\S+$", "")
        after = F.regexp_replace(cut(parts, last, F.least(last + AFTER, to)), r"^\S+", "")
        before = words(F.when(start > BEFORE, F.regexp_replace(before, r"^\S+", "")).otherwise(before))
        after = words(F.when(last + AFTER < to, F.regexp_replace(after, r"\S+$", "")).otherwise(after))

        def of(x: Column) -> Column:
            left, right = F.when(F.size(x["before"]) >= 2, F.slice(x["before"], -2, 2)), F.get(x["after"], F.lit(0))
            found = F.array(F.concat(F.lit("L:"), F.array_join(left, " ")), F.concat(F.lit("B:"), F.get(left, F.lit(1)), F.lit(" _ "), right))
            return F.filter(found, lambda p: p.isNotNull())

        patterns = let(F.struct(before.alias("before"), after.alias("after")), of)
        patterns = F.when(alone, patterns).otherwise(F.array().cast("array<string>"))
        return F.struct(start.alias("start"), end.alias("end"), token.alias("token"), kind.alias("kind"), patterns.alias("patterns"))

    def unseen(found: Column, alone: Callable[[Column], Column]) -> Column:
        trimmed = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("last"), m["tied"].alias("tied"), F.regexp_replace(m["match"], r"[^\p{L}\p{N}]+$", "").alias("token")))
        long = F.filter(trimmed, lambda m: F.char_length(m["token"]) >= 6)
        return F.transform(long, lambda m: one(m["start"], m["start"] + F.char_length(m["token"]), m["last"], m["token"], F.lit(None).cast("int"), alone(m)))

    base = F.transform(spans, lambda s: one(s["start"], s["end"], s["end"], s["token"], s["kind"], F.lit(True)))
    return F.concat(base, unseen(matches(bare, CANDIDATE, bare.rlike("[0-9@]")), lambda m: ~m["tied"]), unseen(rows, lambda m: F.lit(True)))


def discovered(rows: DataFrame, rounds: int = 8, least: float = 0.8, seeds: int = 3, share: float = 0.8) -> DataFrame:
    """(token, kind): identifiers that good contexts propose, beyond the seeds.

    rows: cands as of contexts(). A context is scored for each kind apart: the sum of the scores that the different words in
    it have for the kind, over their number and one more. It counts from `seeds` seed words of the kind on, and only where
    they are at least `share` of its seed words, so contexts of mixed kinds propose nothing. A word's score for a
    kind is that not all its contexts of that kind err; seeds keep 1 for their own. Rounds end when no word is
    found that was not in the one before, or after `rounds`. Words at `least` or more are found, with the kind of the
    highest score; equal ones, none.
    """
    words = rows.select(F.explode("cands").alias("c")).select("c.token", "c.kind", F.explode("c.patterns").alias("pattern"))
    edges = stored(words.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "contexts")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("words"), F.count("kind").alias("known"))
    useful = edges.where("kind IS NOT NULL").groupBy("pattern", F.col("kind").alias("of")).agg(F.count("*").alias("n")).join(sizes, "pattern")
    useful = useful.where((F.col("n") >= seeds) & (F.col("n") >= share * F.col("known"))).select("pattern", "of", "words")
    edges = stored(edges.join(useful, "pattern"), "contexts")
    scores = edges.where("kind = of").select("token", "of", F.lit(1.0).alias("score")).distinct()
    before = None
    for _ in range(rounds):
        trust = edges.join(scores, ["token", "of"]).groupBy("pattern", "of").agg((F.sum("score") / (F.max("words") + 1)).alias("trust")).where("trust >= 0.5")
        proposed = edges.join(trust, ["pattern", "of"]).groupBy("token", "of").agg(F.max("kind").alias("kind"), (1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score"))
        proposed = stored(proposed, "proposed")
        found = proposed.where((F.col("kind").isNull()) & (F.col("score") >= least))
        now = found.agg(F.count("*"), F.sum(F.xxhash64("token", "of").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        scores = proposed.select("token", "of", F.when(F.col("kind") == F.col("of"), 1.0).when(F.col("kind").isNotNull(), 0.0).otherwise(F.col("score")).alias("score"))
    best = found.groupBy("token").agg(F.max("score").alias("_best"), F.max_by("of", "score").alias("kind"), F.collect_list("score").alias("_all"))  # a score per kind
    return best.where(F.size(F.filter("_all", lambda x: x == F.col("_best"))) == 1).select("token", "kind")


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, found): the spans of every whole text; start and end in code points, end exclusive.

    base: array<struct<start,kind,end>>, kind the place in KINDS. found: the same, of words and runs
    of words that only contexts show, without those that overlap base spans or lie in a longer one. Null texts count as empty. Rows with the same doc_id and text
    give the same spans; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("hits", base_spans(F.col("text"))).withColumn("bare", masked(F.col("text"), F.col("hits")))
    rows = rows.withColumn("parts", F.when(F.col("bare").rlike(f"[0-9@{MASK}]"), blocks(F.col("bare"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("to", F.char_length("bare")).withColumn("rows", matches(F.col("bare"), RUN, F.col("bare").rlike(SEVERAL)))
    base = F.transform("hits", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), base.alias("base"), contexts(F.col("bare"), F.col("parts"), F.col("to"), F.col("rows"), F.col("hits")).alias("cands"))
    rows = stored(rows, "spans")
    new = discovered(rows).withColumnRenamed("kind", "_kind")
    spots = rows.select("doc_id", "text_hash", F.explode("cands").alias("c")).where("c.kind IS NULL").select("doc_id", "text_hash", "c.start", "c.end", "c.token")
    spots = spots.join(new, "token").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("less"), F.col("_kind").alias("kind"), "end"))).alias("found"))
    # sorted by start, longer ones first: a span that ends within the reach of those before it lies in one of them
    reach = running(F.transform("found", lambda s: s["end"]), larger)
    own = let(F.struct("found", reach.alias("reach")), lambda x: F.filter(x["found"], lambda s, i: (i == 0) | (F.get(x["reach"], i - 1) < s["end"])))
    spots = spots.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("found"))
    out = rows.join(spots, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    return out.select("doc_id", "text_hash", "base", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "found"))).alias("spans"))


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by [kind]; where spans overlap the first one's name stands for all. Columns as given."""
    d, h, held = apart(documents, "_d", "_h", "_spans")
    found = spans(documents).where("size(base) + size(found) > 0").dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.array_sort(F.concat("base", "found")).alias(held))
    rows = documents.join(found, documents["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(documents["text"]) == F.col(h)), "left")
    kind = F.array(*map(F.lit, KINDS))
    cleaned = spliced(rows["text"], F.col(held), lambda s, last: F.when(s["start"] >= last, F.concat(F.lit("["), F.element_at(kind, s["kind"] + 1), F.lit("]"))).otherwise(""))
    return rows.select(*(F.when(F.col(held).isNull(), rows["text"]).otherwise(cleaned).alias("text") if c == "text" else rows[c] for c in documents.columns))
