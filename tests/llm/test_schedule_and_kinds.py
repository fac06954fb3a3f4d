"""The mix through its schedule, kinds of discovered identifiers, and stages whose documents have columns of any name."""

import math

import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, mixing, pii

COLUMNS = "doc_id long, text string, source string"


def corpus(spark):
    return spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(3 + i * 7 % 40)), f"s{min(i % 9, 4)}") for i in range(120)], COLUMNS)


def test_points_stay_even(spark):
    needs = spark.createDataFrame([("a", 0, 700), ("b", 700, 1), ("c", 701, 0), ("d", 701, 299)], "_s string, first long, need long")
    for reach in (20_000, 64):
        rows = mixing.schedule(needs, 1000, reach).orderBy("slot").collect()
        assert len(rows) == 1000
        for s, need in (("a", 700), ("b", 1), ("d", 299)):
            own = [r for r in rows if r["_s"] == s]
            assert [r["rank"] for r in own] == list(range(need)) and sorted(r.place for r in own) == list(range(need))
            seen = 0
            for k, r in enumerate(rows, 1):
                seen += r["_s"] == s
                assert abs(seen - k * need / 1000) <= math.log2(1024) + 1


def test_another_sequence_gives_another_mix(spark, monkeypatch):
    docs = corpus(spark)
    one = {r.doc_id: (r.taken, r.slot) for r in mixing.mix(docs, block=16).collect()}
    assert one == {r.doc_id: (r.taken, r.slot) for r in mixing.mix(docs.repartition(7), block=16).collect()}
    monkeypatch.setattr(mixing, "points", lambda slots, spark: spark.range(slots).select(F.col("id").alias("slot"), F.col("id").alias("at")))
    other = {r.doc_id: (r.taken, r.slot) for r in mixing.mix(docs, block=16).collect()}
    assert {d: s for d, (_, s) in one.items()} != {d: s for d, (_, s) in other.items()}
    assert {d: t for d, (t, _) in one.items()} != {d: t for d, (t, _) in other.items()}  # another block is cut short
    assert sum(t for t, _ in one.values()) == sum(t for t, _ in other.values())
    assert all((t > 0) == (s is not None) for t, s in one.values())


def test_contexts_of_mixed_kinds_propose_nothing(spark):
    rows = [(i, f"word{i} please reach me at name{i}@mail.org today") for i in range(6)] + [(10 + i, f"word{i} please reach me at +1 (743) 555-382{i} today") for i in range(6)]
    rows += [(50, "go on please reach me at bob7@intranet today")]
    assert {r.doc_id: r.found for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[50] == []
    alone = [(i, f"word{i} please reach me at name{i}@mail.org today") for i in range(12)] + [(20 + i, f"word{i} my phone is +1 (743) 555-382{i} today") for i in range(9)] + rows[-1:]
    found = {r.doc_id: r.found for r in pii.spans(spark.createDataFrame(alone, "doc_id long, text string")).collect()}[50]
    assert [s.kind for s in found] == [pii.KINDS.index("email")]


def test_marks_are_no_context(spark):
    rows = [(i, f"| +1 (743) 555-38{i:02} | x{i}") for i in range(20)] + [(50, "| 1234567812345678 | y")]
    assert {r.doc_id: r.found for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[50] == []


@pytest.mark.parametrize("names", [("_copy", "_m", "_times"), ("_d", "_h", "_spans"), ("_H", "_n", "_of")])
def test_clashing_names(spark, names):
    docs = corpus(spark)
    docs = docs.union(spark.createDataFrame([(500, "mail a@b.org now", "s1"), (500, "mail a@b.org now", "s1")], COLUMNS))
    docs = docs.select("*", *(F.lit(f"kept {n}").alias(n) for n in names))
    heads = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h")).distinct()
    for out in (mixing.mixed_documents(docs), pii.redacted(docs), common.one_of_each(docs, heads)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[n] == f"kept {n}" for r in rows for n in names)
