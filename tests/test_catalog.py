"""Each query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from strandloom.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(f"{float(x):.9g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "part", "orders", "customer", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = plain(tuple(r[c] for c in order) for r in got.collect())
    right = plain(tuple(r[names.index(c)] for c in order) for r in want.fetchall())
    assert len(left) == len(right)
    assert all(a == b or all(x == y or (x[:1].isdigit() or x[:1] == "-") and math.isclose(float(x), float(y), abs_tol=2e-6) for x, y in zip(a, b)) for a, b in zip(left, right))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows or name == "q25_significant"  # nothing need be significant
    p = [v for r in rows for k, v in r.asDict().items() if k.startswith("pval") and "threshold" not in k and v is not None]
    assert all(-1e-12 <= v <= 1 + 1e-12 for v in p)


def test_edges_of_all_orders(spark):
    from strandloom.sources.views import view

    orders = {}
    for order, part in duckdb.sql(f"SELECT l_orderkey, l_partkey FROM '{SF}/lineitem.parquet'").fetchall():
        orders.setdefault(order, set()).add(part)
    want = {(f"G{a}", f"G{b}") for parts in orders.values() for a in parts for b in parts if a < b}
    assert {(r.src, r.dst) for r in view(spark, SF, "edges").collect()} == want
