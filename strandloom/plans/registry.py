"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str, sql: str | None) -> Callable:
    """Register a function of the named views, with its SQL over the same (None: SQL cannot express it)."""
    names = views.split()

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE[name] = with_views(sql, *names)
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def single(df: DataFrame, *names: str) -> DataFrame:
    """The columns in single precision, in which results are kept, with six digits: engines may round a double's exact halves apart."""
    return df.withColumns({n: F.round(F.col(n).cast("float").cast("double"), 6) + 0.0 for n in names})


def single_sql(text: str) -> str:
    return f"round(CAST(CAST({text} AS FLOAT) AS DOUBLE), 6) + 0.0"
