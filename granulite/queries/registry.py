"""Query register: name -> (callable, oracle SQL or none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> Column:
    """Round for comparison; minus zero becomes zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def big(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT."""
    return df.withColumns({n: F.col(n).cast("bigint") for n, t in df.dtypes if t in ("int", "smallint", "tinyint")})
