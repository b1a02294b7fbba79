"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilframe import dims
from perilframe.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places: two engines may differ in the last bit."""
    return df.select(*(F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields))


class Inputs:
    """The views, tables and fixed values of one run, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in dims.TABLES:
            return dims.dim(self.spark, name)
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, places: int = 6):
    """Register f(inputs) -> DataFrame under a name, with SQL over the same views; doubles to ``places`` places."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Inputs(spark, sf_dir)), places)
        if sql:
            ORACLES[name] = with_views(sql, dims.as_sql())
        return f

    return register
