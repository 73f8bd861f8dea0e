"""All registered queries with their DuckDB forms.

A query is registered under its operator's name. Its function takes a `Tables` and returns a
DataFrame; doubles are rounded to six digits, since sums differ in their last digits with the
partitioning.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitgrid.plans.bindings import bind, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Domain tables of one input folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bind(self.spark, self.sf_dir, name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"}) if any(t == "double" for _, t in df.dtypes) else df


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)), digits)
        if sql:
            ORACLE_SQL[name] = with_tables(sql)
        return build

    return register


for _module in ("frame_queries", "rule_queries", "mesh_queries", "registry_queries", "calibration_queries", "function_queries", "file_queries", "stream_queries"):
    importlib.import_module(f"orbitgrid.plans.{_module}")
