"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


def quantile8_sql(values: str, p: float) -> str:
    """Type-8 quantile of a DuckDB list of doubles, sorted."""
    h = f"(1.0e0 / 3 + {p}e0 * (len({values}) + 1.0e0 / 3))"
    low = f"CAST(floor({h}) AS BIGINT)"
    at = lambda i: f"{values}[greatest(1, least(len({values}), {i}))]"
    return f"({at(low)} + ({h} - {low}) * ({at(low + ' + 1')} - {at(low)}))"
