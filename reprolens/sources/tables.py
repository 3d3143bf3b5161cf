"""Reading and writing the tables of an audit."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A table that cannot be read; the message does not repeat its path."""


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; empty fields and NA are missing. Damaged rows raise when read,
    without the path in the message."""
    try:
        reader = spark.read.option("header", True).option("mode", "FAILFAST").option("nullValue", "NA").option("emptyValue", "")
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    except PySparkException as e:
        raise SourceError(f"the table cannot be read ({e.getCondition() or type(e).__name__})") from None
    if not df.columns or len(set(df.columns)) != len(df.columns):
        raise SourceError("the header must name every column once")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_any(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


TEMPLATE = "sample_id string, sampling_group string, survey_date date, reporting_region string, measure_temperature double, measure_nutrient double, external_label string"


def template(spark: SparkSession, rows: int = 12) -> DataFrame:
    """An example table to fill in."""
    i = F.col("id")
    return spark.range(rows).select(
        F.format_string("sample_%03d", i + 1).alias("sample_id"), F.format_string("group_%02d", F.floor(i / 3) + 1).alias("sampling_group"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i * 7).cast("int")).alias("survey_date"), F.when(i < rows / 2, "north").otherwise("south").alias("reporting_region"),
        F.round(10 + 3 * F.sin(i.cast("double")), 2).alias("measure_temperature"), F.round(2 + F.cos(i.cast("double")), 2).alias("measure_nutrient"),
        F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").otherwise("c").alias("external_label"),
    )


REGISTRY = "id string, domain string, role string, title string, version string, license string"
#: Public datasets that suit an audit; nothing is downloaded (fixed values).
DATASETS = [
    ("palmer_penguins", "evolution", "quickstart", "Palmer Archipelago (Antarctica) Penguin Data", "0.1.0", "CC0-1.0"),
    ("zirbel_prairie", "ecology", "advanced_example", "Plant functional traits and environmental conditions in prairie restoration", "Dryad version 1", "CC0-1.0"),
    ("cestes", "ecology", "benchmark", "CESTES: species, traits, environment and space", "Figshare version 1", "CC0-1.0"),
    ("nla_2022", "environment", "advanced_example", "National Lakes Assessment 2022", "unversioned", "not stated"),
    ("ant_ecomorph", "evolution", "validation", "Morphology predicts ecology across ant lineages", "Dryad version 2", "CC0-1.0"),
    ("avonet", "evolution", "scale_validation", "AVONET: data for all birds", "Figshare version 7", "CC BY 4.0"),
]


def registry(spark: SparkSession, role: list[str] | None = None, domain: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Known open datasets, or those of a CSV of the same columns, by exact role and domain."""
    df = read_csv(spark, path) if path else spark.createDataFrame(DATASETS, REGISTRY)
    for name, wanted in (("role", role), ("domain", domain)):
        if wanted is not None:
            df = df.where(F.col(name).isin(*wanted))
    return df


def configuration_text(settings: dict) -> str:
    """A run's settings as JSON, keys sorted: the snapshot beside its results."""
    return json.dumps(settings, indent=2, sort_keys=True, default=str)


def script(settings: dict) -> str:
    """A Python program that repeats the run of these settings."""
    s = settings
    return "\n".join([
        "from pyspark.sql import SparkSession",
        "from reprolens.operators import dataset, preprocess, resample, spec, workflow",
        "from reprolens.sources import tables",
        "",
        "spark = SparkSession.builder.getOrCreate()",
        f"rows = tables.read_csv(spark, {s['path']!r})",
        f"data = dataset.make_dataset(rows, columns={list(s['predictors'])!r}, id_col={s.get('id_col')!r}, group={s.get('group')!r}, domain={s.get('domain')!r})",
        f"budget = spec.Spec(grids={tuple(map(tuple, s['grids']))!r}, seeds={tuple(s['seeds'])!r}, steps={s['steps']!r}, k={tuple(s['k'])!r})",
        f"splits = resample.subsample(data.df, repeats={s['repeats']!r}, prop={s['prop']!r}, seed={s['seed']!r})",
        f"result = workflow.run_workflow(data, budget, splits, preprocess.Preprocess(transform={s.get('transform', 'identity')!r}), methods={tuple(s.get('methods', ()))!r})",
        "result.stability.show()",
        "",
    ])
