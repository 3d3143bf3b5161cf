"""Datasets: numeric layers and sample metadata in one DataFrame, validated once."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
_GENERATED = re.compile(r"^(sample|simulation)_[0-9]+$")


class DataError(ValueError):
    """Input that a reproducibility audit cannot use."""


@dataclass(frozen=True)
class Dataset:
    """``df`` has ``sample_id`` and one double column for each variable of ``layers``."""

    df: DataFrame
    layers: dict[str, tuple[str, ...]]
    id_source: str = "provided"
    group: str | None = None
    time: str | None = None
    domain: str | None = None
    weight: str | None = None
    external_label: str | None = None
    external_label_source: str = "none"

    @property
    def variables(self) -> list[str]:
        return [c for cs in self.layers.values() for c in cs]

    def __repr__(self) -> str:
        parts = ", ".join(f"{k}: {len(v)}" for k, v in self.layers.items())
        return f"Dataset({parts}; ids {self.id_source}; group {self.group}, domain {self.domain}, labels {self.external_label_source})"


def make_dataset(
    df: DataFrame,
    columns: list[str] | None = None,
    layers: dict[str, list[str]] | None = None,
    id_col: str | None = None,
    group: str | None = None,
    time: str | None = None,
    domain: str | None = None,
    weight: str | None = None,
    external_label: str | None = None,
) -> Dataset:
    """Validate and build a dataset; exactly one of ``columns`` and ``layers``.

    Numeric columns become double, NaN becomes null. Infinite values, non-numeric
    predictors, blank or repeated identifiers, negative or non-finite weights and empty
    tables raise ``DataError``. All checks are one aggregation.
    """
    if (columns is None) == (layers is None):
        raise DataError("give exactly one of columns and layers")
    layers = {"data": list(columns)} if layers is None else {k: list(v) for k, v in layers.items()}
    names = [c for cs in layers.values() for c in cs]
    if not names or any(not cs for cs in layers.values()) or len(set(names)) != len(names) or any(not c.strip() for c in names):
        raise DataError("layers need uniquely named, non-empty columns")
    kinds = dict(df.dtypes)
    for c in names:
        if c not in kinds:
            raise DataError(f"no column {c}")
        if kinds[c] not in _NUMERIC and not kinds[c].startswith("decimal"):
            raise DataError(f"column {c} is not numeric")
    source = "provided"
    if id_col is None:
        source = "generated"
        ident = F.format_string("sample_%05d", F.monotonically_increasing_id() + 1)
    else:
        ident = F.trim(F.col(id_col).cast("string"))
    number = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    extra = {"group": group, "time": time, "domain": domain, "weight": weight, "external_label": external_label}
    rows = df.select(ident.alias("sample_id"), *(number(c).alias(c) for c in names), *(F.col(c).alias(k) for k, c in extra.items() if c))
    infinite = sum((F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)).cast("int") for c in names), F.lit(0))
    bad_weight = F.lit(0)
    if weight:
        w = F.col("weight").cast("double")
        bad_weight = F.coalesce((w < 0) | F.isnan(w) | (w == float("inf")), F.lit(True)).cast("int")
    checks = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(infinite).alias("infinite"),
        F.sum(F.coalesce(F.col("sample_id") == "", F.lit(True)).cast("int")).alias("blank"),
        F.sum(bad_weight).alias("weight"),
        F.sum(F.col("sample_id").rlike(_GENERATED.pattern).cast("int")).alias("generated"),
    ).first()
    if not checks["n"]:
        raise DataError("no rows")
    if checks["infinite"]:
        raise DataError("infinite values in predictors")
    if checks["blank"]:
        raise DataError("blank sample identifiers")
    if checks["weight"]:
        raise DataError("weights must be finite and not negative")
    if rows.groupBy("sample_id").count().where("count > 1").limit(1).count():
        raise DataError("repeated sample identifiers")
    if checks["generated"]:
        source = "generated"
    label = "none" if not external_label else "position" if source == "generated" else "named_id"
    return Dataset(rows, {k: tuple(v) for k, v in layers.items()}, source, *("group" if group else None, "time" if time else None, "domain" if domain else None, "weight" if weight else None, "external_label" if external_label else None), label)


def align_layers(tables: dict[str, DataFrame], id_col: str) -> DataFrame:
    """One row per sample from layers in separate tables, joined on their identifiers,
    which must be the same in all of them."""
    (_, out), *rest = tables.items()
    for name, t in rest:
        for a, b in ((out, t), (t, out)):
            if a.select(id_col).join(b.select(id_col), id_col, "left_anti").limit(1).count():
                raise DataError(f"layer {name} has other samples")
        out = out.join(t, id_col)
    return out


def audit_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``measure, value``: rows, columns, incomplete and empty rows, non-finite values
    and constant columns, from one pass."""
    missing = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns]
    n_missing = sum((F.coalesce(m, F.lit(True)).cast("int") for m in missing), F.lit(0))
    infinite = sum((F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False)).cast("int") for c in columns), F.lit(0))
    constant = sum(((F.count_distinct(F.col(c).cast("double")) <= 1).cast("int") for c in columns), F.lit(0))
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(columns)).cast("long").alias("columns"),
        F.sum((n_missing > 0).cast("long")).alias("incomplete_rows"),
        F.sum((n_missing == len(columns)).cast("long")).alias("empty_rows"),
        F.sum(infinite.cast("long")).alias("non_finite"),
        constant.cast("long").alias("constant_columns"),
    )
    pairs = ", ".join(f"'{c}', {c}" for c in one.columns)
    return one.selectExpr(f"stack({len(one.columns)}, {pairs}) as (measure, value)")


def default_roles(df: DataFrame) -> dict[str, list[str]]:
    """Predictors and metadata guessed from names and types."""
    meta = re.compile(r"(?i)^(id|.*_id|.*key|.*group|site|domain|region|date|time|year|label|class|weight)$")
    numeric = [c for c, t in df.dtypes if (t in _NUMERIC or t.startswith("decimal")) and not meta.match(c)]
    return {"predictors": numeric, "metadata": [c for c in df.columns if c not in numeric]}


def integer_set(text: str) -> list[int]:
    """Distinct integers of a comma-separated list, in order; ValueError for anything else."""
    out = []
    for part in text.split(","):
        if not re.fullmatch(r"\s*[0-9]+\s*", part):
            raise ValueError(f"not a whole number: {part!r}")
        if int(part) not in out:
            out.append(int(part))
    return out
