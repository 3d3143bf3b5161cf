"""Column transforms whose centres and scales come from training rows only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN_TRANSFORMS = ("identity", "log", "log1p", "sqrt")
ROW_TRANSFORMS = ("hellinger", "clr")


class TransformError(ValueError):
    """A value outside a transform's domain, or moments that do not exist."""


@dataclass(frozen=True)
class Preprocess:
    """``transform`` is one name, or a name per column (others: identity)."""

    transform: str | dict[str, str] = "identity"
    center: bool = True
    scale: bool = True
    zero_replacement: float | None = None

    def __post_init__(self):
        names = [self.transform] if isinstance(self.transform, str) else list(self.transform.values())
        allowed = COLUMN_TRANSFORMS + (ROW_TRANSFORMS if isinstance(self.transform, str) else ())
        if any(n not in allowed for n in names):
            raise TransformError(f"transforms are {', '.join(allowed)}")
        if self.zero_replacement is not None and not self.zero_replacement > 0:
            raise TransformError("zero_replacement must be positive")

    def of(self, column: str) -> str:
        return self.transform if isinstance(self.transform, str) else self.transform.get(column, "identity")


@dataclass
class Fitted:
    """Means, scales and constant columns of the training rows."""

    spec: Preprocess
    columns: list[str]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    constant: list[str] = field(default_factory=list)


def check_domain(df: DataFrame, columns: list[str], spec: Preprocess) -> None:
    """Raise if any present value, in any row, is outside its transform's domain."""
    if spec.transform in ROW_TRANSFORMS:
        got = df.agg(
            F.sum(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))).alias("missing"),
            F.min(F.least(*columns, F.lit(float("inf")))).alias("low"),
            F.min(sum((F.col(c) for c in columns), F.lit(0.0))).alias("total"),
        ).first()
        if got["missing"]:
            raise TransformError(f"{spec.transform} needs complete rows")
        if got["low"] is not None and got["low"] < 0:
            raise TransformError(f"{spec.transform} needs values that are not negative")
        if spec.transform == "hellinger" and got["total"] is not None and got["total"] <= 0:
            raise TransformError("hellinger needs a positive sum in each row")
        if spec.transform == "clr" and got["low"] == 0 and spec.zero_replacement is None:
            raise TransformError("clr with zeros needs zero_replacement")
        return
    lows = df.agg(*(F.min(c).alias(c) for c in columns)).first()
    for c in columns:
        kind, low = spec.of(c), lows[c]
        if low is not None and ((kind == "log" and low <= 0) or (kind in ("log1p", "sqrt") and low < 0)):
            raise TransformError(f"{kind} of {c}: the smallest value is {low}")


def transformed(columns: list[str], spec: Preprocess) -> dict[str, Column]:
    """Transformed columns, before centring."""
    if spec.transform == "hellinger":
        total = sum((F.col(c) for c in columns), F.lit(0.0))
        return {c: F.sqrt(F.col(c) / total) for c in columns}
    if spec.transform == "clr":
        logs = {c: F.ln(F.when(F.col(c) == 0, F.lit(spec.zero_replacement)).otherwise(F.col(c))) for c in columns}
        mean = sum(logs.values(), F.lit(0.0)) / len(columns)
        return {c: v - mean for c, v in logs.items()}
    own = {"identity": lambda c: c, "log": F.ln, "log1p": F.log1p, "sqrt": F.sqrt}
    return {c: own[spec.of(c)](F.col(c)) for c in columns}


def moments(df: DataFrame, columns: list[str], spec: Preprocess, by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` and, for each column, mean__c and sd__c (n - 1) of the transformed rows."""
    t = transformed(columns, spec)
    made = df.select(*by, *(t[c].alias(c) for c in columns))
    return made.groupBy(*by).agg(*(F.avg(c).alias(f"mean__{c}") for c in columns), *(F.stddev_samp(c).alias(f"sd__{c}") for c in columns))


def fit_preprocess(train: DataFrame, columns: list[str], spec: Preprocess) -> Fitted:
    """Moments of the training rows: one aggregation. A column without spread is
    constant: its scale is 1 and its processed value 0."""
    check_domain(train, columns, spec)
    row = moments(train, columns, spec).first()
    out = Fitted(spec, list(columns))
    for c in columns:
        mean, sd = row[f"mean__{c}"], row[f"sd__{c}"]
        if mean is None:
            raise TransformError(f"{c} has no training value")
        if sd is None or sd == 0:
            out.constant.append(c)
            sd = 1.0
        out.means[c] = mean if spec.center else 0.0
        out.scales[c] = sd if spec.scale else 1.0
    return out


def apply_preprocess(df: DataFrame, fitted: Fitted) -> DataFrame:
    """``df`` with its predictors processed by stored moments. Constant columns are 0,
    even where they are missing. Values outside a transform's domain raise."""
    check_domain(df, fitted.columns, fitted.spec)
    t = transformed(fitted.columns, fitted.spec)
    made = {c: F.lit(0.0) if c in fitted.constant else (t[c] - fitted.means[c]) / fitted.scales[c] for c in fitted.columns}
    return df.withColumns(made)


def layer_weights(train: DataFrame, layers: dict[str, list[str]], requested: dict[str, float] | None = None, normalize: bool = True) -> DataFrame:
    """``layer, requested, mean_squared_distance, effective``: shares of the layers in
    the distance, divided by twice the sum of their variances if ``normalize``."""
    requested = requested or dict.fromkeys(layers, 1.0)
    total = sum(requested.values())
    row = train.agg(*((2 * sum((F.coalesce(F.var_samp(c), F.lit(0.0)) for c in cs), F.lit(0.0))).alias(k) for k, cs in layers.items())).first()
    if normalize and any(row[k] is None or not row[k] > 2.220446049250313e-16 for k in layers):
        raise TransformError("a layer has no spread in the training rows")
    share = {k: requested[k] / total for k in layers}
    raw = {k: share[k] / row[k] if normalize else share[k] for k in layers}
    rows = [(k, share[k], float(row[k] or 0.0), raw[k] / sum(raw.values())) for k in layers]
    return train.sparkSession.createDataFrame(rows, "layer string, requested double, mean_squared_distance double, effective double")
