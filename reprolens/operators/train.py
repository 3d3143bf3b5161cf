"""Ensembles of maps: every split times every model of the budget.

``fit_ensemble`` sends one task per fit. The rows travel once, as a broadcast matrix
guarded by its size; a dataset beyond that is trained by ``fit_distributed``, in which
each epoch is one aggregation over the rows. A failed fit is a row with its error.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid as g
from ..functions import kernels
from .dataset import Dataset
from .mapping import batch_epoch, initial_codebook, map_rows
from .preprocess import Preprocess
from .spec import Spec, expand

#: Largest matrix that is broadcast to train a map in one task.
MAX_BYTES = 256 << 20


@dataclass
class Ensemble:
    """``fits`` (one row per model, with error or null), ``mapping`` (fit, sample, role,
    bmu, distance), ``codebook`` (fit, unit, layer, codes) and the design."""

    data: Dataset
    spec: Spec
    splits: DataFrame
    fits: DataFrame
    mapping: DataFrame
    codebook: DataFrame
    expected: int

    @property
    def failures(self) -> DataFrame:
        return self.fits.where("error is not null").select("fit_id", "split_id", "grid_id", "seed", "error")

    @property
    def warnings(self) -> DataFrame:
        return self.fits.where("size(warnings) > 0").select("fit_id", "split_id", "grid_id", "seed", F.explode("warnings").alias("warning"))

    def __repr__(self) -> str:
        return f"Ensemble({self.expected} models)"


def _moments(x: np.ndarray, pre: Preprocess):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        mean = np.nanmean(x, 0)
        sd = np.nanstd(x, 0, ddof=1)
    if not np.isfinite(mean).all():
        raise ValueError("a column has no training value")
    constant = ~(np.nan_to_num(sd) > 0)
    return np.where(pre.center, mean, 0.0), np.where(constant | (not pre.scale), 1.0, sd), constant


def _transform(x: np.ndarray, names: list[str], pre: Preprocess) -> np.ndarray:
    with np.errstate(all="ignore"):
        if pre.transform == "hellinger":
            if np.isnan(x).any() or (x < 0).any() or (x.sum(1) <= 0).any():
                raise ValueError("hellinger needs complete rows with a positive sum")
            return np.sqrt(x / x.sum(1, keepdims=True))
        if pre.transform == "clr":
            if np.isnan(x).any() or (x < 0).any() or ((x == 0).any() and pre.zero_replacement is None):
                raise ValueError("clr needs complete positive rows, or zero_replacement")
            y = np.log(np.where(x == 0, pre.zero_replacement or 1.0, x))
            return y - y.mean(1, keepdims=True)
        out = x.astype(float).copy()
        for j, c in enumerate(names):
            kind, low = pre.of(c), np.nanmin(x[:, j]) if (~np.isnan(x[:, j])).any() else np.inf
            if (kind == "log" and low <= 0) or (kind in ("log1p", "sqrt") and low < 0):
                raise ValueError(f"{kind} of {c}: the smallest value is {low}")
            out[:, j] = {"identity": lambda v: v, "log": np.log, "log1p": np.log1p, "sqrt": np.sqrt}[kind](x[:, j])
        return out


def pre_of(pre: Preprocess | dict[str, Preprocess] | None, layer: str) -> Preprocess:
    """The transforms of a layer: of all alike, or its own (none given: identity, centred and scaled)."""
    return (pre.get(layer) if isinstance(pre, dict) else pre) or Preprocess()


def prepared(layers: dict[str, np.ndarray], names: dict[str, list[str]], analysis: np.ndarray, pre: Preprocess | dict[str, Preprocess] | None, asked: dict[str, float] | None, normalize: bool) -> tuple[dict[str, np.ndarray], dict[str, float], list[str]]:
    """Each layer transformed by itself, with the moments of the analysis rows, the
    effective weights of the layers in the distance, and warnings."""
    done, raw, warned = {}, {}, []
    for name, x in layers.items():
        own = pre_of(pre, name)
        t = _transform(x, names[name], own)
        mean, scale, constant = _moments(t[analysis], own)
        z = (t - mean) / scale
        z[:, constant] = 0.0
        if constant.any():
            warned.append(f"constant training columns in {name}: {', '.join(np.array(names[name])[constant])}")
        done[name] = z
        raw[name] = 2 * float(np.nanvar(z[analysis], 0, ddof=1).sum())
    asked = asked or dict.fromkeys(layers, 1.0)
    total = sum(asked[k] for k in layers)
    weight = {k: asked[k] / total for k in layers}
    if normalize:
        if any(not np.isfinite(v) or v <= 2.220446049250313e-16 for v in raw.values()):
            raise ValueError("a layer has no spread in the training rows")
        weight = {k: weight[k] / raw[k] for k in layers}
    return done, {k: v / sum(weight.values()) for k, v in weight.items()}, warned


def fit_one(layers: dict[str, np.ndarray], names: dict[str, list[str]], analysis: np.ndarray, xdim: int, ydim: int, seed: int, spec: Spec, pre: Preprocess | dict[str, Preprocess]) -> dict:
    """One map: moments of the analysis rows, training on them, mapping of all rows."""
    units = xdim * ydim
    if analysis.sum() < units:
        raise ValueError(f"{int(analysis.sum())} analysis rows for {units} units")
    done, weight, warned = prepared(layers, names, analysis, pre, spec.layer_weights, spec.normalize_layers)
    for name, z in done.items():
        if (np.isnan(z[analysis]).mean(1) > spec.max_na_fraction).any():
            raise ValueError(f"training rows of {name} miss too many values")
    distance = g.distances(xdim, ydim, spec.topology, spec.toroidal)
    order = list(layers)
    codes = kernels.train_map([done[k][analysis] for k in order], [weight[k] for k in order], distance, spec.steps, seed, spec.neighbourhood)
    d = kernels.map_distance([done[k] for k in order], codes, [weight[k] for k in order])
    for k in order:
        d[np.isnan(done[k]).mean(1) > spec.max_na_fraction] = np.nan
    ok = ~np.isnan(d).all(1)
    near = np.argsort(np.where(np.isnan(d), np.inf, d), 1, kind="stable")[:, :2] + 1
    bmu = np.where(ok, near[:, 0], 0)
    best = np.where(ok, np.nanmin(np.where(ok[:, None], d, 0), 1), np.nan)
    adjacent = g.adjacency(xdim, ydim, spec.topology, spec.toroidal)
    rows = analysis & ok
    te = float((~adjacent[near[rows, 0] - 1, near[rows, 1] - 1]).mean()) if rows.any() else None
    return {
        "bmu": bmu, "distance": best, "codes": dict(zip(order, codes, strict=True)), "weights": weight, "warnings": warned,
        "qe": float(np.nanmean(best[analysis])), "te": te, "empty": 1 - len(set(bmu[rows].tolist())) / units,
    }


FIT = (
    "fit_id string, split_id string, grid_id int, xdim int, ydim int, seed long, model_id string, error string, warnings array<string>, "
    "quantization_error double, topographic_error double, empty_unit_rate double, ids array<string>, roles array<string>, bmu array<int>, "
    "distance array<double>, codes array<struct<layer:string,unit:int,codes:array<double>>>, weights map<string,double>"
)


def shared_rows(data: Dataset):
    """Broadcast (identifiers as an Arrow array, matrix of each layer) in order of identifier:
    the callers have checked the size."""
    table = data.df.select("sample_id", *data.variables).orderBy("sample_id").toArrow()
    ids = table["sample_id"].combine_chunks()
    return data.df.sparkSession.sparkContext.broadcast((ids, {k: np.array([table[c].to_numpy() for c in v], float).T for k, v in data.layers.items()}))


def members(splits: DataFrame) -> DataFrame:
    """``split_id, members``: identifiers by role."""
    by_role = splits.groupBy("split_id", "role").agg(F.collect_list("sample_id").alias("ids"))
    return by_role.groupBy("split_id").agg(F.collect_list(F.struct("role", "ids")).alias("members"))


def roles(place: pd.Index, members) -> np.ndarray:
    """Role of each identifier in ``place``; of those in no role, an empty text."""
    out = np.full(len(place), "", object)
    for m in members:
        at = place.get_indexer(np.asarray(m["ids"], object))
        if (at < 0).any():
            raise KeyError("a split names unknown samples")
        out[at] = m["role"]
    return out


def fit_ensemble(data: Dataset, spec: Spec, splits: DataFrame, pre: Preprocess | dict[str, Preprocess] | None = None, fail_fast: bool = False, max_bytes: int = MAX_BYTES) -> Ensemble:
    """Train every model on every split, one task each; ``pre`` is one for all layers or one for each."""
    pre = pre or Preprocess()
    spark = data.df.sparkSession
    names = {k: list(v) for k, v in data.layers.items()}
    rows = data.df.count()
    size = rows * 8 * len(data.variables)
    if size > max_bytes:
        raise ValueError(f"the rows take {size} bytes, over {max_bytes}: train with fit_distributed")
    shared = shared_rows(data)  # the size was checked above
    budget = expand(spark, spec)
    jobs = members(splits).crossJoin(F.broadcast(budget)).withColumn("fit_id", F.concat_ws("__", "split_id", "model_id"))
    expected = splits.select("split_id").distinct().count() * budget.count()
    header = [c.split()[0] for c in FIT.split(", ")]

    def run(batches):
        every, layers = shared.value
        every = every.to_numpy(zero_copy_only=False)
        place = pd.Index(every)
        for batch in batches:
            for job in batch.itertuples(index=False):
                head = (job.fit_id, job.split_id, job.grid_id, job.xdim, job.ydim, job.seed, job.model_id)
                role = roles(place, job.members)
                try:
                    f = fit_one(layers, names, role == "analysis", job.xdim, job.ydim, kernels.sample_seed(job.seed, job.fit_id), spec, pre)
                except Exception as e:
                    if fail_fast:
                        raise
                    yield pd.DataFrame([(*head, str(e), [], None, None, None, [], [], [], [], [], {})], columns=header)
                    continue
                codes = [{"layer": k, "unit": u + 1, "codes": c[u].tolist()} for k, c in f["codes"].items() for u in range(len(c))]
                kept = role != ""
                row = (
                    *head, None, f["warnings"], f["qe"], f["te"], f["empty"], every[kept].tolist(), role[kept].tolist(),
                    [int(b) or None for b in f["bmu"][kept]], [None if np.isnan(x) else float(x) for x in f["distance"][kept]], codes, f["weights"],
                )
                yield pd.DataFrame([row], columns=header)

    wide = jobs.repartition(max(1, min(expected, 512))).mapInPandas(run, FIT).persist()
    fits = wide.select(*[c.split()[0] for c in FIT.split(", ")][:12], "weights")
    zipped = F.arrays_zip("ids", "roles", "bmu", "distance")
    mapping = wide.select("fit_id", "split_id", F.explode(zipped).alias("r")).select("fit_id", "split_id", F.col("r.ids").alias("sample_id"), F.col("r.roles").alias("role"), F.col("r.bmu").alias("bmu"), F.col("r.distance").alias("distance"))
    codebook = wide.select("fit_id", F.explode("codes").alias("c")).select("fit_id", "c.layer", "c.unit", "c.codes")
    return Ensemble(data, spec, splits, fits, mapping, codebook, expected)


def fit_distributed(rows: DataFrame, columns: list[str], xdim: int, ydim: int, steps: int = 10, seed: int = 1, topology: str = "hexagonal", id_col: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """One map over rows of any number: (codebook, mapped rows). Each epoch is one
    aggregation; the codebook, units times columns, is all that leaves the executors."""
    distance = g.distances(xdim, ydim, topology)
    start = float(np.quantile(distance, 2 / 3))
    spark = rows.sparkSession
    fixed = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  units x columns values
    codebook = fixed(initial_codebook(rows, columns, xdim * ydim, seed, id_col))
    for step in range(steps):
        radius = max(start * (1 - step / steps), 0.1)
        h = np.exp(-(distance**2) / (2 * radius**2))
        pairs = [(i + 1, j + 1, float(h[i, j])) for i in range(len(h)) for j in range(len(h))]
        codebook = fixed(batch_epoch(rows, codebook, columns, pairs, id_col))
    return codebook, map_rows(rows, codebook, {"data": tuple(columns)})
