"""Old maps applied to new rows: stored moments, stored codebooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import kernels
from .preprocess import Preprocess
from .train import MAX_BYTES, Ensemble, _moments, _transform, pre_of


def models(ensemble: Ensemble, pre: Preprocess | dict[str, Preprocess] | None = None) -> list[dict]:
    """What scoring needs of each successful fit: moments, codes and weights (bounded by
    the model budget)."""
    data = ensemble.data
    size = data.df.count() * 8 * len(data.variables)
    if size > MAX_BYTES:
        raise ValueError(f"the training rows take {size} bytes, over {MAX_BYTES}")
    table = data.df.select("sample_id", *data.variables).orderBy("sample_id").toPandas()
    place = {s: i for i, s in enumerate(table["sample_id"])}
    out = []
    members = {r["split_id"]: [place[s] for s in r["ids"]] for r in ensemble.splits.where("role = 'analysis'").selectExpr("split_id", "sample_id").groupBy("split_id").agg({"sample_id": "collect_list"}).withColumnRenamed("collect_list(sample_id)", "ids").collect()}
    codes: dict[str, dict] = {}
    for r in ensemble.codebook.collect():
        codes.setdefault(r["fit_id"], {}).setdefault(r["layer"], {})[r["unit"]] = r["codes"]
    for f in ensemble.fits.where("error is null").select("fit_id", "split_id", "weights").collect():
        model = {"fit_id": f["fit_id"], "weights": dict(f["weights"]), "moments": {}, "codes": {}}
        for layer, names in data.layers.items():
            own = pre_of(pre, layer)
            x = _transform(table[list(names)].to_numpy(float), list(names), own)[members[f["split_id"]]]
            model["moments"][layer] = _moments(x, own)
            units = codes[f["fit_id"]][layer]
            model["codes"][layer] = np.array([units[u] for u in sorted(units)])
        out.append(model)
    return out


def in_domain(x: np.ndarray, names: list[str], pre: Preprocess) -> np.ndarray:
    """Which rows their transforms take."""
    with np.errstate(invalid="ignore"):
        if pre.transform == "hellinger":
            return ~(np.isnan(x).any(1) | (x < 0).any(1) | ~(x.sum(1) > 0))
        if pre.transform == "clr":
            return ~(np.isnan(x).any(1) | (x < 0).any(1) | ((x == 0).any(1) & (pre.zero_replacement is None)))
        bad = np.zeros(len(x), bool)
        for j, c in enumerate(names):
            kind = pre.of(c)
            bad |= x[:, j] <= 0 if kind == "log" else x[:, j] < 0 if kind in ("log1p", "sqrt") else False
        return ~bad


def map_new(rows: DataFrame, ensemble: Ensemble, pre: Preprocess | dict[str, Preprocess] | None = None, id_col: str = "sample_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``fit_id, sample_id, bmu, distance, error`` of new rows on every successful fit; works
    on streams too. Rows must have all training variables; values outside a transform's
    domain give an error row, not a failed job."""
    layers = {k: list(v) for k, v in ensemble.data.layers.items()}
    names = [c for cs in layers.values() for c in cs]
    missing = [c for c in names if c not in rows.columns]
    if missing:
        raise ValueError(f"new rows lack {', '.join(missing)}")
    fitted = models(ensemble, pre)
    limit = ensemble.spec.max_na_fraction
    kinds = dict(rows.dtypes)

    def of(batches):
        for b in batches:
            out = []
            for m in fitted:
                error = [None] * len(b)
                z = {}
                for layer, cs in layers.items():
                    x = b[cs].to_numpy(float)
                    own = pre_of(pre, layer)
                    t = np.full(x.shape, np.nan)
                    fine = in_domain(x, cs, own)
                    if fine.any():
                        t[fine] = _transform(x[fine], cs, own)
                    for i in np.flatnonzero(~fine).tolist():  # to say what is wrong with each
                        try:
                            _transform(x[i : i + 1], cs, own)
                        except ValueError as e:
                            error[i] = str(e)
                    mean, scale, constant = m["moments"][layer]
                    v = (t - mean) / scale
                    v[:, constant] = 0
                    z[layer] = v
                order = list(layers)
                d = kernels.map_distance([z[k] for k in order], [m["codes"][k] for k in order], [m["weights"][k] for k in order])
                for k in order:
                    d[np.isnan(z[k]).mean(1) > limit] = np.nan
                ok = ~np.isnan(d).all(1) & np.array([e is None for e in error])
                best = np.argmin(np.where(np.isnan(d), np.inf, d), 1)
                one = pd.DataFrame({"fit_id": m["fit_id"], "sample_id": b[id_col].astype(str)})
                one["bmu"] = pd.array(np.where(ok, best + 1, -1), dtype="Int32")
                one.loc[~ok, "bmu"] = pd.NA
                one["distance"] = np.where(ok, d[np.arange(len(d)), best], np.nan)
                one["error"] = error
                for c in keep:
                    one[c] = b[c].to_numpy()
                out.append(one)
            if out:
                result = pd.concat(out, ignore_index=True)
                result["distance"] = result["distance"].astype(object).where(result["distance"].notna(), None)
                yield result

    extra = "".join(f", {c} {kinds[c]}" for c in keep)
    return rows.select(id_col, *names, *[c for c in keep if c not in (id_col, *names)]).mapInPandas(of, f"fit_id string, sample_id string, bmu int, distance double, error string{extra}")
