"""Reference clusterings (k-means, Ward, Gaussian mixtures) on the same splits, and
their agreement with the map partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.agreement import pair_indices
from ..functions.stats import finite, quantile8
from .dataset import Dataset
from .preprocess import Preprocess
from .train import MAX_BYTES, members, prepared, roles, shared_rows

METHODS = ("kmeans", "ward", "gmm")
#: Ward keeps all distances of a split up to so many rows; beyond, rows only.
WARD_DISTANCES = 3000
#: Records that a task hands to Spark at once.
BLOCK = 50_000

RECORD = "split_id string, method string, k int, seed long, task_id string, sample_id string, role string, label int, detail string, error string"


def fit_references(data: Dataset, splits: DataFrame, ks: list[int], methods: tuple[str, ...] = METHODS, pre: Preprocess | dict[str, Preprocess] | None = None, seeds: tuple[int, ...] = (1,), starts: int = 50, max_bytes: int = MAX_BYTES, layer_weights: dict[str, float] | None = None, normalize_layers: bool = True) -> DataFrame:
    """Labels of every split, method and k, one task per split and method (k-means and
    mixtures: and k); a failure is a row with its error for each k. Every layer is transformed
    by itself and enters with the square root of its effective weight, as in the maps'
    distance. Held-out complete rows go to the nearest centre of the training clusters (the
    first of equals); incomplete rows stay unlabelled."""
    if any(m not in METHODS for m in methods):
        raise ValueError(f"methods are {', '.join(METHODS)}")
    spark = data.df.sparkSession
    if data.df.count() * 8 * len(data.variables) > max_bytes:
        raise ValueError(f"the rows take over {max_bytes} bytes")
    columns = {k: list(v) for k, v in data.layers.items()}
    shared = shared_rows(data)
    tasks = [(m, s, some) for m in methods for s in (seeds if m == "kmeans" else (0,)) for some in ([list(ks)] if m == "ward" else [[k] for k in ks])]
    names = sorted(r["split_id"] for r in splits.select("split_id").distinct().collect())  # the budget
    jobs = [(name, *t) for name in names for t in tasks]
    every_job = spark.createDataFrame([(*j, key) for j, key in zip(jobs, apart(spark, len(jobs)), strict=True)], "split_id string, method string, seed long, ks array<int>, key long")
    dealt = members(splits).join(F.broadcast(every_job), "split_id").repartition(max(1, len(jobs)), "key")

    def run(batches):
        ids, layers = shared.value
        ids = ids.to_numpy(zero_copy_only=False)
        place = pd.Index(ids)
        for batch in batches:
            for job in batch.itertuples(index=False):
                role = roles(place, job.members)
                task = lambda k: f"{job.split_id}__{job.method}__k{k}" + (f"__s{job.seed}" if job.method == "kmeans" else "")  # noqa: E731, B023
                train, named = role == "analysis", np.flatnonzero(role != "")
                tree, z = None, None
                for k in map(int, job.ks):
                    head = (job.split_id, job.method, k, job.seed, task(k))
                    try:
                        if z is None:
                            done, weight, _ = prepared(layers, columns, train, pre, layer_weights, normalize_layers)
                            z = np.column_stack([done[name] * np.sqrt(weight[name]) for name in done])
                            own = z[train]
                        if np.isnan(own).any():
                            raise ValueError("references need complete training rows")
                        if len(own) <= k:
                            raise ValueError(f"{len(own)} training rows for {k} clusters")
                        seed, detail = kernels.sample_seed(job.seed, task(k)), "nearest_centroid"
                        if job.method == "kmeans":
                            label, _ = kernels.kmeans(own, k, seed, starts)
                        elif job.method == "ward":
                            tree = tree or (kernels.linkage(kernels.euclidean(own), "ward") if len(own) <= WARD_DISTANCES else kernels.ward_tree(own))
                            label = kernels.cut_tree(tree, len(own), k)
                        else:
                            label, model, bic = kernels.gaussian_mixture(own, k, seed)
                            detail = f"{model}; bic {bic:.6g}"
                        centre = np.array([own[label == c].mean(0) for c in range(1, label.max() + 1)])
                        every = np.full(len(ids), 0)
                        every[train] = label
                        rest = (role == "assessment") & ~np.isnan(z).any(1)
                        if rest.any():
                            every[rest] = np.argmin(kernels.squares(z[rest].T, centre), 0) + 1
                    except Exception as e:
                        yield _records(head, [None], [None], [None], None, str(e))
                        continue
                    for i in range(0, len(named), BLOCK):
                        part = named[i : i + BLOCK]
                        yield _records(head, ids[part], role[part], every[part], detail, None)

    return dealt.mapInPandas(run, RECORD).persist()


def apart(spark, n: int) -> list[int]:
    """Numbers that ``repartition(n, ...)`` puts into a partition each, so that no two long
    tasks share one."""
    found = spark.range(60 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect() if n else []
    keys = {r["p"]: r["id"] for r in found}
    return [keys.get(i, i) for i in range(n)]


def _records(head: tuple, ids, roles, labels, detail: str | None, error: str | None) -> pd.DataFrame:
    """Rows of ``RECORD`` for one task; label 0 is null."""
    out = pd.DataFrame({"sample_id": ids, "role": roles, "label": pd.Series(labels, dtype="Int32")})
    out["label"] = out["label"].mask(out["label"] == 0)
    names = [c.split()[0] for c in RECORD.split(", ")]
    for name, value in zip((*names[:5], "detail", "error"), (*head, detail, error), strict=True):
        out[name] = value
    return out[names]


def nearest_centroid(rows: DataFrame, centres: DataFrame, columns: list[str], id_col: str = "sample_id") -> DataFrame:
    """``id, cluster``: the nearest centre (the first of equals) of each complete row."""
    code = centres.select("cluster", *(F.col(c).alias(f"c__{c}") for c in columns))
    whole = rows.dropna(subset=columns)
    d = sum(((F.col(c) - F.col(f"c__{c}")) * (F.col(c) - F.col(f"c__{c}")) for c in columns), F.lit(0.0))
    both = whole.crossJoin(F.broadcast(code)).withColumn("d", d)
    return both.groupBy(id_col).agg(F.min_by("cluster", F.struct("d", "cluster")).alias("cluster"))


def compare_references(map_labels: DataFrame, references: DataFrame, scope: str = "analysis") -> DataFrame:
    """``fit_id, split_id, k, task_id, method, n_joint, ari, ami`` of map and reference labels
    (``map_labels``: fit_id, split_id, k, sample_id, role, label) in the scope."""
    pick = lambda df: df if scope == "all" else df.where(F.col("role") == scope)
    ref = pick(references.where("error is null and label is not null")).select("split_id", "k", "method", "task_id", "sample_id", F.col("label").alias("y"))
    own = pick(map_labels.where("label is not null")).select("fit_id", "split_id", "k", "sample_id", F.col("label").alias("x"))
    cells = own.join(ref, ["split_id", "k", "sample_id"]).groupBy("fit_id", "split_id", "k", "method", "task_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    if scope != "analysis" and not cells.limit(1).count():
        raise ValueError(f"no {scope} rows to compare")
    return pair_indices(cells, ("fit_id", "split_id", "k", "method", "task_id"))


def cross_summary(comparisons: DataFrame) -> DataFrame:
    """Medians and type-8 95% intervals by method and k."""
    e = [F.count(F.lit(1)).alias("n_comparisons")]
    for m in ("ari", "ami"):
        e += [F.percentile(finite(F.col(m)), F.lit(0.5)).alias(f"median_{m}"), quantile8(F.col(m), 0.025).alias(f"{m}_low"), quantile8(F.col(m), 0.975).alias(f"{m}_high")]
    return comparisons.groupBy("method", "k").agg(*e)


def reference_status(records: DataFrame, methods: list[str], ks: list[int], expected: int) -> DataFrame:
    """``method, k, expected, succeeded, failed, success_rate`` of all methods and k, also
    those without a record."""
    spark = records.sparkSession
    every = spark.createDataFrame([(m, k) for m in methods for k in ks], "method string, k int")
    tasks = records.groupBy("method", "k", "task_id").agg(F.max(F.col("error").isNotNull().cast("int")).alias("bad"))
    counts = tasks.groupBy("method", "k").agg(F.sum(1 - F.col("bad")).alias("succeeded"))
    out = every.join(counts, ["method", "k"], "left").withColumn("succeeded", F.coalesce("succeeded", F.lit(0)))
    return out.select("method", "k", F.lit(expected).alias("expected"), "succeeded", (F.lit(expected) - F.col("succeeded")).alias("failed"), (F.col("succeeded") / F.lit(expected)).alias("success_rate"))
