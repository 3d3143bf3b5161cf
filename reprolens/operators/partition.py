"""Partitions of maps at each k and the agreement between fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.agreement import pair_indices
from ..functions.stats import finite, quantile8
from .spec import check_pairs
from .train import Ensemble


def fit_metrics(ensemble: Ensemble) -> DataFrame:
    return ensemble.fits.where("error is null").select("fit_id", "split_id", "grid_id", "xdim", "ydim", "seed", "quantization_error", "topographic_error", "empty_unit_rate")


def grid_summary(metrics: DataFrame) -> DataFrame:
    """Medians by grid size."""
    mid = lambda c: F.percentile(finite(F.col(c)), F.lit(0.5)).alias(f"median_{c}")
    return metrics.groupBy("xdim", "ydim").agg(F.count(F.lit(1)).alias("n_models"), mid("quantization_error"), mid("topographic_error"), mid("empty_unit_rate"))


def unit_labels(ensemble: Ensemble, ks: list[int]) -> DataFrame:
    """``fit_id, k, unit, label``: Ward partitions of the weighted codebooks."""
    weighted = ensemble.codebook.join(ensemble.fits.select("fit_id", "weights"), "fit_id")
    weighted = weighted.withColumn("codes", F.transform("codes", lambda v: v * F.sqrt(F.element_at("weights", F.col("layer")))))

    def of(group: pd.DataFrame) -> pd.DataFrame:
        units = sorted(group["unit"].unique())
        x = np.array([np.concatenate([np.asarray(r) for r in group[group.unit == u].sort_values("layer")["codes"]]) for u in units])
        rows = [(group["fit_id"].iloc[0], k, int(u), int(c)) for k, labels in kernels.ward(x, ks).items() for u, c in zip(units, labels, strict=True)]
        return pd.DataFrame(rows, columns=["fit_id", "k", "unit", "label"])

    return weighted.select("fit_id", "layer", "unit", "codes").groupBy("fit_id").applyInPandas(of, "fit_id string, k int, unit int, label int")


def sample_labels(mapping: DataFrame, units: DataFrame, scope: str = "analysis") -> DataFrame:
    """``fit_id, k, sample_id, label``: labels of mapped rows; those outside the scope are null."""
    out = mapping.join(units.withColumnRenamed("unit", "bmu"), ["fit_id", "bmu"])
    label = F.when(F.col("role") == "analysis", F.col("label")) if scope == "analysis" else F.col("label")
    return out.select("fit_id", "k", "sample_id", label.alias("label"))


def completeness(labels: DataFrame) -> DataFrame:
    """Per fit and k: observed clusters, the missing ones, and whether all are there."""
    seen = labels.groupBy("fit_id", "k").agg(F.count_distinct("label").alias("n_observed_clusters"), F.array_sort(F.collect_set("label")).alias("_seen"))
    missing = F.array_except(F.sequence(F.lit(1), F.col("k")), F.col("_seen"))
    return seen.select("fit_id", "k", "n_observed_clusters", missing.alias("missing_clusters"), (F.col("n_observed_clusters") == F.col("k")).alias("complete_k"))


def pair_cells(labels: DataFrame, x: str = "fit_id") -> DataFrame:
    """``k, fit_a, fit_b, x, y, n``: joint label counts of all pairs of fits a < b."""
    present = labels.where("label is not null")
    a = present.select("k", "sample_id", F.col(x).alias("fit_a"), F.col("label").alias("x"))
    b = present.select("k", "sample_id", F.col(x).alias("fit_b"), F.col("label").alias("y"))
    # equi-join on the sample: each sample meets its own labels, one per fit
    both = a.join(b, ["k", "sample_id"]).where("fit_a < fit_b")
    return both.groupBy("k", "fit_a", "fit_b", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def pairwise_agreement(labels: DataFrame, n_samples: int, limit: int = 1_000_000) -> DataFrame:
    """``k, fit_a, fit_b, n_joint, joint_coverage, ari, ami`` for all pairs of fits; the
    budget is checked before."""
    sizes = labels.agg(F.count_distinct("fit_id").alias("f"), F.count_distinct("k").alias("k")).first()
    check_pairs(sizes["f"], sizes["k"], limit)
    fits = labels.select("k", "fit_id").distinct()
    pairs = fits.toDF("k", "fit_a").join(fits.toDF("k", "fit_b"), "k").where("fit_a < fit_b")
    found = pair_indices(pair_cells(labels), ("k", "fit_a", "fit_b"))
    out = pairs.join(found, ["k", "fit_a", "fit_b"], "left").withColumn("n_joint", F.coalesce("n_joint", F.lit(0)))
    return out.withColumn("joint_coverage", F.col("n_joint") / F.lit(n_samples)).select("k", "fit_a", "fit_b", "n_joint", "joint_coverage", "ari", "ami")


def stability_summary(pairs: DataFrame, complete: DataFrame) -> DataFrame:
    """Per k: pairs, evaluable ones, medians and type-8 95% intervals of both indices."""
    mid = lambda c: F.percentile(finite(F.col(c)), F.lit(0.5))
    stats = pairs.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.col("ari").isNotNull().cast("int")).alias("n_evaluable"),
        mid("n_joint").alias("median_n_joint"),
        mid("joint_coverage").alias("median_joint_coverage"),
        *(e for m in ("ari", "ami") for e in (mid(m).alias(f"median_{m}"), quantile8(F.col(m), 0.025).alias(f"{m}_low"), quantile8(F.col(m), 0.975).alias(f"{m}_high"))),
    )
    parts = complete.groupBy("k").agg(F.count(F.lit(1)).alias("n_partitions"), F.sum(F.col("complete_k").cast("int")).alias("n_complete"), F.min("n_observed_clusters").alias("min_observed_clusters"))
    return parts.join(stats, "k", "left")
