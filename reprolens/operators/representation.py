"""Do maps represent the samples alike? Grid distances of sample pairs and grid
neighbourhoods, compared between fits from counts per unit: pairs of samples are never
enumerated."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid as g
from ..functions.stats import finite, quantile8
from .spec import BudgetError


def metric_status(mapping: DataFrame) -> DataFrame:
    """Per fit: rows in scope, mapped ones, mean distance and what could be computed."""
    m = mapping.groupBy("fit_id").agg(F.count(F.lit(1)).alias("n_scope"), F.sum(F.col("bmu").isNotNull().cast("int")).alias("n_mapped"), F.avg("distance").alias("quantization_error"))
    status = (
        F.when(F.col("n_scope") == 0, "no_scope_rows").when(F.col("n_mapped") == 0, "no_mapped_rows")
        .when(F.col("n_mapped") < F.col("n_scope"), "computed_with_partial_mapping").otherwise("computed")
    )
    return m.withColumn("metric_status", status)


def weighted_spearman(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    """Rank correlation (average ranks) of values x, y that occur n times each; null if
    either is constant."""

    def ranks(v: np.ndarray) -> np.ndarray:
        u, inverse = np.unique(v, return_inverse=True)
        c = np.bincount(inverse, weights=n, minlength=len(u))
        return (np.cumsum(c) - c + (c + 1) / 2)[inverse]

    a, b, t = ranks(x), ranks(y), n.sum()
    a, b = a - (a * n).sum() / t, b - (b * n).sum() / t
    va, vb = (a * a * n).sum(), (b * b * n).sum()
    return None if va <= 0 or vb <= 0 else float((a * b * n).sum() / np.sqrt(va * vb))


def unit_pairs(mapping: DataFrame, pairs: DataFrame) -> DataFrame:
    """``fit_a, fit_b, ua, ub, n``: how many samples lie on unit ua in one and ub in the other."""
    m = mapping.where("bmu is not null").select("fit_id", "sample_id", "bmu")
    a = pairs.join(m.toDF("fit_a", "sample_id", "ua"), "fit_a")
    both = a.join(m.toDF("fit_b", "sample_id", "ub"), ["fit_b", "sample_id"])
    return both.groupBy("fit_a", "fit_b", "ua", "ub").agg(F.count(F.lit(1)).alias("n"))


def hop_histogram(cells: pd.DataFrame, hop_a: np.ndarray, hop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joint counts of grid distances over all pairs of samples, from unit counts."""
    ua, ub, n = (cells[c].to_numpy(int) for c in ("ua", "ub", "n"))
    da, db = hop_a[np.ix_(ua - 1, ua - 1)], hop_b[np.ix_(ub - 1, ub - 1)]
    pairs = np.outer(n, n).astype(float)
    np.fill_diagonal(pairs, n * (n - 1.0))
    width = int(db.max(initial=0)) + 1
    total = np.bincount((da * width + db).ravel(), weights=pairs.ravel())
    key = np.flatnonzero(total)
    return key // width, key % width, total[key] / 2


def neighbour_jaccard(cells: pd.DataFrame, hop_a: np.ndarray, hop_b: np.ndarray, q: int) -> float | None:
    """Median over samples of the Jaccard of their q nearest others (all tied at the
    q-th distance included) on the two maps."""
    ua, ub, n = (cells[c].to_numpy(int) for c in ("ua", "ub", "n"))
    if n.sum() <= q:
        return None
    da, db = hop_a[np.ix_(ua - 1, ua - 1)], hop_b[np.ix_(ub - 1, ub - 1)]
    values, weights = [], []
    for i in range(len(n)):
        others = n.copy()
        others[i] -= 1  # the sample itself

        def near(d: np.ndarray, others: np.ndarray = others) -> np.ndarray:
            order = np.argsort(d, kind="stable")
            cut = d[order][np.searchsorted(np.cumsum(others[order]), q)]
            return d <= cut

        a, b = near(da[i]), near(db[i])
        values.append(others[a & b].sum() / others[a | b].sum())
        weights.append(n[i])
    order = np.argsort(values)
    flat = np.repeat(np.asarray(values)[order], np.asarray(weights)[order])
    return float(np.median(flat))


def compare_maps(mapping: DataFrame, fits: DataFrame, pairs: DataFrame, q: int = 10, topology: str = "hexagonal", toroidal: bool = False, max_pairs: int = 10_000, max_cells: int = 4_000_000) -> DataFrame:
    """Per pair of fits: joint samples, rank correlation of grid distances, and median
    neighbourhood Jaccard, with a status where one cannot be had.

    Both budgets (pairs of fits; pairs of units of a pair of fits) are checked first.
    """
    n = pairs.count()
    if n > max_pairs:
        raise BudgetError(f"{n} pairs of fits; the limit is {max_pairs}")
    sizes = {r["fit_id"]: (r["xdim"], r["ydim"]) for r in fits.select("fit_id", "xdim", "ydim").collect()}
    largest = max((x * y for x, y in sizes.values()), default=0)
    if largest**4 > max_cells**2:
        raise BudgetError(f"maps of {largest} units: over {max_cells} pairs of unit pairs")
    hops = {s: g.hops(*s, topology, toroidal) for s in set(sizes.values())}

    def of(key, cells: pd.DataFrame) -> pd.DataFrame:
        fa, fb = key
        total = int(cells["n"].sum())
        ha, hb = hops[sizes[fa]], hops[sizes[fb]]
        rho, status = None, "too_few_jointly_mapped"
        if total >= 3:
            rho = weighted_spearman(*hop_histogram(cells, ha, hb))
            status = "computed" if rho is not None else "constant_topological_distances"
        jac = neighbour_jaccard(cells, ha, hb, q)
        return pd.DataFrame([(fa, fb, total, rho, status, jac, "computed" if jac is not None else "too_few_jointly_mapped")], columns=["fit_a", "fit_b", "n_joint", "distance_correlation", "correlation_status", "neighbour_jaccard", "jaccard_status"])

    schema = "fit_a string, fit_b string, n_joint long, distance_correlation double, correlation_status string, neighbour_jaccard double, jaccard_status string"
    found = unit_pairs(mapping, pairs).groupBy("fit_a", "fit_b").applyInPandas(of, schema)
    out = pairs.select("fit_a", "fit_b").join(found, ["fit_a", "fit_b"], "left")
    return out.withColumns({"n_joint": F.coalesce("n_joint", F.lit(0)), "correlation_status": F.coalesce("correlation_status", F.lit("too_few_jointly_mapped")), "jaccard_status": F.coalesce("jaccard_status", F.lit("too_few_jointly_mapped"))})


def check_fits(fits: DataFrame, pairs: DataFrame) -> None:
    """Raise if fits repeat an identifier or pairs name one that is not among them."""
    if fits.groupBy("fit_id").count().where("count > 1").limit(1).count():
        raise ValueError("fits repeat an identifier")
    named = pairs.select(F.explode(F.array("fit_a", "fit_b")).alias("fit_id")).distinct()
    unknown = named.join(fits, "fit_id", "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"no such fits: {', '.join(r['fit_id'] for r in unknown)}")


def with_design(pairs: DataFrame, fits: DataFrame) -> DataFrame:
    """``pairs`` with the split and grid of both fits, ``same_split`` and ``same_grid``."""
    own = fits.select("fit_id", "split_id", "grid_id")
    side = lambda s: own.toDF(f"fit_{s}", f"split_{s}", f"grid_{s}")
    both = pairs.join(side("a"), "fit_a").join(side("b"), "fit_b")
    return both.withColumns({"same_split": F.col("split_a") == F.col("split_b"), "same_grid": F.col("grid_a") == F.col("grid_b")})


def fit_summary(metrics: DataFrame) -> DataFrame:
    """Per grid (``grid_id, xdim, ydim``): fits, those that could be evaluated, and medians of
    what is finite in mapping_coverage, quantization_error, topographic_error and
    empty_unit_rate."""
    mid = lambda c: F.percentile(finite(F.col(c)), F.lit(0.5)).alias(f"median_{c}")
    done = F.col("metric_status").isin("computed", "computed_with_partial_mapping")
    return metrics.groupBy("grid_id", "xdim", "ydim").agg(
        F.count(F.lit(1)).alias("n_fits"), F.sum(done.cast("int")).alias("n_evaluable"),
        *(mid(c) for c in ("mapping_coverage", "quantization_error", "topographic_error", "empty_unit_rate")),
    )


def pair_summary(pairs: DataFrame, value: str = "distance_correlation") -> DataFrame:
    """Per ``same_split, same_grid``: pairs, those with a finite correlation, its median and
    type-8 95% interval."""
    own = finite(F.col(value))
    return pairs.groupBy("same_split", "same_grid").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count(own).alias("n_rho_evaluable"), F.percentile(own, F.lit(0.5)).alias("median_rho"),
        quantile8(F.col(value), 0.025).alias("rho_low"), quantile8(F.col(value), 0.975).alias("rho_high"),
    )


def requested_pairs(pairs: DataFrame) -> DataFrame:
    """Unordered pairs of fits, each once; a fit with itself raises."""
    if pairs.where("fit_a = fit_b").limit(1).count():
        raise ValueError("a fit cannot be compared with itself")
    ordered = pairs.select(F.least("fit_a", "fit_b").alias("fit_a"), F.greatest("fit_a", "fit_b").alias("fit_b"))
    if ordered.groupBy("fit_a", "fit_b").count().where("count > 1").limit(1).count():
        raise ValueError("a pair is given twice")
    return ordered


def hop_counts(placed: DataFrame, hops: DataFrame, unit_a: str, unit_b: str) -> DataFrame:
    """``hop_a, hop_b, n``: pairs of samples by their grid distances on two maps of the
    same grid, in SQL: units are joined with units, never samples with samples."""
    cells = placed.groupBy(F.col(unit_a).alias("ua"), F.col(unit_b).alias("ub")).agg(F.count(F.lit(1)).alias("n"))
    a = cells.select(F.col("ua").alias("ua1"), F.col("ub").alias("ub1"), F.col("n").alias("n1"))
    b = cells.select(F.col("ua").alias("ua2"), F.col("ub").alias("ub2"), F.col("n").alias("n2"))
    ha = hops.toDF("ua1", "ua2", "hop_a")
    hb = hops.toDF("ub1", "ub2", "hop_b")
    both = a.crossJoin(b).join(F.broadcast(ha), ["ua1", "ua2"]).join(F.broadcast(hb), ["ub1", "ub2"])  # units squared, twice
    same = (F.col("ua1") == F.col("ua2")) & (F.col("ub1") == F.col("ub2"))
    n = F.when(same, F.col("n1") * (F.col("n1") - 1)).otherwise(F.col("n1") * F.col("n2"))
    return both.groupBy("hop_a", "hop_b").agg((F.sum(n) / 2).cast("long").alias("n")).where("n > 0")


def spearman_of_counts(counts: DataFrame, x: str = "hop_a", y: str = "hop_b") -> DataFrame:
    """One row, rho: rank correlation with average ranks from a table of counts."""

    def ranks(c: str, name: str) -> DataFrame:
        t = counts.groupBy(c).agg(F.sum("n").alias("c"))
        # as many rows as distinct grid distances
        o = t.select(F.col(c).alias("_o"), F.col("c").alias("_oc"))
        return t.crossJoin(o).groupBy(c, "c").agg(F.sum(F.when(F.col("_o") < F.col(c), F.col("_oc")).otherwise(0)).alias("b")).select(c, (F.col("b") + (F.col("c") + 1) / 2).alias(name))

    r = counts.join(ranks(x, "ra"), x).join(ranks(y, "rb"), y)
    n = F.col("n").cast("double")
    m = r.agg(F.sum(n).alias("t"), F.sum(n * F.col("ra")).alias("sa"), F.sum(n * F.col("rb")).alias("sb"), F.sum(n * F.col("ra") * F.col("ra")).alias("saa"), F.sum(n * F.col("rb") * F.col("rb")).alias("sbb"), F.sum(n * F.col("ra") * F.col("rb")).alias("sab"))
    top = F.col("sab") - F.col("sa") * F.col("sb") / F.col("t")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("t"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("t")
    return m.select(F.when((va > 0) & (vb > 0), top / F.sqrt(va * vb)).alias("rho"))
