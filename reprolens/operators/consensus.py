"""Consensus of many partitions: alignment of labels, votes, support and stability.

Labels are a long table ``fit_id, k, sample_id, label``. Work over samples is grouped
aggregations; what reaches the driver are k x k tables of pairs of fits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.stats import finite, quantile8
from .partition import completeness, pair_cells, pairwise_agreement


class ConsensusError(ValueError):
    """Partitions that cannot be brought together."""


def medoid(pairs: DataFrame) -> DataFrame:
    """``k, fit_id, mean_ari``: the fit with the highest mean ARI at each k, its own 1
    included and missing pairs skipped; the first of equals."""
    both = pairs.select("k", F.col("fit_a").alias("fit_id"), "ari").union(pairs.select("k", "fit_b", "ari"))
    own = both.select("k", "fit_id").distinct().withColumn("ari", F.lit(1.0))
    mean = both.union(own).groupBy("k", "fit_id").agg(F.avg("ari").alias("mean_ari"))
    best = Window.partitionBy("k").orderBy(F.desc("mean_ari"), "fit_id")
    return mean.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def coassignment(labels: DataFrame) -> DataFrame:
    """``k, a, b, same, joint, share`` of sample pairs a < b that some fit labels both."""
    present = labels.where("label is not null")
    a = present.select("k", "fit_id", F.col("sample_id").alias("a"), F.col("label").alias("x"))
    b = present.select("k", "fit_id", F.col("sample_id").alias("b"), F.col("label").alias("y"))
    both = a.join(b, ["k", "fit_id"]).where("a < b")
    return both.groupBy("k", "a", "b").agg(F.sum((F.col("x") == F.col("y")).cast("int")).alias("same"), F.count(F.lit(1)).alias("joint")).withColumn("share", F.col("same") / F.col("joint"))


def overlap_components(fits: list[str], joint: dict[tuple[str, str], int]) -> list[set[str]]:
    """Groups of fits that samples in common connect."""
    left, out = set(fits), []
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            f = todo.pop()
            if f not in seen:
                seen.add(f)
                todo += [b if a == f else a for (a, b), n in joint.items() if n and f in (a, b)]
        out.append(seen)
        left -= seen
    return out


def propagate(tables: dict[tuple[str, str], np.ndarray], fits: list[str], k: int, reference: str) -> tuple[dict[str, list[int | None]], list[dict]]:
    """Label maps of all fits to the reference's numbers, and how they were found.

    In turn the fit with most samples in common with those aligned so far, of those
    whose clusters all resolve (the first of equals), is aligned by the best assignment
    on the sum of its tables with them. Tables are (row fit, column fit) counts.
    """

    def table(child: str, parent: str) -> np.ndarray:
        return tables[child, parent] if (child, parent) in tables else tables.get((parent, child), np.zeros((k, k))).T

    maps: dict[str, list[int | None]] = {reference: list(range(1, k + 1))}
    order, notes = [reference], []
    state = {f: np.zeros((k, k)) for f in fits if f != reference}
    parents: dict[str, list[str]] = {f: [] for f in state}

    def add(parent: str) -> None:
        for f in state:
            if f in maps:
                continue
            raw = table(f, parent)
            if raw.sum():
                parents[f].append(parent)
            for c, to in enumerate(maps[parent]):
                if to is not None:
                    state[f][:, to - 1] += raw[:, c]

    add(reference)
    while len(maps) < len(fits):
        ready = []
        for f in fits:
            if f not in maps and state[f].sum():
                found = kernels.align(state[f])
                if all(x is not None for x in found):
                    ready.append((state[f].sum(), f, found))
        if not ready:
            raise ConsensusError("some labels cannot be identified from the samples in common")
        n = max(r[0] for r in ready)
        _, f, found = next(r for r in ready if r[0] == n)
        maps[f] = found
        order.append(f)
        notes.append({"fit_id": f, "parents": ";".join(parents[f]), "n_joint": int(n)})
        add(f)
    return maps, notes


@dataclass
class Consensus:
    """``aligned`` (fit, sample, label), ``samples`` (consensus, support, entropy, counts),
    ``coverage``, ``jaccard`` (fit, cluster) and ``clusters`` for one k."""

    k: int
    method: str
    reference: str
    aligned: DataFrame
    samples: DataFrame
    coverage: DataFrame
    jaccard: DataFrame
    clusters: DataFrame
    diagnostics: list[dict]

    def __repr__(self) -> str:
        return f"Consensus(k={self.k}, {self.method}, reference {self.reference})"


def vote(aligned: DataFrame, reference: str) -> DataFrame:
    """``sample_id, consensus``: the most frequent label; of equals the reference's, if it
    is among them, else the smallest."""
    counts = aligned.where("label is not null").groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("fit_id") == reference).cast("int")).alias("ref"))
    best = counts.groupBy("sample_id").agg(F.max(F.struct("n", "ref", (-F.col("label")).alias("l"))).alias("b"))
    return best.select("sample_id", (-F.col("b.l")).alias("consensus"))


def membership(aligned: DataFrame, consensus: DataFrame, k: int) -> DataFrame:
    """Per sample: assignments, support (share that agrees) and entropy over ln k; both
    null with fewer than two assignments."""
    both = aligned.join(consensus, "sample_id", "left")
    counts = both.where("label is not null").groupBy("sample_id", "consensus", "label").agg(F.count(F.lit(1)).alias("c"))
    stats = counts.groupBy("sample_id", "consensus").agg(
        F.sum("c").alias("n_assignments"),
        F.sum(F.when(F.col("label") == F.col("consensus"), F.col("c")).otherwise(0)).alias("agree"),
        F.sum(F.col("c") * F.ln(F.col("c").cast("double"))).alias("s"),
    )
    n = F.col("n_assignments")
    entropy = F.greatest((F.ln(n.cast("double")) - F.col("s") / n) / F.ln(F.lit(float(k))), F.lit(0.0))
    everyone = aligned.select("sample_id").distinct().join(stats, "sample_id", "left")
    return everyone.select(
        "sample_id", "consensus", F.coalesce(n, F.lit(0)).alias("n_assignments"),
        F.when(n >= 2, F.col("agree") / n).alias("support"), F.when(n >= 2, entropy).alias("entropy"),
    )


def coverages(samples: DataFrame) -> DataFrame:
    """Shares of all samples with an assignment, a consensus label, and two assignments."""
    share = lambda c: F.avg(c.cast("double"))
    return samples.agg(
        share(F.col("n_assignments") >= 1).alias("assignment_coverage"),
        share(F.col("consensus").isNotNull()).alias("consensus_coverage"),
        share(F.col("n_assignments") >= 2).alias("replicated_coverage"),
    )


def cluster_jaccard(aligned: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """``fit_id, cluster, jaccard`` over replicated samples with both labels; null for an
    empty union."""
    both = aligned.join(samples.where("n_assignments >= 2 and consensus is not null"), "sample_id").where("label is not null")
    each = both.select("fit_id", "label", "consensus", F.explode(F.array_distinct(F.array("label", "consensus"))).alias("cluster"))
    hit = (F.col("label") == F.col("cluster")) & (F.col("consensus") == F.col("cluster"))
    found = each.groupBy("fit_id", "cluster").agg(F.avg(hit.cast("double")).alias("jaccard"))
    every = aligned.select("fit_id").distinct().crossJoin(F.broadcast(aligned.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("cluster"))))
    return every.join(found, ["fit_id", "cluster"], "left")


def consensus(labels: DataFrame, k: int, method: str = "auto", max_coassignment: int = 5000, limit: int = 1_000_000) -> Consensus:
    """Consensus of the complete partitions at k.

    ``auto`` builds a co-assignment tree when every sample has all labels and there are
    at most ``max_coassignment``, else aligned votes; asking for co-assignment beyond
    that raises before any pair is made.
    """
    own = labels.where(F.col("k") == k).persist()
    fits = sorted(r[0] for r in own.where("label is not null").select("fit_id").distinct().collect())
    if len(fits) < 2:
        raise ConsensusError("a consensus needs two partitions")
    broken = [r["fit_id"] for r in completeness(own).where("not complete_k").collect()]
    if broken:
        raise ConsensusError(f"incomplete at k={k}: {', '.join(sorted(broken))}")
    size = own.agg(F.count_distinct("sample_id").alias("n"), F.sum(F.col("label").isNull().cast("int")).alias("missing"), F.count(F.lit(1)).alias("rows")).first()
    full = not size["missing"] and size["rows"] == size["n"] * len(fits)
    if method == "auto":
        method = "coassignment" if full and size["n"] <= max_coassignment else "aligned_vote"
    elif method == "coassignment" and size["n"] > max_coassignment:
        raise ConsensusError(f"{size['n']} samples: co-assignment is limited to {max_coassignment}")
    pairs = pairwise_agreement(own, size["n"], limit).persist()
    best = medoid(pairs).first()["fit_id"]
    cells = pair_cells(own).collect()  # k x k counts of each pair of fits, a number within ``limit``
    tables: dict[tuple[str, str], np.ndarray] = {}
    for c in cells:
        tables.setdefault((c["fit_a"], c["fit_b"]), np.zeros((k, k)))[c["x"] - 1, c["y"] - 1] += c["n"]
    joint = {key: int(t.sum()) for key, t in tables.items()}
    if len(overlap_components(fits, joint)) > 1:
        raise ConsensusError("the fits' samples do not connect")
    maps, notes = propagate(tables, fits, k, best)

    def relabel(df: DataFrame, to: dict[str, list[int | None]]) -> DataFrame:
        rows = [(f, i, x) for f, m in to.items() for i, x in enumerate(m, 1)]
        table = df.sparkSession.createDataFrame(rows, "fit_id string, label int, new int")
        return df.join(F.broadcast(table), ["fit_id", "label"], "left").select("fit_id", "sample_id", F.col("new").alias("label"))

    aligned = relabel(own, maps)
    if method == "coassignment":
        found = _coassignment_labels(own, k, full)
    else:
        found = vote(aligned, best)
    # every fit is aligned anew to what was decided
    cells = own.where("label is not null").join(found, "sample_id").where("consensus is not null").groupBy("fit_id", "label", "consensus").agg(F.count(F.lit(1)).alias("n")).collect()
    last: dict[str, np.ndarray] = {f: np.zeros((k, k)) for f in fits}
    for c in cells:
        last[c["fit_id"]][c["label"] - 1, c["consensus"] - 1] += c["n"]
    aligned = relabel(own, {f: kernels.align(t) for f, t in last.items()}).persist()
    samples = membership(aligned, found, k).persist()
    jac = cluster_jaccard(aligned, samples, k)
    clusters = jac.groupBy("cluster").agg(
        F.count("jaccard").alias("n_fits"), F.percentile(finite(F.col("jaccard")), F.lit(0.5)).alias("median_jaccard"),
        quantile8(F.col("jaccard"), 0.025).alias("low"), quantile8(F.col("jaccard"), 0.975).alias("high"),
    )
    return Consensus(k, method, best, aligned, samples, coverages(samples), jac, clusters, notes)


def _coassignment_labels(own: DataFrame, k: int, full: bool) -> DataFrame:
    """Average linkage on one minus the co-assignment shares: within the sample limit."""
    ids = [r[0] for r in own.select("sample_id").distinct().orderBy("sample_id").collect()]
    place = {s: i for i, s in enumerate(ids)}
    share = np.full((len(ids), len(ids)), np.nan)
    for r in coassignment(own).toLocalIterator():
        share[place[r["a"]], place[r["b"]]] = share[place[r["b"]], place[r["a"]]] = r["share"]
    np.fill_diagonal(share, 1.0)
    if np.isnan(share).any():
        raise ConsensusError("some pairs of samples are never labelled together")
    labels = kernels.cut_tree(kernels.linkage(1 - share, "average"), len(ids), k)
    return own.sparkSession.createDataFrame([(s, int(c)) for s, c in zip(ids, labels, strict=True)], "sample_id string, consensus int")


