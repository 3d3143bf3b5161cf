"""Queries that train: ensembles of maps, references, consensus and whole workflows.

But for batch epochs, training has no SQL; these are checked by tests against brute force
and invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import grid as g
from ..operators import consensus, cross, dataset, evidence, partition, plotdata, preprocess, resample, score, sensitivity, simulate, spec, train, workflow
from .common import table
from .maps import BASE, COLS, X, Y, lines


def _dataset(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("orders"))
    rows = j.join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_acctbal", F.coalesce("spend", F.lit(0.0)).alias("spend"), F.coalesce("orders", F.lit(0)).alias("orders"), F.col("c_nationkey").alias("nation"), "r_name")
    return dataset.make_dataset(rows, layers={"money": ["c_acctbal", "spend"], "activity": ["orders"]}, id_col="c_custkey", group="nation", domain="r_name")


_SPEC = spec.Spec(grids=((3, 2), (4, 3)), seeds=(1, 2), steps=15, k=(2, 3))


def _ensemble(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    splits = resample.subsample(data.df, repeats=2, prop=0.8, seed=1)
    return train.fit_ensemble(data, _SPEC, splits)


def som_ensemble(spark, sf_dir):
    return partition.fit_metrics(_ensemble(spark, sf_dir))


def som_partitions(spark, sf_dir):
    e = _ensemble(spark, sf_dir)
    own = partition.sample_labels(e.mapping, partition.unit_labels(e, [2, 3]))
    return own.groupBy("fit_id", "k", "label").agg(F.count(F.lit(1)).alias("n"))


def consensus_workflow(spark, sf_dir):
    e = _ensemble(spark, sf_dir)
    own = partition.sample_labels(e.mapping, partition.unit_labels(e, [2]))
    c = consensus.consensus(own, 2, method="aligned_vote")
    return c.samples


def transfer_leave_domain(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    splits = resample.leave_domain_out(data.df)
    e = train.fit_ensemble(data, spec.Spec(grids=((3, 2),), seeds=(1,), steps=15, k=(2,)), splits.drop("held_domain"))
    return evidence.transfer_metrics(e.mapping)


def map_new_rows(spark, sf_dir):
    e = _ensemble(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.col("s_acctbal").alias("c_acctbal"), (F.col("s_acctbal") * 100).alias("spend"), (F.col("s_suppkey") % 20).alias("orders"))
    return score.map_new(s, e).groupBy("fit_id", "bmu").agg(F.count(F.lit(1)).alias("n"))


def reference_models(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    records = cross.fit_references(data, resample.subsample(data.df, repeats=2, prop=0.8, seed=1), [2, 3], starts=5)
    return records.groupBy("split_id", "method", "k", "task_id", "label").agg(F.count(F.lit(1)).alias("n"))


def simulate_scenarios(spark, sf_dir):
    out = {s: simulate.simulate(spark, s, n=60, p=3, seed=2, missing=0.1 if s == "clusters" else 0.0).select("sample_id", "environment_01", "group", "class_label") for s in simulate.SCENARIOS}
    return sensitivity.flatten(out)


def workflow_decision(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    w = workflow.run_workflow(data, spec.Spec(grids=((3, 2),), seeds=(1, 2), steps=20, k=(2, 3)), resample.subsample(data.df, repeats=3, prop=0.8, seed=4), methods=("kmeans",))
    return w.assess(3, evidence.Gate(min_median_ari=0.5, min_success_rate=0.9))[0]


def representation_audit(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    w = workflow.run_workflow(data, spec.Spec(grids=((3, 2),), seeds=(1, 2), steps=20, k=(2,)), resample.full(data.df))
    return workflow.audit_maps(w, q=5)


def preflight(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    return workflow.preflight(data, _SPEC, resample.unit_subsample(data.df, "group", repeats=3, prop=0.5, seed=2), methods=("kmeans",))


def map_planes(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    e = train.fit_ensemble(data, spec.Spec(grids=((4, 3),), seeds=(1,), steps=15, k=(2,)), resample.full(data.df))
    out = plotdata.plane(e, "occupancy").unionByName(plotdata.plane(e, "component")).unionByName(plotdata.plane(e, "distance"))
    return out


def distributed_training(spark, sf_dir):
    _, mapped = train.fit_distributed(lines(spark, sf_dir), COLS, 3, 2, steps=3, topology="rectangular")
    return mapped.groupBy("bmu").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


def domain_failures(spark, sf_dir):
    """A transform outside its domain gives failed fits as rows, not a failed job."""
    data = _dataset(spark, sf_dir)
    e = train.fit_ensemble(data, spec.Spec(grids=((3, 2),), seeds=(1, 2), steps=5, k=(2,)), resample.full(data.df), preprocess.Preprocess({"c_acctbal": "log1p"}))
    return e.failures


QUERIES = {
    f.__name__: f
    for f in (
        som_ensemble, som_partitions, consensus_workflow, transfer_leave_domain, map_new_rows, reference_models, simulate_scenarios, workflow_decision,
        representation_audit, preflight, map_planes, distributed_training, domain_failures,
    )
}


def _epochs_sql(steps: int) -> str:
    """Batch training of a 3 by 2 map in SQL: each epoch maps all rows and moves the units."""
    distance = g.distances(X, Y, "rectangular")
    start = float(np.quantile(distance, 2 / 3))
    cs = (1, 2, 3, 4)
    out = []
    for i in range(steps + 1):
        code = "code" if i == 0 else f"code{i}"
        far = " + ".join(f"(x{c} - c{c}) ** 2" for c in cs)
        out.append(f"d{i} AS (SELECT sample_id, x1, x2, x3, x4, unit, {far} AS dd FROM z, {code})")
        out.append(f"b{i} AS (SELECT sample_id, any_value(x1) AS x1, any_value(x2) AS x2, any_value(x3) AS x3, any_value(x4) AS x4, arg_min(unit, dd) AS bmu, min(dd) AS dd FROM d{i} GROUP BY sample_id)")
        if i < steps:
            h = np.exp(-(distance**2) / (2 * max(start * (1 - i / steps), 0.1) ** 2))
            pairs = ", ".join(f"({u + 1}, {v + 1}, {float(h[u, v])!r}::DOUBLE)" for u in range(len(h)) for v in range(len(h)))
            out.append(f"s{i} AS (SELECT bmu, count(*) AS n, {', '.join(f'sum(x{c}) AS s{c}' for c in cs)} FROM b{i} GROUP BY bmu)")
            out.append(f"code{i + 1} AS (SELECT unit, {', '.join(f'sum(h * s{c}) / sum(h * n) AS c{c}' for c in cs)} FROM (VALUES {pairs}) t(unit, other, h) JOIN s{i} ON other = bmu GROUP BY unit)")
    return ",\n    ".join(out)


ORACLE: dict[str, str] = {
    "distributed_training": f"WITH {BASE},\n    {_epochs_sql(3)}\n    SELECT bmu, count(*) AS n, round(avg(dd), 6) AS mean_distance FROM b3 GROUP BY bmu",
}
