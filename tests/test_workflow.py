"""Whole audits on simulated data."""

import pytest

from reprolens.operators import cross, dataset, evidence, resample, score, simulate, spec, train, workflow


@pytest.fixture(scope="module")
def data(spark):
    df = simulate.simulate(spark, "clusters", n=60, p=3, seed=5, n_domains=3)
    return dataset.make_dataset(df, columns=[c for c in df.columns if c.startswith("environment")], id_col="sample_id", group="group", domain="domain")


SPEC = spec.Spec(grids=((3, 2),), seeds=(1, 2), steps=15, k=(2, 3))


def test_workflow_and_decision(spark, data):
    splits = resample.subsample(data.df, 2, 0.8, 1)
    w = workflow.run_workflow(data, SPEC, splits, methods=("ward",))
    assert w.ensemble.failures.count() == 0
    s = w.stability.where("k = 3").first()
    assert s["n_pairs"] == 6 and 0.5 < s["median_ari"] <= 1
    assert w.comparison.where("k = 3 and ari < 0.3").count() == 0
    checks, status = w.assess(3, evidence.Gate(min_median_ari=0.3, min_success_rate=1.0))
    assert status.first()["status"] in ("supported", "abstain") and checks.where("check = 'min_success_rate'").first()["passed"]
    assert {r["k"] for r in w.consensus_summary([2, 3])} == {2, 3}
    assert w.diagnostics()[0]["stage"] == "fit"
    assert workflow.verdict(data, SPEC, splits) == "ok"
    assert workflow.verdict(data, SPEC, splits, max_pairs=1) == "pairwise_budget"


def test_evidence_must_belong_together(spark, data):
    splits = resample.subsample(data.df, 2, 0.8, 1)
    w, other = (workflow.run_workflow(data, spec.Spec(grids=((3, 2),), seeds=(s,), steps=5, k=(2,)), splits) for s in (1, 2))
    w.assess(2)
    w.sources["consensus", 2] = other.sources["consensus", 2]
    with pytest.raises(workflow.ProvenanceError):
        w.assess(2)
    del w.sources["consensus", 2]
    with pytest.raises(workflow.ProvenanceError):
        w.assess(2)
    other.labels = w.labels
    with pytest.raises(workflow.ProvenanceError):
        other.assess(2)
    every = workflow.run_workflow(data, spec.Spec(grids=((3, 2),), seeds=(1,), steps=5, k=(2,)), splits, scope="all")
    with pytest.raises(workflow.ProvenanceError):
        every.assess(2)


def test_requested_pairs_and_design(spark, data):
    w = workflow.run_workflow(data, SPEC, resample.subsample(data.df, 2, 0.8, 1))
    got = workflow.audit_maps(w, q=5).collect()
    assert len(got) == 6 and sum(r["same_split"] for r in got) == 2 and all(r["same_grid"] for r in got)
    one = spark.createDataFrame([(got[0]["fit_b"], got[0]["fit_a"])], "fit_a string, fit_b string")
    again = workflow.audit_maps(w, q=5, pairs=one).collect()
    assert [(r["fit_a"], r["fit_b"], r["distance_correlation"]) for r in again] == [(got[0]["fit_a"], got[0]["fit_b"], pytest.approx(got[0]["distance_correlation"]))]
    for bad in ([("x", "y")], [(got[0]["fit_a"],) * 2]):
        with pytest.raises(ValueError):
            workflow.audit_maps(w, pairs=spark.createDataFrame(bad, "fit_a string, fit_b string"))


def test_references_see_weighted_layers(spark):
    """Two layers of unequal weight and transforms of their own, against numpy."""
    import numpy as np

    from reprolens.functions import kernels
    from reprolens.operators import preprocess

    r = np.random.default_rng(4)
    a, b = r.normal(size=(40, 2)) * 3, r.gamma(2.0, size=(40, 3))
    rows = [(f"s{i:02d}", *map(float, a[i]), *map(float, b[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, a1 double, a2 double, b1 double, b2 double, b3 double")
    d = dataset.make_dataset(df, layers={"a": ["a1", "a2"], "b": ["b1", "b2", "b3"]}, id_col="id")
    pre = {"a": preprocess.Preprocess(), "b": preprocess.Preprocess("hellinger")}
    z = {"a": a, "b": np.sqrt(b / b.sum(1, keepdims=True))}
    z = {k: (v - v.mean(0)) / v.std(0, ddof=1) for k, v in z.items()}
    w = {k: q / (2 * z[k].var(0, ddof=1).sum()) for k, q in (("a", 0.9), ("b", 0.1))}
    total = sum(w.values())
    m = np.column_stack([z[k] * np.sqrt(w[k] / total) for k in z])
    want = kernels.cut_tree(kernels.linkage(kernels.euclidean(m), "ward"), 40, 4)
    got = cross.fit_references(d, resample.full(d.df), [4], ("ward",), pre, layer_weights={"a": 0.9, "b": 0.1}).orderBy("sample_id").collect()
    assert [g["label"] for g in got] == want.tolist()
    flat = cross.fit_references(d, resample.full(d.df), [4], ("ward",), pre, layer_weights={"a": 0.1, "b": 0.9}).orderBy("sample_id").collect()
    assert [g["label"] for g in flat] != want.tolist()


def test_budget_is_checked_before_fitting(spark, data):
    with pytest.raises(spec.BudgetError):
        workflow.run_workflow(data, SPEC, resample.subsample(data.df, 2, 0.8, 1), max_pairs=1)


def test_new_rows_and_references(spark, data):
    e = train.fit_ensemble(data, spec.Spec(grids=((3, 2),), seeds=(1,), steps=15, k=(2,)), resample.leave_domain_out(data.df).drop("held_domain"))
    again = score.map_new(data.df, e)
    both = again.join(e.mapping.withColumnRenamed("bmu", "old"), ["fit_id", "sample_id"])
    assert both.where("bmu <> old").count() == 0 and both.count() == 180
    with pytest.raises(ValueError):
        score.map_new(data.df.drop("environment_01"), e)
    records = cross.fit_references(data, resample.full(data.df), [2, 60], ("ward",))
    assert records.where("error is not null and k = 60").count() == 1 and records.where("k = 2").count() == 60


def test_sensitivity_keeps_failures(spark, data):
    from pyspark.sql import functions as F

    # identifiers that look generated are not matched between scenarios
    named = data.df.withColumn("sample_id", F.concat(F.lit("plot-"), "sample_id"))
    named = dataset.make_dataset(named, columns=data.variables, id_col="sample_id")
    one = {"data": named, "spec": spec.Spec(grids=((3, 2),), seeds=(1, 2), steps=10, k=(2,)), "splits": resample.full(named.df)}
    out = workflow.run_sensitivity({"a": one, "b": one, "bad": {**one, "max_pairs": 0}})
    assert [f[0] for f in out["failures"]] == ["bad"]
    got = {(r["a"], r["b"]): r["comparison_status"] for r in out["contrasts"].collect()}
    assert got["a", "b"] == "evaluated" and got["a", "bad"] == "scenario_failed_b"
    assert out["samples"].where("shared_jaccard < 1").count() == 0


def test_reference_tasks_do_not_share_a_partition(spark, data):
    from pyspark.sql import functions as F

    for n in (1, 6, 40):
        keys = spark.createDataFrame([(k,) for k in cross.apart(spark, n)], "key long")
        assert keys.repartition(n, "key").select(F.spark_partition_id().alias("p")).distinct().count() == n
    records = cross.fit_references(data, resample.subsample(data.df, 3, 0.8, 1), [2, 3], ("kmeans",), starts=2)
    assert records.select(F.spark_partition_id().alias("p"), "task_id").distinct().groupBy("p").count().where("count > 1").count() == 0
