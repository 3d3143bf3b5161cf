"""Operators on small tables: hand-computed cases, failures and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprolens.operators import consensus, contracts, dataset, evidence, mapping, partition, preprocess, representation, resample, sensitivity, simulate, spec, train
from reprolens.sources import tables


def test_dataset_checks(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", float("nan"), "y")], "id string, v double, g string")
    d = dataset.make_dataset(df, columns=["v"], id_col="id", group="g")
    assert d.id_source == "provided" and d.df.where("v is null").count() == 1
    for bad, columns in ((df.union(df), ["v"]), (df, ["g"]), (df, ["none"]), (df.limit(0), ["v"])):
        with pytest.raises(dataset.DataError):
            dataset.make_dataset(bad, columns=columns, id_col="id")
    with pytest.raises(dataset.DataError):
        dataset.make_dataset(spark.createDataFrame([("a", float("inf"))], "id string, v double"), columns=["v"], id_col="id")
    with pytest.raises(dataset.DataError):
        dataset.make_dataset(df, id_col="id")
    assert dataset.integer_set("3, 1,3") == [3, 1]
    with pytest.raises(ValueError):
        dataset.integer_set("1,,2")


def test_training_moments_do_not_leak(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([0.0, 1.0, 2.0, 3.0, 4.0, 100.0], [2.0, 3.0, 4.0, 5.0, 6.0, 50.0], strict=True))], "i int, a double, b double")
    f = preprocess.fit_preprocess(df.where("i < 5"), ["a", "b"], preprocess.Preprocess())
    assert f.means == {"a": 2.0, "b": 4.0}
    done = preprocess.apply_preprocess(df, f)
    assert abs(done.where("i < 5").agg(F.avg("a")).first()[0]) < 1e-12
    constant = spark.createDataFrame([(5.0,), (5.0,)], "c double")
    f = preprocess.fit_preprocess(constant, ["c"], preprocess.Preprocess())
    new = spark.createDataFrame([(5.0,), (500.0,), (None,)], "c double")
    assert [r[0] for r in preprocess.apply_preprocess(new, f).collect()] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize(("kind", "rows"), [("log", [(0.0, 1.0)]), ("sqrt", [(-1.0, 1.0)]), ("hellinger", [(None, 1.0)]), ("hellinger", [(0.0, 0.0)]), ("clr", [(0.0, 1.0)])])
def test_transform_domains(spark, kind, rows):
    with pytest.raises(preprocess.TransformError):
        preprocess.check_domain(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], preprocess.Preprocess(kind))


def test_splits(spark):
    df = spark.createDataFrame([(f"s{i}", f"g{i % 4}", f"d{i % 3}") for i in range(20)], "sample_id string, group string, domain string")
    s = resample.subsample(df, 3, 0.8, 1)
    assert {r["count"] for r in s.where("role = 'analysis'").groupBy("split_id").count().collect()} == {16}
    assert s.exceptAll(resample.subsample(df.repartition(3), 3, 0.8, 1)).count() == 0
    g = resample.unit_subsample(df, "group", 2, 0.5, 1).join(df, "sample_id")
    assert g.groupBy("split_id", "group").agg(F.count_distinct("role").alias("r")).where("r > 1").count() == 0
    assert resample.leave_domain_out(df).select("split_id").distinct().count() == 3
    with pytest.raises(resample.DesignError):
        resample.leave_domain_out(df.where("domain = 'd0'"))
    twice = spark.createDataFrame([("x", "s1"), ("x", "s1")], "split_id string, sample_id string")
    with pytest.raises(resample.DesignError):
        resample.custom(df, twice)


def test_spec_and_budget(spark):
    assert spec.expand(spark, spec.Spec(grids=((3, 2),), seeds=(2, 1), k=(2,))).count() == 2
    for bad in ({"grids": ((1, 2),)}, {"seeds": (1, 1)}, {"k": (1,)}, {"grids": ((2, 2),), "k": (5,)}):
        with pytest.raises(spec.SpecError):
            spec.Spec(**bad)
    assert spec.check_pairs(4, 1, 6) == 6
    with pytest.raises(spec.BudgetError):
        spec.check_pairs(4, 1, 5)


def test_mapping_with_missing_values(spark):
    code = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 1.0, 1.0)], "unit int, a double, b double")
    rows = spark.createDataFrame([("x", 0.9, None), ("y", None, None), ("z", 1.0, 1.0)], "sample_id string, a double, b double")
    got = {r["sample_id"]: r for r in mapping.map_rows(rows, code, {"data": ("a", "b")}).collect()}
    assert got["x"]["bmu"] == 2 and got["x"]["distance"] == pytest.approx(0.02)
    assert got["y"]["bmu"] is None and got["z"]["second"] == 3
    mapped = mapping.map_rows(rows, code, {"data": ("a", "b")})
    assert mapping.unoccupied_rate(mapped, mapped.where("sample_id = 'y'")).first()[0] == 1.0
    assert mapping.unoccupied_rate(mapped.where("bmu is null"), mapped).first() is None or mapping.unoccupied_rate(mapped.where("bmu is null"), mapped).first()[0] is None


def test_pareto(spark):
    df = spark.createDataFrame([("a", 1.0, 0.6), ("b", 2.0, 0.9), ("c", 1.5, 0.75), ("d", 3.0, 0.4), ("e", 1.0, 0.6)], "id string, qe double, stability double")
    assert sorted(r["id"] for r in evidence.pareto(df, {"qe": "min", "stability": "max"}, "id").collect()) == ["a", "b", "c", "e"]
    with pytest.raises(ValueError):
        evidence.pareto(df.union(spark.createDataFrame([("f", None, 1.0)], df.schema)), {"qe": "min"}, "id")


def test_gate_has_three_values(spark):
    with pytest.raises(ValueError):
        evidence.Gate()
    with pytest.raises(ValueError):
        evidence.Gate(min_median_ari=2)
    gate = evidence.Gate(min_median_ari=0.5)
    rows = spark.createDataFrame([("yes", 0.9, True), ("no", 0.1, True), ("unknown", None, True), ("partial", 0.9, False)], "case_id string, median_ari double, partitions_complete boolean").withColumn("consensus_complete", F.lit(True))
    got = {r["case_id"]: r["status"] for r in evidence.assess(rows, gate)[1].collect()}
    assert got == {"yes": "supported", "no": "abstain", "unknown": "uncertain", "partial": "abstain"}
    only = evidence.Gate(max_topographic_error=0.5)
    one = rows.where("case_id = 'yes'").withColumn("median_topographic_error", F.lit(0.1))
    assert evidence.assess(one, only)[1].first()["status"] == "uncertain"
    assert evidence.assess(one, None)[1].first()["status"] == "not_assessed"


def _labels(spark, fits, k=2):
    rows = [(f, k, f"s{i:03d}", x) for f, xs in fits.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "fit_id string, k int, sample_id string, label int")


def test_propagation_order_and_failure():
    ref, valid = [1, 1, 1, 1, 2, 2, None, None], [1, 1, 1, 1, 2, 2, 1, 2]
    other = [1, 2, 1, 2, None, None, 1, 2]

    def tables_of(fits):
        out = {}
        names = sorted(fits)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                t = np.zeros((2, 2))
                for x, y in zip(fits[a], fits[b], strict=True):
                    if x and y:
                        t[x - 1, y - 1] += 1
                out[a, b] = t
        return out

    fits = {"reference": ref, "valid": valid, "zinvalid": other}
    maps, notes = consensus.propagate(tables_of(fits), sorted(fits), 2, "reference")
    assert [n["fit_id"] for n in notes] == ["valid", "zinvalid"]
    assert [n["n_joint"] for n in notes] == [6, 10] and notes[1]["parents"] == "reference;valid"
    assert maps["valid"] == [1, 2]
    with pytest.raises(consensus.ConsensusError):
        consensus.propagate(tables_of({"a": [1, 1, None, None], "b": [1, 1, 2, 2]}), ["a", "b"], 2, "a")


def test_consensus_partial_replication(spark):
    a = [1 + i % 2 if i < 40 else None for i in range(60)]
    b = [2 - i % 2 if i >= 20 else None for i in range(60)]
    c = consensus.consensus(_labels(spark, {"a": a, "b": b}), 2)
    cover = c.coverage.first()
    assert cover["assignment_coverage"] == 1 and cover["replicated_coverage"] == pytest.approx(1 / 3)
    assert c.method == "aligned_vote"
    assert c.samples.where("support is not null").count() == 20
    assert c.jaccard.agg(F.min("jaccard")).first()[0] == 1.0
    with pytest.raises(consensus.ConsensusError):
        consensus.consensus(_labels(spark, {"a": [1 + i % 2 if i < 30 else None for i in range(60)], "b": [1 + i % 2 if i >= 30 else None for i in range(60)]}), 2)


def test_consensus_dispatch(spark):
    own = _labels(spark, {"a": [1, 2] * 5, "b": [2, 1] * 5})
    assert consensus.consensus(own, 2, max_coassignment=10).method == "coassignment"
    assert consensus.consensus(own, 2, max_coassignment=9).method == "aligned_vote"
    with pytest.raises(consensus.ConsensusError):
        consensus.consensus(own, 2, method="coassignment", max_coassignment=9)
    with pytest.raises(consensus.ConsensusError):
        consensus.consensus(_labels(spark, {"a": [1, 1], "b": [1, 2]}), 2)


def test_pairwise_budget(spark):
    own = _labels(spark, {f: [1, 2, 1] for f in "abcd"})
    assert partition.pairwise_agreement(own, 3, 6).count() == 6
    with pytest.raises(spec.BudgetError):
        partition.pairwise_agreement(own, 3, 5)


def test_external_label_states(spark):
    samples = spark.createDataFrame([(f"s{i}", None if i == 3 else 1 + i % 2, 1 if i == 4 else 3) for i in range(10)], "sample_id string, consensus int, n_assignments int")
    labels = spark.createDataFrame([(f"s{i}", None if i == 1 else "x" if i == 2 else "abc"[i % 3]) for i in range(1, 10)], "sample_id string, label string")
    out = evidence.external_assessment(samples, labels, ("x",))
    counts = {r["status"]: r["n"] for r in out["omissions"].collect()}
    assert counts == {**dict.fromkeys(evidence.STATUSES[:5], 1), "used": 5}
    with pytest.raises(ValueError):
        evidence.check_labels(samples, labels.union(spark.createDataFrame([("none", "a")], labels.schema)))


def test_membership_jaccard_case(spark):
    rows = [("a", 2, str(i), x, 2) for i, x in enumerate((1, 1, 2, 2))] + [("b", 2, str(i), x, 2) for i, x in enumerate((2, 1, 1, 1))]
    got = sensitivity.membership_jaccard(spark.createDataFrame(rows, "scenario string, k int, sample_id string, label int, n_assignments int"))
    r = {x["sample_id"]: (x["shared_jaccard"], x["intersection"], x["union"]) for x in got.collect()}
    assert [round(r[str(i)][0], 4) for i in range(4)] == [0.5, 0.25, 0.6667, 0.6667]
    assert [r[str(i)][1:] for i in range(4)] == [(1, 2), (1, 4), (2, 3), (2, 3)]
    rows = [("a", 2, str(i), x, 2) for i, x in enumerate((1, 1, 2, 2))] + [("b", 2, str(i), x, 2) for i, x in enumerate((2, 2, 1))]
    got = sensitivity.membership_jaccard(spark.createDataFrame(rows, "scenario string, k int, sample_id string, label int, n_assignments int")).orderBy("sample_id").collect()
    assert [x["shared_jaccard"] for x in got] == [1, 1, 1] and [x["all_members_jaccard"] for x in got] == [1, 1, 0.5]


def test_representation_against_brute_force(spark):
    r = np.random.default_rng(4)
    from reprolens.functions import grid

    h = grid.hops(3, 2, "rectangular")
    ua, ub = r.integers(1, 7, 40), r.integers(1, 7, 40)
    cells = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ua, ub, strict=True)], "ua int, ub int").groupBy("ua", "ub").agg(F.count(F.lit(1)).alias("n")).toPandas()
    x, y, n = representation.hop_histogram(cells, h, h)
    pairs = [(h[ua[i] - 1, ua[j] - 1], h[ub[i] - 1, ub[j] - 1]) for i in range(40) for j in range(i)]
    assert n.sum() == len(pairs)

    def ranks(v):
        v = np.asarray(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    a, b = (ranks(c) for c in zip(*pairs, strict=True))
    assert representation.weighted_spearman(x, y, n) == pytest.approx(np.corrcoef(a, b)[0, 1])
    got = []
    for i in range(40):
        near = []
        for u in (ua, ub):
            d = np.array([h[u[i] - 1, u[j] - 1] for j in range(40) if j != i])
            others = [j for j in range(40) if j != i]
            near.append({j for j, v in zip(others, d, strict=True) if v <= np.sort(d)[4]})
        got.append(len(near[0] & near[1]) / len(near[0] | near[1]))
    assert representation.neighbour_jaccard(cells, h, h, 5) == pytest.approx(np.median(got))
    assert representation.weighted_spearman(np.array([1, 1]), np.array([1, 2]), np.array([1.0, 1.0])) is None


def test_ensemble_failures_are_rows(spark):
    df = spark.createDataFrame([(str(i), float(i % 5), -1.0 if i == 0 else float(i)) for i in range(30)], "id string, a double, b double")
    data = dataset.make_dataset(df, columns=["a", "b"], id_col="id")
    e = train.fit_ensemble(data, spec.Spec(grids=((3, 2),), seeds=(1, 2), steps=5, k=(2,)), resample.full(data.df), preprocess.Preprocess("log1p"))
    assert e.failures.count() == 2 and e.expected == 2
    good = train.fit_ensemble(data, spec.Spec(grids=((3, 2),), seeds=(1,), steps=5, k=(2,)), resample.full(data.df))
    assert good.failures.count() == 0 and good.mapping.where("bmu is not null").count() == 30
    with pytest.raises(ValueError):
        train.fit_ensemble(data, spec.Spec(grids=((3, 2),), seeds=(1,), k=(2,)), resample.full(data.df), max_bytes=10)


def test_contract_upgrades(spark, tmp_path):
    old = contracts.Manifest("transfer", "1.0.0", ("metrics",), {})
    new = contracts.upgrade(old)
    assert new.version == contracts.VERSION and contracts.upgrade(new) == new and new.settings["scope"] == "analysis"
    for bad in (contracts.Manifest("transfer", "9.0.0", ("metrics",)), contracts.Manifest("transfer", "1.0.0", ()), contracts.Manifest("none")):
        with pytest.raises(contracts.ContractError):
            contracts.upgrade(bad)
    t = spark.range(5)
    contracts.save(str(tmp_path / "x"), "transfer", {"metrics": t}, {"a": 1})
    m, got = contracts.load(spark, str(tmp_path / "x"))
    assert m.settings == {"a": 1} and contracts.table_digest(got["metrics"]) == contracts.table_digest(t)


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_csv(tables.template(spark), path)
    assert tables.read_csv(spark, path).count() == 12
    with pytest.raises(tables.SourceError) as e:
        tables.read_csv(spark, str(tmp_path / "secret-name"))
    assert "secret-name" not in str(e.value)
    assert tables.registry(spark, domain=["evolution"]).count() == 3
    text = tables.script({"path": "p", "predictors": ["a"], "grids": [(3, 2)], "seeds": [1], "steps": 5, "k": [2], "repeats": 2, "prop": 0.8, "seed": 1})
    compile(text, "script", "exec")


def test_simulation(spark):
    d = simulate.simulate(spark, "clusters", n=90, p=4, class_shares=(0.7, 0.2, 0.1), missing=0.3, n_domains=3).toPandas()
    assert d.class_label.value_counts().to_dict() == {1: 63, 2: 18, 3: 9}
    seen = d[[c for c in d if c.startswith("environment")]].notna()
    assert seen.sum(1).min() >= 2 and seen.sum(0).min() >= 1
    with pytest.raises(ValueError):
        simulate.simulate(spark, "none")


def test_streamed_mapping_equals_batch(spark, tmp_path):
    from reprolens.streaming import scoring

    rows = spark.createDataFrame([(str(i), float(i % 7)) for i in range(50)], "sample_id string, a double")
    rows.write.parquet(str(tmp_path / "in"))
    code = spark.createDataFrame([(1, 0.0), (2, 5.0)], "unit int, a double")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = scoring.write_mapped(scoring.map_stream(stream, code, ["a"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    batch = mapping.map_rows(rows, code, {"data": ("a",)})
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0


def test_reference_query_reads_its_tables(spark):
    from reprolens.plans import learned

    got = learned.reference_models(spark, "/root/testdata/sf0.001")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    sizes = {r["task_id"]: r["n"] for r in got.groupBy("task_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert set(sizes.values()) == {customers}


def test_labels_by_identifier_and_position(spark):
    samples = spark.createDataFrame([(f"sample_{i:05d}", 1 + i % 2, 3) for i in range(1, 7)], "sample_id string, consensus int, n_assignments int")
    by_place = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1, 7)], "position int, label string")
    got = evidence.external_assessment(samples, by_place)
    assert got["agreement"].first()["ari"] == 1.0
    by_id = spark.createDataFrame([("sample_00001", "a"), ("sample_00002", "b")], "sample_id string, label string")
    assert evidence.match_labels(samples, by_id).count() == 2
    for labels, match in ((by_id, "position"), (by_place, "id"), (by_place.limit(5), "auto"), (by_place.withColumn("position", F.lit(1)), "auto"), (by_place, "other")):
        with pytest.raises(ValueError):
            evidence.match_labels(samples, labels, match)
    named = samples.withColumn("sample_id", F.concat(F.lit("p"), "sample_id"))
    with pytest.raises(ValueError):
        evidence.match_labels(named, by_place)


def test_consensus_of_other_samples(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    evidence.check_consensus(rows.withColumn("n_assignments", F.lit(2)), rows)
    for bad in ([("a", 1)], [("a", 1), ("c", 1)], [("a", 1), ("b", -1)], [("a", 1), ("b", None)], [("a", 1), ("a", 1), ("b", 1)]):
        with pytest.raises(ValueError):
            evidence.check_consensus(spark.createDataFrame(bad, "sample_id string, n_assignments int"), rows)


def test_fronts_say_what_they_compare(spark):
    fits = spark.createDataFrame([("f1", "s1", 1.0, 2.0), ("f2", "s2", 2.0, 1.0), ("f3", "s2", 3.0, 3.0)], "fit_id string, split_id string, qe double, te double")
    one = spark.createDataFrame([(s, i, "analysis") for s in ("s1", "s2") for i in "ab"], "split_id string, sample_id string, role string")
    got = evidence.pareto_of_fits(fits, one, {"qe": "min", "te": "min"}).collect()
    assert {(r["fit_id"], r["comparison_scope"]) for r in got} == {("f1", "common_analysis_set"), ("f2", "common_analysis_set")}
    with pytest.warns(UserWarning):
        other = evidence.pareto_of_fits(fits, one.where("split_id = 's1' or sample_id = 'a'"), {"qe": "min", "te": "min"})
    assert {r["comparison_scope"] for r in other.collect()} == {"distinct_analysis_sets"}


def test_expected_mi_needs_no_table_of_rows(spark):
    """Log-factorials are an expression: nothing is joined or kept for each row."""
    import math

    from reprolens.functions import agreement

    got = spark.createDataFrame([(i,) for i in [*range(40), 10**4, 10**7, 10**10]], "i long").select("i", agreement.log_factorial(F.col("i")).alias("lf")).collect()
    assert all(r["lf"] == pytest.approx(math.lgamma(r["i"] + 1), rel=1e-14, abs=1e-14) for r in got)
    for table, block in (([[2, 5, 0], [1, 4, 9], [8, 0, 0]], 3), ([[7, 7], [7, 7]], 10_000), ([[40_000, 20_001], [9, 90_000]], 10_000)):
        t = np.array(table)
        rows = [(i, j, int(n)) for (i, j), n in np.ndenumerate(t) if n]
        emi = agreement.expected_mi(spark.createDataFrame(rows, "x int, y int, n long"), block)
        assert emi.first()["emi"] == pytest.approx(agreement.expected_mi_margins(t.sum(1), t.sum(0)), rel=1e-8)
        plan = emi._jdf.queryExecution().optimizedPlan().toString()
        assert "Range" not in plan and "Join Inner, (" not in plan
    assert agreement.expected_mi(spark.createDataFrame([], "x int, y int, n long")).first()["emi"] == 0


def test_ami_query_needs_no_table_of_rows(spark):
    from reprolens.plans import partitions

    plan = partitions.ami(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "Join Inner, (" not in plan
