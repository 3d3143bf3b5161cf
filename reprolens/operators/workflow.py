"""The whole audit in one call, what it would cost before it runs, and the same over
several scenarios."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite
from . import consensus as cons
from . import cross, evidence, partition, representation, sensitivity
from .dataset import Dataset
from .preprocess import Preprocess
from .resample import duplicate_analysis
from .spec import Spec, check_pairs
from .train import Ensemble, fit_ensemble


@dataclass
class Workflow:
    """Every stream of evidence by itself; ``failures`` are rows of stage, key and error."""

    ensemble: Ensemble
    metrics: DataFrame
    labels: DataFrame
    pairwise: DataFrame
    stability: DataFrame
    completeness: DataFrame
    consensus: dict[int, cons.Consensus] = field(default_factory=dict)
    references: DataFrame | None = None
    comparison: DataFrame | None = None
    failures: list[tuple[str, str, str]] = field(default_factory=list)
    scope: str = "analysis"
    #: What each stream of evidence was derived from (see ``source_of``).
    sources: dict[tuple[str, int], tuple] = field(default_factory=dict)

    def consensus_summary(self, ks: list[int]) -> list[dict]:
        """A row per requested k: computed or failed, with the reason."""
        bad = {key: e for stage, key, e in self.failures if stage == "consensus"}
        out = []
        for k in ks:
            c = self.consensus.get(k)
            row = {"k": k, "status": "computed" if c else "failed", "error": bad.get(str(k)), "method": c.method if c else None}
            if c:
                row |= c.coverage.first().asDict()
            out.append(row)
        return out

    def diagnostics(self) -> list[dict]:
        """Failures and warnings by stage."""
        stages = ["fit", "partition", "consensus", "reference", "representation"]
        count = {s: sum(f[0] == s for f in self.failures) for s in stages}
        count["fit"] += self.ensemble.failures.count()
        return [{"stage": s, "failures": count[s], "warnings": self.ensemble.warnings.count() if s == "fit" else 0} for s in stages]

    def evidence(self, k: int) -> DataFrame:
        """One row of evidence for the gates at k; what could not be had is null."""
        spark = self.ensemble.fits.sparkSession
        n = self.ensemble.fits.where("error is null").count()
        row: dict = {"case_id": f"k{k}", "success_rate": n / self.ensemble.expected if self.ensemble.expected else None}
        mid = lambda c: F.percentile(finite(F.col(c)), F.lit(0.5))
        got = self.metrics.agg(mid("topographic_error").alias("t"), mid("empty_unit_rate").alias("e")).first()
        row |= {"median_topographic_error": got["t"], "median_empty_unit_rate": got["e"]}
        s = self.stability.where(F.col("k") == k).first()
        if s:
            row |= {"median_ari": s["median_ari"], "median_ami": s["median_ami"], "median_joint_coverage": s["median_joint_coverage"], "partitions_complete": s["n_complete"] == s["n_partitions"]}
        c = self.consensus.get(k)
        if c:
            cover = c.coverage.first()
            both = c.samples.agg(mid("support").alias("s"), mid("entropy").alias("e"), F.count_distinct("consensus").alias("n")).first()
            jac = c.clusters.agg(F.min("median_jaccard").alias("m"), F.count("median_jaccard").alias("n")).first()
            row |= {
                "consensus_coverage": cover["consensus_coverage"], "replicated_coverage": cover["replicated_coverage"], "median_support": both["s"],
                "median_entropy": both["e"], "consensus_complete": both["n"] == k, "min_cluster_jaccard": jac["m"] if jac["n"] == k else None,
            }
        if self.comparison is not None:
            m = cross.cross_summary(self.comparison.where(F.col("k") == k)).collect()
            medians = [r["median_ari"] for r in m]
            failed = self.references.where((F.col("k") == k) & F.col("error").isNotNull()).count()
            asked = self.references.where(F.col("k") == k).select("method").distinct().count()
            row |= {
                "has_cross_models": True, "cross_models_succeeded": failed == 0, "n_cross_model_methods": float(sum(x is not None for x in medians)),
                "min_cross_model_ari": min(medians) if medians and len(medians) == asked and None not in medians else None,
            }
        kinds = {"case_id": "string", "partitions_complete": "boolean", "consensus_complete": "boolean", "has_cross_models": "boolean", "cross_models_succeeded": "boolean"}
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in row))

    def check_provenance(self, k: int) -> None:
        """Raise unless all evidence at k is of the analysis scope and was derived from
        this ensemble's own labels."""
        if self.scope != "analysis":
            raise ProvenanceError("gates need evidence of the analysis scope")
        fits = {r["fit_id"] for r in self.ensemble.fits.where("error is null").select("fit_id").collect()}  # the model budget
        strange = [r["fit_id"] for r in self.labels.select("fit_id").distinct().collect() if r["fit_id"] not in fits]
        if strange:
            raise ProvenanceError(f"labels of other models: {', '.join(sorted(strange)[:3])}")
        own = source_of(self.labels, k)
        wanted = [("partitions", True), ("consensus", k in self.consensus), ("comparison", self.comparison is not None)]
        for stream, present in wanted:
            if present and (stream, k) not in self.sources:
                raise ProvenanceError(f"{stream} at k = {k} does not say what it was derived from")
            if present and self.sources[stream, k] != own:
                raise ProvenanceError(f"{stream} at k = {k} was derived from other partitions")

    def assess(self, k: int, gate: evidence.Gate | None = None) -> tuple[DataFrame, DataFrame]:
        self.check_provenance(k)
        return evidence.assess(self.evidence(k), gate)


class ProvenanceError(ValueError):
    """Streams of evidence that do not belong together."""


def source_of(labels: DataFrame, k: int) -> tuple:
    """Identity of the labels at k: their number and two order-free digests."""
    key = ("fit_id", "sample_id", "label")
    r = labels.where(F.col("k") == k).agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash(*key).cast("long")).alias("s"), F.bit_xor(F.xxhash64(*key)).alias("x")).first()
    return tuple(r)


def run_workflow(data: Dataset, spec: Spec, splits: DataFrame, pre: Preprocess | dict[str, Preprocess] | None = None, methods: tuple[str, ...] = (), scope: str = "analysis", max_pairs: int = 1_000_000, fail_fast: bool = False) -> Workflow:
    """Fit, measure, partition, compare, decide on a consensus for each k, and compare
    with reference methods. The pairwise budget is checked before any fit; a stage that
    fails at some k leaves a row unless ``fail_fast``."""
    n_splits = splits.select("split_id").distinct().count()
    check_pairs(n_splits * len(spec.grids) * len(spec.seeds), len(spec.k), max_pairs)
    ensemble = fit_ensemble(data, spec, splits, pre, fail_fast)
    if not ensemble.fits.where("error is null").limit(1).count():
        first = ensemble.failures.first()
        raise RuntimeError(f"no model could be fitted: {first['error'] if first else 'no task'}")
    units = partition.unit_labels(ensemble, list(spec.k))
    labels = partition.sample_labels(ensemble.mapping, units, scope).persist()
    pairs = partition.pairwise_agreement(labels, data.df.count(), max_pairs).persist()
    complete = partition.completeness(labels).persist()
    out = Workflow(ensemble, partition.fit_metrics(ensemble), labels, pairs, partition.stability_summary(pairs, complete), complete, scope=scope)
    for k in spec.k:
        source = source_of(labels, k)
        out.sources |= {("partitions", k): source, ("comparison", k): source}
        try:
            out.consensus[k] = cons.consensus(labels, k)
            out.sources["consensus", k] = source
        except ValueError as e:
            if fail_fast:
                raise
            out.failures.append(("consensus", str(k), str(e)))
    if methods:
        out.references = cross.fit_references(data, splits, list(spec.k), methods, pre, layer_weights=spec.layer_weights, normalize_layers=spec.normalize_layers)
        for r in out.references.where("error is not null").select("task_id", "error").collect():  # a row per failed task
            out.failures.append(("reference", r["task_id"], r["error"]))
        every = ensemble.mapping.join(units.withColumnRenamed("unit", "bmu"), ["fit_id", "bmu"])
        out.comparison = cross.compare_references(every, out.references, "analysis").persist()
    return out


def preflight(data: Dataset, spec: Spec, splits: DataFrame, max_pairs: int = 1_000_000, methods: tuple[str, ...] = ()) -> DataFrame:
    """``split_id, n_analysis, n_complete, models, eligible_models, references_eligible``:
    what would run, from counts alone."""
    names = data.variables
    whole = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0)) == len(names)
    rows = data.df.select("sample_id", whole.alias("whole"))
    counts = splits.where("role = 'analysis'").join(rows, "sample_id").groupBy("split_id").agg(F.count(F.lit(1)).alias("n_analysis"), F.sum(F.col("whole").cast("int")).alias("n_complete"))
    fits = sum((F.when(F.col("n_analysis") >= x * y, len(spec.seeds)).otherwise(0) for x, y in spec.grids), F.lit(0))
    ok = (F.col("n_complete") == F.col("n_analysis")) & (F.col("n_analysis") > max(spec.k))
    return counts.select("split_id", "n_analysis", "n_complete", F.lit(len(spec.grids) * len(spec.seeds)).alias("models"), fits.alias("eligible_models"), (ok & F.lit(bool(methods))).alias("references_eligible"))


def verdict(data: Dataset, spec: Spec, splits: DataFrame, max_pairs: int = 1_000_000, methods: tuple[str, ...] = ()) -> str:
    """The first reason not to run as asked, or ``ok``."""
    table = preflight(data, spec, splits, max_pairs, methods)
    got = table.agg(F.sum("eligible_models").alias("fits"), F.max(F.col("references_eligible").cast("int")).alias("refs")).first()
    n = got["fits"] or 0
    if not n:
        return "no_feasible_fit"
    if n * (n - 1) // 2 * len(spec.k) > max_pairs:
        return "pairwise_budget"
    if duplicate_analysis(splits).limit(1).count():
        return "duplicate_splits"
    if methods and not got["refs"]:
        return "no_reference_split"
    return "ok"


def run_sensitivity(scenarios: dict[str, dict], fail_fast: bool = False) -> dict:
    """``run_workflow`` for each scenario's arguments, then contrasts of their consensus
    by sample. A scenario that fails is a row, and so are its contrasts."""
    done: dict[str, Workflow] = {}
    failed: list[tuple[str, str]] = []
    for name, arguments in scenarios.items():
        try:
            done[name] = run_workflow(**arguments)
        except Exception as e:
            if fail_fast:
                raise
            failed.append((name, str(e)))
    tables = {}
    for name, w in done.items():
        for k, c in w.consensus.items():
            t = c.samples.select(F.lit(k).alias("k"), "sample_id", F.col("consensus").alias("label"), "n_assignments")
            tables[name] = tables[name].unionByName(t) if name in tables else t
    out = {"workflows": done, "failures": failed, "contrasts": None, "samples": None, "summary": None}
    if tables:
        labels = sensitivity.flatten(tables).persist()
        generated = tuple(n for n, w in done.items() if w.ensemble.data.id_source == "generated")
        out["contrasts"] = sensitivity.scenario_contrasts(labels, list(scenarios), tuple(n for n, _ in failed), generated)
        usable = labels.where("n_assignments >= 2")
        usable = usable.where(~F.col("scenario").isin(*generated)) if generated else usable
        out["samples"] = sensitivity.membership_jaccard(usable)
        names = len(scenarios)
        out["summary"] = sensitivity.sample_summary(out["samples"], names * (names - 1) // 2)
    return out


def audit_maps(w: Workflow, q: int = 10, max_pairs: int = 10_000, pairs: DataFrame | None = None) -> DataFrame:
    """Do the successful fits represent the analysis rows alike? All pairs of fits, or those
    requested (``fit_a, fit_b``, each once), within budget. Pairs say too whether they
    share split and grid."""
    fits = w.ensemble.fits.where("error is null").select("fit_id", "split_id", "grid_id", "xdim", "ydim")
    if pairs is None:
        pairs = fits.select(F.col("fit_id").alias("fit_a")).crossJoin(fits.select(F.col("fit_id").alias("fit_b"))).where("fit_a < fit_b")  # fits are the budget
    else:
        pairs = representation.requested_pairs(pairs)
    representation.check_fits(fits, pairs)
    m = w.ensemble.mapping.where("role = 'analysis'")
    got = representation.compare_maps(m, fits, pairs, q, w.ensemble.spec.topology, w.ensemble.spec.toroidal, max_pairs)
    return representation.with_design(got, fits)
