"""Evidence beside the partitions: transfer to held-out rows, external labels, Pareto
candidates, and gates that may abstain."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.agreement import contingency, pair_indices
from ..functions.stats import finite

# ---- transfer ----------------------------------------------------------------


def transfer_metrics(mapping: DataFrame) -> DataFrame:
    """Per fit with assessment rows: counts, coverages, median distances of both roles,
    their ratio (null unless the training median is positive) and the share of mapped
    assessment rows on units without analysis rows."""
    role = lambda r: F.col("role") == r
    seen = mapping.where("role = 'analysis' and bmu is not null").select("fit_id", "bmu", F.lit(1).alias("occupied")).distinct()
    m = mapping.join(seen, ["fit_id", "bmu"], "left")
    n = lambda c: F.sum(c.cast("int"))
    mid = lambda r: F.percentile(F.when(role(r), finite(F.col("distance"))), F.lit(0.5))
    mapped = F.col("bmu").isNotNull()
    out = m.groupBy("fit_id").agg(
        n(role("analysis")).alias("n_analysis"), n(role("assessment")).alias("n_assessment"),
        n(role("analysis") & mapped).alias("n_analysis_mapped"), n(role("assessment") & mapped).alias("n_assessment_mapped"),
        mid("analysis").alias("median_analysis"), mid("assessment").alias("median_assessment"),
        F.avg(F.when(role("assessment") & mapped, F.when(F.col("occupied").isNull(), 1.0).otherwise(0.0))).alias("unoccupied_rate"),
    ).where("n_assessment > 0")
    return out.withColumns({
        "assessment_coverage": F.col("n_assessment_mapped") / F.col("n_assessment"),
        "distance_ratio": F.when(F.col("median_analysis") > 0, F.col("median_assessment") / F.col("median_analysis")),
    })


def new_data_summary(records: DataFrame, training: DataFrame) -> DataFrame:
    """Per fit: new rows, mapped ones, median distance, ratio to the training median and
    the unoccupied share. ``records`` and ``training`` are mappings."""
    both = training.select("fit_id", F.lit("analysis").alias("role"), "bmu", "distance").unionByName(records.select("fit_id", F.lit("assessment").alias("role"), "bmu", "distance"))
    out = transfer_metrics(both)
    return out.select("fit_id", F.col("n_assessment").alias("n_new"), F.col("n_assessment_mapped").alias("n_mapped"), F.col("median_assessment").alias("median_distance"), "distance_ratio", "unoccupied_rate")


# ---- external labels ---------------------------------------------------------

STATUSES = ("label_id_absent", "external_label_missing", "external_label_excluded", "consensus_label_missing", "insufficient_consensus_replication", "used")


def label_status(samples: DataFrame, labels: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Each consensus sample (``sample_id, consensus, n_assignments``) with its label and
    the first reason, in order, for which it is not used."""
    named = labels.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("label").cast("string").alias("label"), F.lit(1).alias("_here"))
    both = samples.join(named, "sample_id", "left")
    status = (
        F.when(F.col("_here").isNull(), STATUSES[0]).when(F.col("label").isNull(), STATUSES[1])
        .when(F.col("label").isin(*exclude) if exclude else F.lit(False), STATUSES[2])
        .when(F.col("consensus").isNull(), STATUSES[3]).when(F.col("n_assignments") < 2, STATUSES[4]).otherwise(STATUSES[5])
    )
    return both.withColumn("status", status).drop("_here")


def check_labels(samples: DataFrame, labels: DataFrame) -> None:
    """Raise for blank or repeated label identifiers and for those of no sample."""
    ids = labels.select(F.col("sample_id").cast("string").alias("sample_id"))
    if ids.where("sample_id is null or trim(sample_id) = ''").limit(1).count():
        raise ValueError("blank label identifiers")
    if ids.groupBy("sample_id").count().where("count > 1").limit(1).count():
        raise ValueError("repeated label identifiers")
    if ids.join(samples.select("sample_id"), "sample_id", "left_anti").limit(1).count():
        raise ValueError("labels for unknown samples")


_POSITION = r"^sample_(\d+)$"


def match_labels(samples: DataFrame, labels: DataFrame, match: str = "auto") -> DataFrame:
    """``sample_id, label`` of external labels.

    ``id``: ``labels`` name their samples. ``position``: they have a ``position`` (from 1)
    instead, which generated sample identifiers hold; every position must occur once. ``auto``:
    by identifier where there is one, else by position where identifiers were generated.
    """
    if match not in ("auto", "id", "position"):
        raise ValueError("match is auto, id or position")
    named, placed = "sample_id" in labels.columns, "position" in labels.columns
    if match == "id" or (match == "auto" and named):
        if not named:
            raise ValueError("labels have no sample_id")
        return labels.select(F.col("sample_id").cast("string").alias("sample_id"), "label")
    if not placed:
        raise ValueError("labels have no position")
    number = F.regexp_extract("sample_id", _POSITION, 1)
    if samples.where(number == "").limit(1).count():
        raise ValueError("samples have identifiers of their own: match labels by these")
    own = samples.select(number.cast("long").alias("position"), "sample_id")
    given = labels.select(F.col("position").cast("long").alias("position"), "label")
    size = given.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("d")).first()
    if size["n"] != size["d"] or size["n"] != own.count() or given.join(own, "position", "left_anti").limit(1).count():
        raise ValueError("labels by position need one for every sample")
    return own.join(given, "position").select("sample_id", "label")


def check_consensus(samples: DataFrame, rows: DataFrame) -> None:
    """Raise unless a consensus (``sample_id, n_assignments``) has exactly the samples of
    ``rows``, each once, with whole numbers of assignments."""
    if samples.groupBy("sample_id").count().where("count > 1 or sample_id is null").limit(1).count():
        raise ValueError("the consensus repeats a sample or has one without identifier")
    ids = rows.select("sample_id")
    if samples.join(ids, "sample_id", "left_anti").limit(1).count() or ids.join(samples, "sample_id", "left_anti").limit(1).count():
        raise ValueError("the consensus is of other samples: compute it again")
    n = F.col("n_assignments")
    if samples.where(n.isNull() | (n < 0) | (n != F.floor(n))).limit(1).count():
        raise ValueError("the consensus has invalid numbers of assignments: compute it again")


def omissions(status: DataFrame) -> DataFrame:
    """``status, n`` of all reasons, zeros included."""
    every = status.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "ord int, status string")
    counts = status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "status", "left").select("ord", "status", F.coalesce("n", F.lit(0)).alias("n"))


def composition(status: DataFrame) -> DataFrame:
    """``cluster, label, n, within_cluster`` of used samples, empty cells included."""
    used = status.where("status = 'used'")
    cells = used.groupBy(F.col("consensus").alias("cluster"), "label").agg(F.count(F.lit(1)).alias("n"))
    # levels times clusters
    grid = used.select(F.col("consensus").alias("cluster")).distinct().crossJoin(used.select("label").distinct())
    filled = grid.join(cells, ["cluster", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = cells.groupBy("cluster").agg(F.sum("n").alias("t"))
    return filled.join(total, "cluster").select("cluster", "label", "n", (F.col("n") / F.col("t")).alias("within_cluster"))


def external_assessment(samples: DataFrame, labels: DataFrame, exclude: tuple[str, ...] = (), match: str = "auto") -> dict[str, DataFrame]:
    """Status of each sample, omission counts, composition and agreement indices; at
    least two used samples and two label levels are needed."""
    labels = match_labels(samples, labels, match)
    check_labels(samples, labels)
    status = label_status(samples, labels, exclude).persist()
    used = status.where("status = 'used'")
    size = used.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("levels")).first()
    if size["n"] < 2 or size["levels"] < 2:
        raise ValueError("fewer than two used samples or label levels")
    cells = contingency(used, "consensus", "label").withColumn("all", F.lit(1))
    return {"status": status, "omissions": omissions(status), "composition": composition(status), "agreement": pair_indices(cells, ("all",)).drop("all")}


# ---- candidates --------------------------------------------------------------


def pareto(df: DataFrame, metrics: dict[str, str], id_col: str) -> DataFrame:
    """Rows that no other is at least as good as in all metrics (``min`` or ``max``) and
    better in one. Ties stay; a metric that is not finite raises.

    Rows are first cut by the metrics' best row of each value of the first metric, so
    the comparison joins distinct metric combinations, not all rows.
    """
    sign = {c: (F.col(c) if d == "min" else -F.col(c)).cast("double") for c, d in metrics.items()}
    rows = df.withColumns({f"_m_{c}": e for c, e in sign.items()})
    names = [f"_m_{c}" for c in metrics]
    if rows.where(sum((F.when(finite(F.col(c)).isNull(), 1).otherwise(0) for c in names), F.lit(0)) > 0).limit(1).count():
        raise ValueError("metrics must be finite")
    first, *others = names
    points = rows.select(*names).distinct()
    if others:
        # of equal first metrics only the best in the last can survive against each other
        points = points.groupBy(*names[:-1]).agg(F.min(names[-1]).alias(names[-1]))
    else:
        points = points.agg(F.min(first).alias(first))
    q = points.select(*(F.col(c).alias(f"_q{c}") for c in names))
    weak, strict = F.lit(True), F.lit(False)
    for c in names:
        weak, strict = weak & (F.col(f"_q{c}") <= F.col(c)), strict | (F.col(f"_q{c}") < F.col(c))
    best = points.join(q, weak & strict, "left_anti")
    return rows.join(best, names, "left_semi").drop(*names)


def distinct_analysis_sets(splits: DataFrame) -> bool:
    """Whether the analysis rows of the splits (``split_id, sample_id, role``) differ: by the
    number and two order-free digests of each split's identifiers."""
    own = splits.where("role = 'analysis'").select("split_id", "sample_id").distinct()
    key = own.groupBy("split_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("sample_id").cast("long")).alias("s"), F.bit_xor(F.xxhash64("sample_id")).alias("x"))
    return key.select("n", "s", "x").distinct().limit(2).count() > 1


def pareto_of_fits(metrics: DataFrame, splits: DataFrame, directions: dict[str, str]) -> DataFrame:
    """The Pareto front of fits (``fit_id, split_id`` and metrics) with ``comparison_scope``.
    Fits on different analysis rows are not comparable: then a warning says that the front
    is exploratory and must not choose a configuration."""
    used = splits.join(metrics.select("split_id").distinct(), "split_id", "left_semi")
    apart = distinct_analysis_sets(used)
    if apart:
        warnings.warn("this front compares metrics of different analysis rows and must not choose a configuration", stacklevel=2)
    front = pareto(metrics, directions, "fit_id")
    return front.withColumn("comparison_scope", F.lit("distinct_analysis_sets" if apart else "common_analysis_set"))


# ---- gates -------------------------------------------------------------------


@dataclass(frozen=True)
class Gate:
    """Thresholds that an analyst sets; unset ones are not tested. At least one is needed."""

    max_topographic_error: float | None = None
    max_empty_unit_rate: float | None = None
    min_median_ari: float | None = None
    min_median_ami: float | None = None
    min_pairwise_coverage: float | None = None
    min_cluster_jaccard: float | None = None
    min_consensus_coverage: float | None = None
    min_replicated_coverage: float | None = None
    min_membership_support: float | None = None
    max_assignment_entropy: float | None = None
    min_cross_model_ari: float | None = None
    min_cross_model_methods: int | None = None
    min_success_rate: float | None = None

    def __post_init__(self):
        active = self.active()
        if not active:
            raise ValueError("a gate needs a threshold")
        for name, v in active.items():
            if name == "min_cross_model_methods":
                if not (isinstance(v, int) and v >= 1):
                    raise ValueError(f"{name} must be a whole number from 1")
            elif not 0 <= v <= 1:
                raise ValueError(f"{name} must be from 0 to 1")

    def active(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}


#: The evidence that each threshold is compared with, and whether it speaks of the
#: quality of the partition (fixed values).
EVIDENCE = {
    "max_topographic_error": ("median_topographic_error", False),
    "max_empty_unit_rate": ("median_empty_unit_rate", False),
    "min_median_ari": ("median_ari", True),
    "min_median_ami": ("median_ami", True),
    "min_pairwise_coverage": ("median_joint_coverage", False),
    "min_cluster_jaccard": ("min_cluster_jaccard", True),
    "min_consensus_coverage": ("consensus_coverage", False),
    "min_replicated_coverage": ("replicated_coverage", False),
    "min_membership_support": ("median_support", True),
    "max_assignment_entropy": ("median_entropy", True),
    "min_cross_model_ari": ("min_cross_model_ari", True),
    "min_cross_model_methods": ("n_cross_model_methods", False),
    "min_success_rate": ("success_rate", False),
}


def _value(evidence: DataFrame, name: str) -> Column:
    return finite(F.col(name)) if name in evidence.columns else F.lit(None).cast("double")


def gate_checks(evidence: DataFrame, gate: Gate | None) -> DataFrame:
    """``ord, check, value, threshold, passed`` for each row of evidence (one per case,
    column ``case_id``): the structural checks first, then the active thresholds.

    ``passed`` is null where the evidence is missing. The checks that evidence is
    available and that a quality rule is set are true or null, never false.
    """
    active = gate.active() if gate else {}
    v = lambda n: _value(evidence, n)
    flag = lambda n: F.col(n).cast("boolean") if n in evidence.columns else F.lit(None).cast("boolean")
    comparative = (
        v("median_ari").isNotNull() | v("median_ami").isNotNull() | v("min_cluster_jaccard").isNotNull() | v("min_cross_model_ari").isNotNull()
        | ((v("replicated_coverage") > 0) & v("median_support").isNotNull() & v("median_entropy").isNotNull())
    )
    quality = any(EVIDENCE[n][1] for n in active)
    none = F.lit(None).cast("double")
    row = lambda i, name, value, threshold, passed: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("check"), value.alias("value"), threshold.alias("threshold"), passed.alias("passed"))
    yes_or_null = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit(True))
    checks = [
        row(1, "all_cross_model_fits_succeeded", none, none, flag("cross_models_succeeded")),
        row(2, "consensus_observes_k", none, none, flag("consensus_complete")),
        row(3, "comparative_partition_evidence_available", none, none, yes_or_null(comparative)),
        row(4, "partition_quality_requirement_specified", none, none, yes_or_null(F.lit(quality))),
        row(5, "all_partitions_observe_k", none, none, flag("partitions_complete")),
    ]
    for i, (name, limit) in enumerate(active.items(), 6):
        value = v(EVIDENCE[name][0])
        passed = value <= float(limit) if name.startswith("max_") else value >= float(limit)
        checks.append(row(i, name, value, F.lit(float(limit)), passed))
    has_cross = F.col("has_cross_models").cast("boolean") if "has_cross_models" in evidence.columns else F.lit(False)
    out = evidence.select("case_id", has_cross.alias("_cross"), F.explode(F.array(*checks)).alias("c")).where("c.ord > 1 or _cross")
    return out.select("case_id", "c.ord", "c.check", "c.value", "c.threshold", "c.passed")


def gate_status(checks: DataFrame) -> DataFrame:
    """``case_id, status``: abstain if any check failed, uncertain if any is unknown, else
    supported."""
    out = checks.groupBy("case_id").agg(F.max((~F.col("passed")).cast("int")).alias("failed"), F.max(F.col("passed").isNull().cast("int")).alias("unknown"))
    status = F.when(F.col("failed") == 1, "abstain").when(F.col("unknown") == 1, "uncertain").otherwise("supported")
    return out.select("case_id", status.alias("status"))


def assess(evidence: DataFrame, gate: Gate | None) -> tuple[DataFrame, DataFrame]:
    """Checks and decision; without a gate the decision is ``not_assessed``."""
    checks = gate_checks(evidence, gate)
    if gate is None:
        return checks, evidence.select("case_id", F.lit("not_assessed").alias("status"))
    return checks, gate_status(checks)
