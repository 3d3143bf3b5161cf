"""How conclusions change between analysis scenarios, matched by sample identifier.

Scenario labels are a long table: scenario, k, sample_id, label, n_assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agreement import pair_indices
from ..functions.stats import finite, quantile8


def scenario_contrasts(labels: DataFrame, scenarios: list[str] | None = None, failed: tuple[str, ...] = (), generated_ids: tuple[str, ...] = ()) -> DataFrame:
    """Per pair of scenarios and common k: samples shared, those replicated in both,
    those joint, agreement and a status.

    A pair that cannot be compared is a row too: a failed scenario, no k in common,
    unstable generated identifiers, no shared samples or too few joint assignments.
    """
    spark = labels.sparkSession
    names = scenarios or sorted(r[0] for r in labels.select("scenario").distinct().collect())
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], "a string, b string")
    ks = labels.select("scenario", "k").distinct()
    common = pairs.join(ks.toDF("a", "k"), "a").join(ks.toDF("b", "k"), ["b", "k"]).select("a", "b", "k")
    left = labels.select(F.col("scenario").alias("a"), "k", "sample_id", F.col("label").alias("x"), F.col("n_assignments").alias("na"))
    right = labels.select(F.col("scenario").alias("b"), "k", "sample_id", F.col("label").alias("y"), F.col("n_assignments").alias("nb"))
    both = common.join(left, ["a", "k"]).join(right, ["b", "k", "sample_id"])
    replicated = (F.col("na") >= 2) & (F.col("nb") >= 2)
    joint = replicated & F.col("x").isNotNull() & F.col("y").isNotNull()
    counts = both.groupBy("a", "b", "k").agg(F.count(F.lit(1)).alias("n_shared"), F.sum(replicated.cast("int")).alias("n_replicated"))
    cells = both.where(joint).groupBy("a", "b", "k", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    found = pair_indices(cells, ("a", "b", "k"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = pairs.join(common, ["a", "b"], "left").join(counts, ["a", "b", "k"], "left").join(found, ["a", "b", "k"], "left")
    out = out.select("a", "b", "k", zero("n_shared"), zero("n_replicated"), zero("n_joint"), "ari", "ami")
    is_in = lambda c, values: F.col(c).isin(*values) if values else F.lit(False)
    fa, fb = is_in("a", failed), is_in("b", failed)
    status = (
        F.when(fa & fb, "scenario_failed_both").when(fa, "scenario_failed_a").when(fb, "scenario_failed_b")
        .when(F.col("k").isNull(), "no_common_k")
        .when(is_in("a", generated_ids) | is_in("b", generated_ids), "unstable_generated_ids")
        .when(F.col("n_shared") == 0, "no_shared_samples").when(F.col("n_joint") < 2, "insufficient_joint_assignments").otherwise("evaluated")
    )
    keep = status == "evaluated"
    return out.withColumn("comparison_status", status).withColumns({"ari": F.when(keep, F.col("ari")), "ami": F.when(keep, F.col("ami"))})


def membership_jaccard(labels: DataFrame) -> DataFrame:
    """``a, b, k, sample_id`` and the Jaccard of the sample's cluster companions in two
    scenarios, over shared samples and over all members.

    Four counts by cluster and pair of clusters; companions are never listed. Renaming
    the labels changes nothing.
    """
    rows = labels.where("label is not null")
    size = rows.groupBy("scenario", "k", "label").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(size, ["scenario", "k", "label"])
    left = rows.select(F.col("scenario").alias("a"), "k", "sample_id", F.col("label").alias("x"), F.col("size").alias("sx"))
    right = rows.select(F.col("scenario").alias("b"), "k", "sample_id", F.col("label").alias("y"), F.col("size").alias("sy"))
    both = left.join(right, ["k", "sample_id"]).where("a < b")
    pair, own_x, own_y = (Window.partitionBy("a", "b", "k", *c) for c in (("x", "y"), ("x",), ("y",)))
    n = F.count(F.lit(1))
    cell = both.groupBy("a", "b", "k", "x", "y", "sx", "sy").agg(n.alias("same"))
    cell = cell.withColumns({"cx": F.sum("same").over(own_x), "cy": F.sum("same").over(own_y), "same": F.max("same").over(pair)})
    cell = cell.withColumns({
        "intersection": F.col("same"),
        "union": F.col("cx") + F.col("cy") - F.col("same"),
        "shared_jaccard": F.col("same") / (F.col("cx") + F.col("cy") - F.col("same")),
        "all_members_jaccard": F.col("same") / (F.col("sx") + F.col("sy") - F.col("same")),
    })
    keep = ["a", "b", "k", "x", "y", "intersection", "union", "shared_jaccard", "all_members_jaccard"]
    return both.join(cell.select(*keep), ["a", "b", "k", "x", "y"]).select("a", "b", "k", "sample_id", *keep[5:])


def sample_summary(jaccard: DataFrame, planned: int) -> DataFrame:
    """Per k and sample: contrasts, their share of the planned ones, median, lowest and
    type-8 interval of the shared Jaccards."""
    j = F.col("shared_jaccard")
    return jaccard.groupBy("k", "sample_id").agg(
        F.count(F.lit(1)).alias("n_contrasts"), (F.count(F.lit(1)) / F.lit(planned)).alias("contrast_coverage"),
        F.percentile(finite(j), F.lit(0.5)).alias("median_jaccard"), F.min(j).alias("min_jaccard"),
        quantile8(j, 0.025).alias("low"), quantile8(j, 0.975).alias("high"),
    )


def flatten(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of scenarios in one, with their name."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("scenario", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out
