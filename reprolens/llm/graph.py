"""Connected components and joins on keys of which a few may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Rows of one join key that a task takes as they are (some 30 MB).
ONE_TASK = 1_000_000


def join_by_size(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int, most: int = 2000) -> DataFrame:
    """Inner join with ``right``, unique on ``on``, whose column ``size`` says how many
    rows of ``left`` have the key.

    Keys above 1/most of ``total`` rows (hence at most ``most`` of them) are
    broadcast, so their rows stay where they are; the others are shuffled.
    """
    least = max(2, total // most + 1)
    hot = F.broadcast(right.where(F.col(size) >= least))
    cold = right.where(F.col(size) < least)
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(cold, on))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's component, for edges (a, b).

    Each round a node takes the smallest label of a neighbour's label, gives it to the
    node that its own label names too (so whole trees are hooked), and follows its label
    one step. Rounds grow with the logarithm of the longest chain and go on until no
    label moves. Labels are aggregated map-side before each shuffle. A hub or the label of
    a large component may be a join key of as many rows as there are: beyond ``ONE_TASK``
    rows such keys are joined by size. A round's tables are deleted when the next one's stand.
    """
    own = Scratch(edges.sparkSession, "components")
    both = own.keep("both", edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct())
    # edges that end in a node are as many as those that begin there
    degree = own.keep("degree", both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"), F.count(F.lit(1)).alias("degree")))
    labels = degree.select("node", "label", "degree")
    ends, nodes = both.count(), degree.count()

    def meet(left: DataFrame, right: DataFrame, on: str, size: str, total: int) -> DataFrame:
        return join_by_size(left, right, [on], size, total) if total > ONE_TASK else left.join(right.drop(size), on)

    while True:
        sizes = labels.groupBy(F.col("label").alias("node")).agg(F.count(F.lit(1)).alias("size"))
        far = (labels.join(sizes, "node") if nodes > ONE_TASK else labels.withColumn("size", F.lit(0))).select(F.col("node").alias("label"), F.col("label").alias("far"), "size")
        step = own.keep("step", meet(labels, far, "label", "size", nodes).select("node", "label", "far", "degree"))
        near = meet(both, step.select(F.col("node").alias("other"), F.col("far").alias("near"), "degree"), "other", "degree", ends)
        near = near.groupBy("node").agg(F.min("near").alias("near"))
        near = step.join(near, "node").select("node", "label", "degree", F.least("far", "near").alias("new"))
        none = lambda c: F.lit(None).cast(step.schema[c].dataType).alias(c)
        offers = near.unionByName(near.select(F.col("label").alias("node"), none("label"), none("degree"), "new"))
        moved = own.keep("moved", offers.groupBy("node").agg(F.max("label").alias("label"), F.max("degree").alias("degree"), F.min("new").alias("next")))
        labels = moved.select("node", F.col("next").alias("label"), "degree")
        if not moved.where(F.col("next") < F.col("label")).limit(1).count():
            own.drop("both", "degree", "step")
            return labels.drop("degree")
