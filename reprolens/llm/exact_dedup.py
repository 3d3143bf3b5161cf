"""Exact dedup by content sort (DataFrame operators only).

Sampled splitters range-partition the whole texts (``repartitionByRange``), each
partition is sorted externally so that equal texts lie next to each other, and
the window compares neighbouring texts in full. A text so frequent that its
group would overfill one partition is aggregated map-side instead of sorted:
there are at most ``hot_groups`` of those, so their totals can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import text_or_empty

#: A text is hot when it covers more than one in so many rows.
HOT_GROUPS = 2000
#: Splitters are sampled from so many first characters and the text's hash, so the
#: sample that the driver sorts stays small however long the texts are, and texts with
#: a common beginning are still split.
SPLITTER = 32


def _hot_hashes(rows: DataFrame, hot_groups: int) -> list[int]:
    """Hashes of texts above 1/hot_groups of all rows: at most hot_groups of them."""
    total = rows.count()
    least = max(2, total // hot_groups + 1)
    counts = rows.groupBy("_h").count().where(F.col("count") >= least)
    return [r[0] for r in counts.select("_h").limit(hot_groups).collect()]


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=None,
    keep: str = "min",
    hot_groups: int = HOT_GROUPS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``normalise`` maps the text column to the compared form (default: no change);
    ``keep`` is ``min`` or ``max``: which identifier of a group stays. ``carry``
    names further input columns to return as they are.

    Null text counts as empty. Rows that repeat both identifier and text share
    ``kept``. Null identifiers never win unless the whole group has none (then
    ``keep_id`` is null and ``kept`` true). An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    best = {"min": F.min, "max": F.max}[keep]
    norm: Column = text_or_empty(text_col) if normalise is None else normalise(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_t"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    rows = rows.withColumn("_h", F.xxhash64("_t"))
    hot = _hot_hashes(rows.select("_h"), hot_groups)
    is_hot = F.col("_h").isin(hot) if hot else F.lit(False)

    # Equal texts have equal keys, so a range boundary never separates them and
    # the window below, whose keys include those of the ranges, needs no second exchange.
    near = Window.partitionBy("_p", "_h", "_t")
    cold = (
        rows.where(~is_hot)
        .withColumn("_p", F.left("_t", F.lit(SPLITTER)))
        .repartitionByRange("_p", "_h")
        .withColumn("keep_id", best("_id").over(near))
        .withColumn("group_size", F.count(F.lit(1)).over(near))
        .withColumn("text_sha256", F.sha2("_t", 256))
    )
    out = cold.drop("_t", "_h", "_p")
    if hot:
        warm = rows.where(is_hot).withColumn("text_sha256", F.sha2("_t", 256))
        totals = (
            warm.groupBy("_t", "text_sha256")
            .agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("text_sha256", "keep_id", "group_size")
        )
        # at most hot_groups rows of about 100 bytes
        out = out.unionByName(warm.drop("_t", "_h").join(F.broadcast(totals), "text_sha256"))
    return out.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        *(F.col(f"_c_{c}").alias(c) for c in carry),
    )


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=None,
    keep: str = "min",
    hot_groups: int = HOT_GROUPS,
) -> DataFrame:
    """``docs`` with exactly one row for each text, its columns unchanged.

    The same sort as ``exact_groups``; rows that repeat identifier and text leave
    one row. Null text counts as empty for the comparison and is returned as it was. Of
    null identifiers one stays only where its text has no other. Further columns may have
    any name. An empty table gives an empty result.
    """
    best = {"min": F.min, "max": F.max}[keep]
    first = F.col("_r.0").asc_nulls_last() if keep == "min" else F.col("_r.0").desc_nulls_last()
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own, text = F.col(f"c{names.index(id_col)}"), f"c{names.index(text_col)}"
    norm = text_or_empty(text) if normalise is None else normalise(text_or_empty(text))
    packed = plain.select(
        norm.alias("_t"),
        F.struct(own.alias("0"), *(F.col(f"c{i}").alias(str(i + 1)) for i, c in enumerate(names) if c != text_col)).alias("_r"),
        F.col(text).isNull().alias("_null"),
        *([F.col(text).alias("_raw")] if normalise is not None else []),
    ).withColumn("_h", F.xxhash64("_t"))
    hot = _hot_hashes(packed.select("_h"), hot_groups)
    is_hot = F.col("_h").isin(hot) if hot else F.lit(False)
    cold = (
        packed.where(~is_hot)
        .withColumn("_p", F.left("_t", F.lit(SPLITTER)))
        .repartitionByRange("_p", "_h")
        .withColumn("_n", F.row_number().over(Window.partitionBy("_p", "_h", "_t").orderBy(first)))
        .where("_n = 1")
        .drop("_n", "_p")
    )
    out = cold
    if hot:
        warm = packed.where(is_hot)
        # the winner of a hot text is found by partial aggregation, then its row read
        win = warm.groupBy("_t").agg(best("_r.0").alias("_win")).select(F.sha2("_t", 256).alias("_s"), "_win")
        warm = warm.withColumn("_s", F.sha2("_t", 256)).join(F.broadcast(win), "_s")
        warm = warm.where(F.col("_r.0").eqNullSafe(F.col("_win"))).drop("_win").dropDuplicates(["_s"]).drop("_s")
        out = out.unionByName(warm)
    raw = F.col("_raw") if normalise is not None else F.when(~F.col("_null"), F.col("_t"))
    return out.select(*(raw.alias(c) if c == text_col else F.col(f"_r.{i + 1}").alias(c) for i, c in enumerate(names)))
