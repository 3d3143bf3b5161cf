"""Resampling designs as tables of (split_id, sample_id, role).

Draws are orders by md5 of seed, repeat and identifier: the same in every engine and
at any parallelism. Ranks over many rows are found from a cut-off digest, not from one
sorted partition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DesignError(ValueError):
    """A design that the data cannot carry."""


def draw_key(seed: int, repeat: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), repeat.cast("string"), ident.cast("string")))


def _units(rows: DataFrame, unit: str, repeats: int, seed: int, size: int) -> DataFrame:
    """The first ``size`` units of each repeat in digest order, as (rep, unit).

    Each repeat is ranked in buckets of the digest's first digits, whose counts say
    how many of each are taken, so no task sorts a whole repeat."""
    spark = rows.sparkSession
    reps = spark.range(1, repeats + 1).select(F.col("id").cast("int").alias("rep"))
    keyed = rows.select(F.col(unit).cast("string").alias("unit")).distinct().crossJoin(F.broadcast(reps))
    keyed = keyed.withColumn("key", draw_key(seed, F.col("rep"), F.col("unit"))).withColumn("bucket", F.substring("key", 1, 3))
    counts = keyed.groupBy("rep", "bucket").agg(F.count(F.lit(1)).alias("c"))
    # 4,096 buckets per repeat at most
    before = F.sum("c").over(Window.partitionBy("rep").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size)
    ranked = keyed.join(F.broadcast(counts.select("rep", "bucket", "before")) if repeats <= 1000 else counts.select("rep", "bucket", "before"), ["rep", "bucket"])
    place = F.row_number().over(Window.partitionBy("rep", "bucket").orderBy("key", "unit")) + F.col("before")
    return ranked.withColumn("place", place).where(F.col("place") <= size).select("rep", "unit")


def full(df: DataFrame) -> DataFrame:
    return df.select(F.lit("full").alias("split_id"), F.col("sample_id").cast("string").alias("sample_id"), F.lit("analysis").alias("role"))


def _drawn(df: DataFrame, unit: str, repeats: int, size: int, seed: int, prefix: str) -> DataFrame:
    reps = df.sparkSession.range(1, repeats + 1).select(F.col("id").cast("int").alias("rep"))
    taken = _units(df, unit, repeats, seed, size).withColumn("role", F.lit("analysis"))
    all_rows = df.select(F.col("sample_id").cast("string").alias("sample_id"), F.col(unit).cast("string").alias("unit")).crossJoin(F.broadcast(reps))
    out = all_rows.join(taken, ["rep", "unit"], "left")
    return out.select(F.format_string(f"{prefix}_%03d", "rep").alias("split_id"), "sample_id", F.coalesce("role", F.lit("assessment")).alias("role"))


def subsample(df: DataFrame, repeats: int = 50, prop: float = 0.8, seed: int = 1) -> DataFrame:
    """Rows without replacement: max(2, floor(prop n)) in each repeat."""
    n = df.count()
    if not 0 < prop <= 1 or n < 2:
        raise DesignError("subsampling needs two rows and a share in (0, 1]")
    return _drawn(df, "sample_id", repeats, max(2, int(prop * n)), seed, "subsample")


def unit_subsample(df: DataFrame, unit: str, repeats: int = 50, prop: float = 0.8, seed: int = 1, prefix: str = "group") -> DataFrame:
    """Whole groups or blocks: max(1, floor(prop units)) of them in each repeat."""
    n = df.select(unit).distinct().count()
    if n < 2 or df.where(F.col(unit).isNull()).limit(1).count():
        raise DesignError("at least two units are needed and none may be missing")
    return _drawn(df, unit, repeats, max(1, int(prop * n)), seed, prefix)


def leave_domain_out(df: DataFrame, domain: str = "domain") -> DataFrame:
    """One split per domain, in order of name: its rows are the assessment."""
    found = [r[0] for r in df.select(F.col(domain).cast("string")).distinct().orderBy(domain).collect()]
    if len(found) < 2 or None in found:
        raise DesignError("at least two domains are needed and none may be missing")
    clean = lambda s: re.sub(r"[^A-Za-z0-9_.]", ".", s if re.match(r"[A-Za-z.]", s) else "X" + s)
    splits = df.sparkSession.createDataFrame([(f"leave_domain_{i:03d}_{clean(d)}", d) for i, d in enumerate(found, 1)], "split_id string, held_domain string")
    rows = df.select(F.col("sample_id").cast("string").alias("sample_id"), F.col(domain).cast("string").alias("_d"))
    role = F.when(F.col("_d") == F.col("held_domain"), "assessment").otherwise("analysis")
    return rows.crossJoin(F.broadcast(splits)).select("split_id", "sample_id", role.alias("role"), "held_domain")


def custom(df: DataFrame, splits: DataFrame) -> DataFrame:
    """User splits (split_id, sample_id[, role]); samples that a split does not name
    are its assessment unless it names some itself. No overlap, no empty analysis."""
    own = splits.select("split_id", F.col("sample_id").cast("string").alias("sample_id"), (F.col("role") if "role" in splits.columns else F.lit("analysis")).alias("role"))
    if own.groupBy("split_id", "sample_id").count().where("count > 1").limit(1).count():
        raise DesignError("a sample is in a split twice")
    state = own.groupBy("split_id").agg(F.sum((F.col("role") == "analysis").cast("int")).alias("a"), F.sum((F.col("role") == "assessment").cast("int")).alias("b"))
    if state.where("a = 0").limit(1).count():
        raise DesignError("a split has no analysis rows")
    open_splits = state.where("b = 0").select("split_id")
    rows = df.select(F.col("sample_id").cast("string").alias("sample_id"))
    if own.join(rows, "sample_id", "left_anti").limit(1).count():
        raise DesignError("a split names unknown samples")
    rest = rows.crossJoin(F.broadcast(open_splits)).join(own, ["split_id", "sample_id"], "left_anti").withColumn("role", F.lit("assessment"))
    return own.unionByName(rest.select("split_id", "sample_id", "role"))


def duplicate_analysis(splits: DataFrame) -> DataFrame:
    """``split_id, duplicate_of``: later splits whose analysis rows another has too.

    Sets are compared by sums and xors of two hashes and their size, so no split is
    collected into one row."""
    h, g = F.xxhash64("sample_id"), F.xxhash64("sample_id", F.lit("b"))
    keys = splits.where("role = 'analysis'").groupBy("split_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(g).alias("y"))
    first = keys.groupBy("n", "x", "y").agg(F.min("split_id").alias("duplicate_of"))
    return keys.join(first, ["n", "x", "y"]).where("split_id > duplicate_of").select("split_id", "duplicate_of")
