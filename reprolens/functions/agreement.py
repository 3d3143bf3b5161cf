"""Agreement of two labelings from their contingency table: adjusted Rand index,
entropies, (expected) mutual information and adjusted mutual information.

Contingency counts come from one grouped aggregation; the indices are SQL over the
cells. Expected mutual information needs log-factorials, which Spark has no function
for: they are an expression (Stirling's series), so nothing grows with the number of
rows but the overlaps that are summed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import choose2

_EPS = 2.220446049250313e-16


def contingency(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, x, y, n over rows where both labels are present."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _margins(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Cells with their row sum, column sum and total."""
    a, b, t = Window.partitionBy(*by, "x"), Window.partitionBy(*by, "y"), Window.partitionBy(*by)
    if not by:
        # a constant key: the table of cells is small, the rows were aggregated before
        cells, t = cells.withColumn("_all", F.lit(1)), Window.partitionBy("_all")
        out = cells.withColumn("a", F.sum("n").over(a)).withColumn("b", F.sum("n").over(b)).withColumn("total", F.sum("n").over(t))
        return out.drop("_all")
    return cells.withColumn("a", F.sum("n").over(a)).withColumn("b", F.sum("n").over(b)).withColumn("total", F.sum("n").over(t))


def _bijection() -> Column:
    """Every occupied row and column of the table has exactly one occupied cell."""
    return (F.count(F.lit(1)) == F.countDistinct("x")) & (F.count(F.lit(1)) == F.countDistinct("y"))


def ari(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, n, ari (null for fewer than two rows; not clamped). A vanishing
    denominator gives 1 for tables that are a bijection, else 0."""
    m = _margins(cells, by)
    rows = m.groupBy(*by, "x").agg(F.first("a").alias("a")).groupBy(*by).agg(F.sum(choose2(F.col("a"))).alias("sa"))
    cols = m.groupBy(*by, "y").agg(F.first("b").alias("b")).groupBy(*by).agg(F.sum(choose2(F.col("b"))).alias("sb"))
    base = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(choose2(F.col("n"))).alias("sij"), _bijection().alias("same"))
    if by:
        j = base.join(rows, list(by)).join(cols, list(by))
    else:
        j = base.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("sa") * F.col("sb") / F.nullif(choose2(F.col("n")), F.lit(0.0))
    bottom = 0.5 * (F.col("sa") + F.col("sb")) - F.col("_e")
    j = j.withColumn("_e", expected)
    value = F.when(F.abs(bottom) < _EPS, F.when(F.col("same"), 1.0).otherwise(0.0)).otherwise((F.col("sij") - F.col("_e")) / bottom)
    return j.select(*by, "n", F.when(F.col("n") >= 2, value).alias("ari"))


def entropy(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, n, entropy (natural logarithm) of a label."""
    c = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("c"))
    t = c.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln(F.col("c").cast("double"))).alias("s"))
    return t.select(*by, "n", (F.ln(F.col("n").cast("double")) - F.col("s") / F.col("n")).alias("entropy"))


def mutual_information(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, n, mi, hx, hy from the cells."""
    m = _margins(cells, by)
    p = F.col("n") / F.col("total")
    mi = F.sum(p * F.ln(F.col("n").cast("double") * F.col("total") / (F.col("a").cast("double") * F.col("b"))))
    # each row's share of -p ln p spread over its cells
    hx = F.sum(-p * F.ln(F.col("a") / F.col("total")))
    hy = F.sum(-p * F.ln(F.col("b") / F.col("total")))
    return m.groupBy(*by).agg(F.sum("n").alias("n"), mi.alias("mi"), hx.alias("hx"), hy.alias("hy"))


def log_factorial(i: Column) -> Column:
    """ln(i!) of a whole number from 0: of exact products below 32, Stirling's series from
    there (its next term is below 1e-13)."""
    small = F.array(*(F.lit(math.log(math.factorial(x))) for x in range(32)))
    x = i.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return F.when(i < 32, F.get(small, i.cast("int"))).otherwise(series)


def expected_mi_margins(a: np.ndarray, b: np.ndarray) -> float:
    """Expected mutual information of tables with these margins (hypergeometric)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = a.sum()
    if n < 2:
        return 0.0
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(n) + 1)))])
    total = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - int(n)), min(x, y) + 1)
            if len(k):
                log_p = lf[x] + lf[y] + lf[int(n) - x] + lf[int(n) - y] - lf[int(n)] - lf[k] - lf[x - k] - lf[y - k] - lf[int(n) - x - y + k]
                total += float((k / n * np.log(n * k / (x * float(y))) * np.exp(log_p)).sum())
    return total


def expected_mi(cells: DataFrame, block: int = 10_000) -> DataFrame:
    """One row, emi: the sum over pairs of margins and possible overlaps, in SQL. Overlaps
    are dealt to tasks in blocks; equal margins are summed once."""
    spark = cells.sparkSession
    a = cells.groupBy("x").agg(F.sum("n").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("na"))
    b = cells.groupBy("y").agg(F.sum("n").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    pair = a.crossJoin(b).crossJoin(cells.agg(F.sum("n").alias("n")))  # a row for each pair of margins
    low, high = F.greatest(F.lit(1), F.col("a") + F.col("b") - F.col("n")), F.least("a", "b")
    blocks = pair.where(low <= high).select("a", "b", "n", (F.col("na") * F.col("nb")).alias("times"), high.alias("high"), F.explode(F.sequence(low, high, F.lit(block).cast("long"))).alias("low"))
    dealt = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b", "low")
    each = dealt.select("a", "b", "n", "times", F.explode(F.sequence("low", F.least("high", F.col("low") + (block - 1)))).alias("k"))
    n, a, b, k = (F.col(c) for c in ("n", "a", "b", "k"))
    ln = log_factorial
    log_p = ln(a) + ln(b) + ln(n - a) + ln(n - b) - ln(n) - ln(k) - ln(a - k) - ln(b - k) - ln(n - a - b + k)
    share = k / n * F.ln(n.cast("double") * k / (a.cast("double") * b)) * F.exp(log_p)
    return each.agg(F.coalesce(F.sum(F.col("times") * share), F.lit(0.0)).alias("emi"))


def table_indices(table: np.ndarray) -> tuple[int, float | None, float | None]:
    """(n, ARI, AMI) of one contingency table."""
    t = np.asarray(table, float)
    t = t[t.sum(1) > 0][:, t.sum(0) > 0] if t.size else t
    n = int(t.sum())
    if n < 2:
        return n, None, None
    a, b = t.sum(1), t.sum(0)
    same = ((t > 0).sum(1) == 1).all() and ((t > 0).sum(0) == 1).all()
    c2 = lambda v: (v * (v - 1) / 2).sum()
    e = c2(a) * c2(b) / (n * (n - 1) / 2)
    bottom = 0.5 * (c2(a) + c2(b)) - e
    index = (1.0 if same else 0.0) if abs(bottom) < _EPS else (c2(t) - e) / bottom
    cell = t[t > 0]
    mi = float((cell / n * np.log(n * cell / (np.outer(a, b)[t > 0]))).sum())
    h = lambda v: float(-(v / n * np.log(v / n)).sum())
    emi = expected_mi_margins(a, b)
    bottom = (h(a) + h(b)) / 2 - emi
    ami = (1.0 if same else 0.0) if abs(bottom) < math.sqrt(_EPS) else (mi - emi) / bottom
    return n, float(index), float(min(1.0, max(-1.0, ami)))


def pair_indices(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by``, n_joint, ari, ami for rows ``by``, x, y, n (cells). A table has at most
    labels x labels cells, so each group is one small task."""
    import pandas as pd

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n_joint long, ari double, ami double"

    def of(key, group):
        t = group.pivot_table(index="x", columns="y", values="n", aggfunc="sum", fill_value=0).to_numpy()
        return pd.DataFrame([(*key, *table_indices(t))], columns=[*by, "n_joint", "ari", "ami"])

    return pairs.groupBy(*by).applyInPandas(of, schema)
