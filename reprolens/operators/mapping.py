"""Mapping rows to the nearest unit of a codebook, and the quality of a map.

A codebook is a small table ``unit, <column>...``. It is read to the driver, after a
check of its size, and becomes part of the expression: each row's distances to all units
are one array, so nothing is shuffled or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as g


def layer_distance(row: dict[str, Column], code: dict[str, Column], layers: dict[str, tuple[str, ...]], weights: dict[str, float], max_missing: float = 1.0) -> Column:
    """Weighted mean over layers of squared distances scaled up for missing values;
    null where no layer has a value or a layer misses too many."""
    total, used = F.lit(0.0), F.lit(0.0)
    for name, columns in layers.items():
        seen = sum((row[c].isNotNull().cast("int") for c in columns), F.lit(0))
        d = sum((F.coalesce((row[c] - code[c]) * (row[c] - code[c]), F.lit(0.0)) for c in columns), F.lit(0.0))
        usable = (seen > 0) & ((len(columns) - seen) <= max_missing * len(columns))
        total = total + F.when(usable, weights[name] * d * len(columns) / seen).otherwise(0.0)
        used = used + F.when(usable, F.lit(weights[name])).otherwise(0.0)
    return F.when(used > 0, total / used)


#: Most numbers of a codebook (8 MB), and most that are written out as single expressions.
MAX_CODES = 1_000_000
UNROLLED = 512


def codes_of(codebook: DataFrame, columns: list[str]) -> list:
    """The rows (unit, columns) of a codebook, by unit."""
    rows = codebook.select("unit", *columns).limit(MAX_CODES // max(len(columns), 1) + 1).collect()
    if len(rows) * len(columns) > MAX_CODES:
        raise ValueError(f"a codebook of over {MAX_CODES} numbers")
    return sorted(rows, key=lambda r: r["unit"])


def _distances(codes: list, columns: list[str], layers: dict[str, tuple[str, ...]], weights: dict[str, float], max_missing: float) -> Column:
    """Array of the distances to all units, by unit."""
    row = {c: F.col(c) for c in columns}
    if len(codes) * len(columns) <= UNROLLED:
        return F.array(*(layer_distance(row, {c: F.lit(r[c]).cast("double") for c in columns}, layers, weights, max_missing) for r in codes))
    each = F.array(*(F.array(*(F.lit(r[c]).cast("double") for c in columns)) for r in codes))
    at = {c: i for i, c in enumerate(columns)}
    return F.transform(each, lambda u: layer_distance(row, {c: F.get(u, F.lit(i)) for c, i in at.items()}, layers, weights, max_missing))


def map_rows(rows: DataFrame, codebook: DataFrame, layers: dict[str, tuple[str, ...]], weights: dict[str, float] | None = None, max_missing: float = 1.0) -> DataFrame:
    """``rows`` with ``bmu``, ``second`` and ``distance`` (null if it cannot be mapped).
    Of equally near units the first is taken. Without units nothing is mapped."""
    columns = [c for cs in layers.values() for c in cs]
    codes = codes_of(codebook, columns)
    kind = codebook.schema["unit"].dataType
    if not codes:
        return rows.withColumns({"bmu": F.lit(None).cast(kind), "second": F.lit(None).cast(kind), "distance": F.lit(None).cast("double")})
    units = F.array(*(F.lit(r["unit"]).cast(kind) for r in codes))
    n = len(codes)
    made = rows.withColumn("_all", _distances(codes, columns, layers, weights or dict.fromkeys(layers, 1.0), max_missing))
    made = made.withColumn("distance", F.array_min("_all"))
    made = made.withColumn("_at", F.nullif(F.array_position("_all", F.col("distance")).cast("int"), F.lit(0)))
    # the same among the others
    made = made.withColumn("_rest", F.concat(F.slice("_all", F.lit(1), F.col("_at") - 1), F.slice("_all", F.col("_at") + 1, F.lit(n))))
    made = made.withColumn("_then", F.nullif(F.array_position("_rest", F.array_min("_rest")).cast("int"), F.lit(0)))
    second = F.col("_then") + F.when(F.col("_then") >= F.col("_at"), 1).otherwise(0)
    return made.select(*(F.col(f"`{c}`") for c in rows.columns), F.get(units, F.col("_at") - 1).alias("bmu"), F.get(units, second - 1).alias("second"), "distance")


def map_rows_joined(rows: DataFrame, codebook: DataFrame, columns: list[str], id_col: str = "sample_id") -> DataFrame:
    """``id, bmu, distance`` by a nested-loop join and min_by, for one complete layer."""
    code = codebook.select("unit", *(F.col(c).alias(f"c__{c}") for c in columns))
    d = sum(((F.col(c) - F.col(f"c__{c}")) * (F.col(c) - F.col(f"c__{c}")) for c in columns), F.lit(0.0))
    both = rows.crossJoin(F.broadcast(code)).withColumn("d", d)
    best = both.groupBy(id_col).agg(F.min(F.struct("d", "unit")).alias("b"))
    return best.select(id_col, F.col("b.unit").alias("bmu"), F.col("b.d").alias("distance"))


def quantization_error(mapped: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return mapped.groupBy(*by).agg(F.avg("distance").alias("quantization_error"))


def unit_summary(mapped: DataFrame) -> DataFrame:
    """``bmu, n, mean_distance`` of the units that have rows."""
    return mapped.where("bmu is not null").groupBy("bmu").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))


def empty_unit_rate(mapped: DataFrame, units: int, by: tuple[str, ...] = ()) -> DataFrame:
    return mapped.groupBy(*by).agg((1 - F.count_distinct("bmu") / F.lit(units)).alias("empty_unit_rate"))


def _adjacent(xdim: int, ydim: int, topology: str, toroidal: bool) -> Column:
    near = g.adjacency(xdim, ydim, topology, toroidal)
    n = len(near)
    # units are few: the adjacency is one array of flags
    flags = F.array(*(F.lit(bool(near[i, j])) for i in range(n) for j in range(n)))
    return F.get(flags, (F.col("bmu") - 1) * n + F.col("second") - 1)


def topographic_error(mapped: DataFrame, xdim: int, ydim: int, topology: str = "hexagonal", toroidal: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose two nearest units are not neighbours; rows with fewer than
    two distances are skipped."""
    ok = _adjacent(xdim, ydim, topology, toroidal)
    return mapped.where("bmu is not null and second is not null").groupBy(*by).agg(F.avg(F.when(ok, 0.0).otherwise(1.0)).alias("topographic_error"))


def unoccupied_rate(mapped: DataFrame, occupied: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of mapped rows whose unit has no row in ``occupied`` (``bmu``); null if none is mapped."""
    units = occupied.where("bmu is not null").select(F.col("bmu").alias("_u"), F.lit(1).alias("_o")).distinct()
    both = mapped.where("bmu is not null").join(F.broadcast(units), F.col("bmu") == F.col("_u"), "left")
    return both.groupBy(*by).agg(F.avg(F.when(F.col("_o").isNull(), 1.0).otherwise(0.0)).alias("unoccupied_rate"))


def map_quality(mapped: DataFrame, units: int, xdim: int, ydim: int, topology: str = "hexagonal", toroidal: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Quantization error, empty-unit rate and topographic error by one aggregation."""
    both = F.col("bmu").isNotNull() & F.col("second").isNotNull()
    return mapped.groupBy(*by).agg(
        F.avg("distance").alias("quantization_error"),
        # units are few: those seen are one small set a group
        (1 - F.size(F.collect_set("bmu")) / F.lit(units)).alias("empty_unit_rate"),
        F.avg(F.when(both, F.when(_adjacent(xdim, ydim, topology, toroidal), 0.0).otherwise(1.0))).alias("topographic_error"),
    )


def initial_codebook(rows: DataFrame, columns: list[str], units: int, seed: int = 1, id_col: str = "sample_id") -> DataFrame:
    """One row of the data for each unit, the first in the unit's digest order.

    The least first 15 hexadecimal digits of each unit are found as numbers, by one hash
    aggregation; only the rows that have them are compared by whole digests."""
    spark = rows.sparkSession
    if units * len(columns) > MAX_CODES:
        raise ValueError(f"a codebook of over {MAX_CODES} numbers")
    digest = lambda unit: F.md5(F.concat_ws(":", F.lit(str(seed)), unit.cast("string"), F.col(id_col).cast("string")))
    head = lambda key: F.conv(F.left(key, F.lit(15)), 16, 10).cast("long")
    number = spark.range(1, units + 1).select(F.col("id").cast("int").alias("unit"))
    least = rows.select(id_col).crossJoin(F.broadcast(number)).select("unit", head(digest(F.col("unit"))).alias("k")).groupBy("unit").agg(F.min("k").alias("k")).collect()
    schema = "unit int, " + ", ".join(f"`{c}` double" for c in columns)
    if not least:
        return spark.createDataFrame([], schema)
    first = F.broadcast(spark.createDataFrame([(r["unit"], r["k"]) for r in least], "unit int, _least long"))
    tied = rows.crossJoin(first).withColumn("_key", digest(F.col("unit"))).where(head(F.col("_key")) == F.col("_least"))
    tied = tied.withColumn("_k", F.struct("_key", F.col(id_col).cast("string").alias("i")))
    got = tied.groupBy("unit").agg(*(F.min_by(c, "_k").cast("double").alias(c) for c in columns)).collect()
    return spark.createDataFrame([tuple(r) for r in got], schema)


def batch_epoch(rows: DataFrame, codebook: DataFrame, columns: list[str], neighbourhood: list[tuple[int, int, float]], id_col: str = "sample_id") -> DataFrame:
    """The codebook after one batch step: each unit the mean of all rows weighted by the
    neighbourhood of their best unit. Rows are reduced to sums per unit first, so what is
    shuffled is units times columns."""
    mapped = map_rows(rows.select(id_col, *columns), codebook, {"data": tuple(columns)})
    sums = mapped.groupBy("bmu").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s__{c}") for c in columns))
    h = rows.sparkSession.createDataFrame(neighbourhood, "unit int, other int, h double")
    each = F.broadcast(h).join(sums, F.col("other") == F.col("bmu"))
    weight = F.sum(F.col("h") * F.col("n"))
    return each.groupBy("unit").agg(*((F.sum(F.col("h") * F.col(f"s__{c}")) / weight).alias(c) for c in columns))
