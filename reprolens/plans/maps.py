"""Queries on maps: codebooks, best units, map quality and plot tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid as g
from ..operators import mapping, plotdata, representation
from .common import quantile8_sql, r6, table

COLS = ["x1", "x2", "x3", "x4"]
X, Y, UNITS = 3, 2, 6


def lines(spark, sf_dir) -> DataFrame:
    """lineitem as samples of four standardised columns."""
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("sample_id"),
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
    )
    m = raw.agg(*(f(c).alias(f"{n}_{c}") for c in "qedt" for n, f in (("a", F.avg), ("s", F.stddev_samp)))).first()  # one row of moments
    return raw.select("sample_id", "flag", *(F.round((F.col(c) - F.lit(m[f"a_{c}"])) / F.lit(m[f"s_{c}"]), 6).alias(x) for c, x in zip("qedt", COLS, strict=True)))


def _mapped(spark, sf_dir):
    rows = lines(spark, sf_dir)
    code = mapping.initial_codebook(rows, COLS, UNITS)
    return rows, code, mapping.map_rows(rows, code, {"data": tuple(COLS)})


def bmu_map(spark, sf_dir):
    _, _, m = _mapped(spark, sf_dir)
    return m.groupBy("bmu", "second").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 3).alias("total"))


def bmu_map_joined(spark, sf_dir):
    rows = lines(spark, sf_dir)
    m = mapping.map_rows_joined(rows, mapping.initial_codebook(rows, COLS, UNITS), COLS)
    return m.groupBy("bmu").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


def quantization_error(spark, sf_dir):
    """Flagship: rows and mean distance of every unit."""
    _, _, m = _mapped(spark, sf_dir)
    return mapping.unit_summary(m).select("bmu", "n", r6("mean_distance"))


def fit_quality(spark, sf_dir):
    _, _, m = _mapped(spark, sf_dir)
    return mapping.map_quality(m, UNITS, X, Y, "rectangular", by=("flag",)).select("flag", r6("quantization_error"), r6("empty_unit_rate"), r6("topographic_error"))


def unoccupied_rate(spark, sf_dir):
    _, _, m = _mapped(spark, sf_dir)
    train = m.where("flag = 'N' and x1 > 1.5")
    return mapping.unoccupied_rate(m, train, ("flag",)).select("flag", r6("unoccupied_rate"))


def missing_values_map(spark, sf_dir):
    """Two layers, one with gaps: distances are scaled up for what is missing."""
    rows = lines(spark, sf_dir)
    code = mapping.initial_codebook(rows, COLS, UNITS)
    holes = rows.withColumn("x1", F.when(F.col("x1") < 1, F.col("x1"))).withColumn("x4", F.when(F.col("x4") < 1, F.col("x4")))
    m = mapping.map_rows(holes, code, {"one": ("x1", "x2"), "two": ("x3", "x4")}, {"one": 0.75, "two": 0.25}, max_missing=0.5)
    return m.groupBy("bmu").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 3).alias("total"))


def neighbourhood(xdim: int, ydim: int, radius: float, topology: str = "rectangular") -> list[tuple[int, int, float]]:
    d = g.distances(xdim, ydim, topology)
    h = np.exp(-(d**2) / (2 * radius**2))
    return [(i + 1, j + 1, round(float(h[i, j]), 9)) for i in range(len(h)) for j in range(len(h))]


def batch_epoch(spark, sf_dir):
    rows = lines(spark, sf_dir)
    code = mapping.initial_codebook(rows, COLS, UNITS)
    return mapping.batch_epoch(rows, code, COLS, neighbourhood(X, Y, 1.0)).select("unit", *(r6(c) for c in COLS))


def hop_table(spark, sf_dir):
    return spark.createDataFrame(g.hop_rows(4, 3, "rectangular"), "unit int, other int, hops int")


def grid_adjacency(spark, sf_dir):
    a = g.adjacency(4, 3, "hexagonal")
    return spark.createDataFrame([(i + 1, int(r.sum())) for i, r in enumerate(a)], "unit int, neighbours int")


def grid_points(spark, sf_dir):
    p = g.points(4, 3, "hexagonal")
    return spark.createDataFrame([(i + 1, round(float(x), 6), round(float(y), 6)) for i, (x, y) in enumerate(p)], "unit int, x double, y double")


def occupancy_plane(spark, sf_dir):
    _, _, m = _mapped(spark, sf_dir)
    return plotdata.occupancy_plane(m, 8)


def component_plane(spark, sf_dir):
    code = mapping.initial_codebook(lines(spark, sf_dir), COLS, UNITS)
    return plotdata.component_plane(code, COLS).select("unit", "panel", r6("value"))


def neighbour_distance_plane(spark, sf_dir):
    code = mapping.initial_codebook(lines(spark, sf_dir), COLS, UNITS)
    return plotdata.neighbour_distance_plane(code, COLS, X, Y, "rectangular").select("unit", r6("value"))


def _two_maps(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_size") % 6 + 1).alias("ua"), (F.floor(F.col("p_retailprice")).cast("int") % 6 + 1).alias("ub"))


def hop_counts(spark, sf_dir):
    hops = spark.createDataFrame(g.hop_rows(X, Y, "rectangular"), "u int, v int, hop int")
    return representation.hop_counts(_two_maps(spark, sf_dir), hops, "ua", "ub")


def spearman_hist(spark, sf_dir):
    return representation.spearman_of_counts(hop_counts(spark, sf_dir)).select(r6("rho"))


def metric_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderpriority").alias("fit_id"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 5 + 1).alias("bmu"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice") / 1000).alias("distance"))
    return representation.metric_status(m).select("fit_id", "n_scope", "n_mapped", r6("quantization_error"), "metric_status")


def representation_fit_summary(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    m = s.select(
        (F.col("s_nationkey") % 3 + 1).alias("grid_id"), (F.col("s_nationkey") % 3 + 3).alias("xdim"), F.lit(4).alias("ydim"), F.when(k % 4 == 0, "no_mapped_rows").otherwise("computed").alias("metric_status"),
        F.when(k % 4 != 0, 1 - k % 9 / 20.0).alias("mapping_coverage"), (F.col("s_acctbal") / 100).alias("quantization_error"), (k % 10 / 10.0).alias("topographic_error"), (k % 7 / 7.0).alias("empty_unit_rate"),
    )
    out = representation.fit_summary(m)
    return out.select("grid_id", "xdim", "ydim", "n_fits", "n_evaluable", *(r6(c) for c in out.columns if c.startswith("median_")))


def representation_pair_summary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pairs = p.select((k % 2 == 0).alias("same_split"), (k % 3 == 0).alias("same_grid"), F.when(k % 5 != 0, F.col("p_retailprice") / 2500).alias("distance_correlation"))
    out = representation.pair_summary(pairs)
    return out.select("same_split", "same_grid", "n_pairs", "n_rho_evaluable", r6("median_rho"), r6("rho_low"), r6("rho_high"))


QUERIES = {
    f.__name__: f
    for f in (
        representation_fit_summary, representation_pair_summary, quantization_error, bmu_map, bmu_map_joined, fit_quality, unoccupied_rate, missing_values_map, batch_epoch, hop_table, grid_adjacency, grid_points,
        occupancy_plane, component_plane, neighbour_distance_plane, hop_counts, spearman_hist, metric_status,
    )
}

_Z = "m AS (SELECT avg(q) AS aq, stddev_samp(q) AS sq, avg(e) AS ae, stddev_samp(e) AS se, avg(d) AS ad, stddev_samp(d) AS sd, avg(t) AS at_, stddev_samp(t) AS st FROM raw)"
BASE = f"""
    raw AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS sample_id, l_returnflag AS flag,
                   l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t FROM lineitem),
    {_Z},
    z AS (SELECT sample_id, flag, round((q - aq) / sq, 6) AS x1, round((e - ae) / se, 6) AS x2, round((d - ad) / sd, 6) AS x3, round((t - at_) / st, 6) AS x4 FROM raw, m),
    code AS (SELECT unit, arg_min(x1, k) AS c1, arg_min(x2, k) AS c2, arg_min(x3, k) AS c3, arg_min(x4, k) AS c4
             FROM (SELECT unit, z.*, md5(concat_ws(':', '1', unit, sample_id)) || sample_id AS k FROM z, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS unit)) GROUP BY unit),
    dist AS (SELECT sample_id, flag, x1, x2, x3, x4, unit, (x1 - c1) ** 2 + (x2 - c2) ** 2 + (x3 - c3) ** 2 + (x4 - c4) ** 2 AS dd FROM z, code),
    near AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY dd, unit) AS place FROM dist),
    map AS (SELECT a.sample_id, a.flag, a.x1, a.x2, a.x3, a.x4, a.unit AS bmu, b.unit AS second, a.dd AS distance
            FROM near a JOIN near b ON a.sample_id = b.sample_id AND a.place = 1 AND b.place = 2)"""
_GRID = "grid AS (SELECT CAST(u + 1 AS INTEGER) AS unit, u % 3 AS gx, u // 3 AS gy FROM range(6) t(u))"
_NEAR = "SELECT a.unit AS unit, b.unit AS other FROM grid a, grid b WHERE greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1"
_HOPS6 = "hop AS (SELECT a.unit AS u, b.unit AS v, greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) AS hop FROM grid a, grid b)"
_TWO = """
    s AS (SELECT p_size % 6 + 1 AS ua, CAST(floor(p_retailprice) AS INTEGER) % 6 + 1 AS ub FROM part),
    c AS (SELECT ua, ub, count(*) AS n FROM s GROUP BY ALL),
    hc AS (SELECT ha.hop AS hop_a, hb.hop AS hop_b,
                  CAST(sum(CASE WHEN a.ua = b.ua AND a.ub = b.ub THEN a.n * (a.n - 1) ELSE a.n * b.n END) / 2 AS BIGINT) AS n
           FROM c a, c b, hop ha, hop hb WHERE ha.u = a.ua AND ha.v = b.ua AND hb.u = a.ub AND hb.v = b.ub GROUP BY ALL)"""

ORACLE = {
    "bmu_map": f"WITH {BASE} SELECT bmu, second, count(*) AS n, round(sum(distance), 3) AS total FROM map GROUP BY ALL",
    "bmu_map_joined": f"WITH {BASE} SELECT bmu, count(*) AS n, round(avg(distance), 6) AS mean_distance FROM map GROUP BY bmu",
    "quantization_error": f"WITH {BASE} SELECT bmu, count(*) AS n, round(avg(distance), 6) AS mean_distance FROM map GROUP BY bmu",
    "fit_quality": f"""WITH {BASE}, {_GRID}, edge AS ({_NEAR})
        SELECT flag, round(avg(distance), 6) AS quantization_error, round(1 - count(DISTINCT bmu) / 6.0e0, 6) AS empty_unit_rate,
               round(avg(CASE WHEN edge.unit IS NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS topographic_error
        FROM map LEFT JOIN edge ON edge.unit = bmu AND edge.other = second GROUP BY flag""",
    "unoccupied_rate": f"""WITH {BASE}, o AS (SELECT DISTINCT bmu AS u FROM map WHERE flag = 'N' AND x1 > 1.5)
        SELECT flag, round(avg(CASE WHEN u IS NULL THEN 1.0e0 ELSE 0.0e0 END), 6) AS unoccupied_rate FROM map LEFT JOIN o ON bmu = u GROUP BY flag""",
    "missing_values_map": f"""WITH {BASE},
        h AS (SELECT sample_id, CASE WHEN x1 < 1 THEN x1 END AS x1, x2, x3, CASE WHEN x4 < 1 THEN x4 END AS x4 FROM z),
        d AS (SELECT sample_id, unit, (0.75e0 * CASE WHEN x1 IS NULL THEN 2 * (x2 - c2) ** 2 ELSE (x1 - c1) ** 2 + (x2 - c2) ** 2 END
                + 0.25e0 * CASE WHEN x4 IS NULL THEN 2 * (x3 - c3) ** 2 ELSE (x3 - c3) ** 2 + (x4 - c4) ** 2 END) / 1.0e0 AS dd FROM h, code),
        b AS (SELECT sample_id, arg_min(unit, dd) AS bmu, min(dd) AS dd FROM d GROUP BY sample_id)
        SELECT bmu, count(*) AS n, round(sum(dd), 3) AS total FROM b GROUP BY bmu""",
    "batch_epoch": f"""WITH {BASE}, s AS (SELECT bmu, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, sum(x4) AS s4 FROM map GROUP BY bmu),
        h(unit, other, h) AS (VALUES {", ".join(f"({u}, {v}, {w:.9f}e0)" for u, v, w in neighbourhood(X, Y, 1.0))})
        SELECT unit, round(sum(h * s1) / sum(h * n), 6) AS x1, round(sum(h * s2) / sum(h * n), 6) AS x2, round(sum(h * s3) / sum(h * n), 6) AS x3, round(sum(h * s4) / sum(h * n), 6) AS x4
        FROM h JOIN s ON other = bmu GROUP BY unit""",
    "hop_table": """
        WITH RECURSIVE grid AS (SELECT CAST(u + 1 AS INTEGER) AS unit, u % 4 AS gx, u // 4 AS gy FROM range(12) t(u)),
        edge AS (SELECT a.unit AS u, b.unit AS v FROM grid a, grid b WHERE greatest(abs(a.gx - b.gx), abs(a.gy - b.gy)) = 1),
        walk AS (SELECT unit AS u, unit AS v, 0 AS hops FROM grid UNION SELECT w.u, e.v, w.hops + 1 FROM walk w JOIN edge e ON w.v = e.u WHERE w.hops < 12)
        SELECT u AS unit, v AS other, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY u, v""",
    "grid_adjacency": """
        WITH p AS (SELECT CAST(u + 1 AS INTEGER) AS unit, u % 4 + 1 + CASE WHEN (u // 4) % 2 = 0 THEN 0.5e0 ELSE 0 END AS x, (u // 4 + 1) * sqrt(0.75e0) AS y FROM range(12) t(u))
        SELECT a.unit, CAST(count(*) AS INTEGER) AS neighbours FROM p a JOIN p b ON a.unit <> b.unit AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.00000001e0 GROUP BY a.unit""",
    "grid_points": """
        SELECT CAST(u + 1 AS INTEGER) AS unit, round(u % 4 + 1 + CASE WHEN (u // 4) % 2 = 0 THEN 0.5e0 ELSE 0 END, 6) AS x, round((u // 4 + 1) * sqrt(0.75e0), 6) AS y FROM range(12) t(u)""",
    "occupancy_plane": f"""WITH {BASE} SELECT CAST(u AS INTEGER) AS unit, CAST(count(bmu) AS DOUBLE) AS value FROM range(1, 9) t(u) LEFT JOIN map ON bmu = u GROUP BY u""",
    "component_plane": f"""WITH {BASE} SELECT unit, 'x1' AS panel, round(c1, 6) AS value FROM code UNION ALL SELECT unit, 'x2', round(c2, 6) FROM code
        UNION ALL SELECT unit, 'x3', round(c3, 6) FROM code UNION ALL SELECT unit, 'x4', round(c4, 6) FROM code""",
    "neighbour_distance_plane": f"""WITH {BASE}, {_GRID}, edge AS ({_NEAR})
        SELECT a.unit, round(avg(sqrt((a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2 + (a.c3 - b.c3) ** 2 + (a.c4 - b.c4) ** 2)), 6) AS value
        FROM code a JOIN edge ON a.unit = edge.unit JOIN code b ON b.unit = edge.other GROUP BY a.unit""",
    "hop_counts": f"WITH {_GRID}, {_HOPS6}, {_TWO} SELECT * FROM hc WHERE n > 0",
    "spearman_hist": f"""WITH {_GRID}, {_HOPS6}, {_TWO},
        a AS (SELECT hop_a, sum(n) AS c FROM hc GROUP BY 1), b AS (SELECT hop_b, sum(n) AS c FROM hc GROUP BY 1),
        ra AS (SELECT hop_a, sum(c) OVER (ORDER BY hop_a) - c + (c + 1) / 2.0e0 AS ra FROM a), rb AS (SELECT hop_b, sum(c) OVER (ORDER BY hop_b) - c + (c + 1) / 2.0e0 AS rb FROM b),
        j AS (SELECT CAST(n AS DOUBLE) AS n, CAST(ra AS DOUBLE) AS ra, CAST(rb AS DOUBLE) AS rb FROM hc JOIN ra USING (hop_a) JOIN rb USING (hop_b)),
        u AS (SELECT sum(n * ra) / sum(n) AS ma, sum(n * rb) / sum(n) AS mb FROM j)
        SELECT round(sum(n * (ra - ma) * (rb - mb)) / sqrt(sum(n * (ra - ma) ** 2) * sum(n * (rb - mb) ** 2)), 6) AS rho FROM j, u""",
    "representation_fit_summary": """
        SELECT s_nationkey % 3 + 1 AS grid_id, s_nationkey % 3 + 3 AS xdim, 4 AS ydim, count(*) AS n_fits, CAST(sum(CASE WHEN s_suppkey % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_evaluable,
               round(median(CASE WHEN s_suppkey % 4 <> 0 THEN 1 - s_suppkey % 9 / 20.0e0 END), 6) AS median_mapping_coverage, round(median(s_acctbal / 100), 6) AS median_quantization_error,
               round(median(s_suppkey % 10 / 10.0e0), 6) AS median_topographic_error, round(median(s_suppkey % 7 / 7.0e0), 6) AS median_empty_unit_rate FROM supplier GROUP BY 1, 2""",
    "representation_pair_summary": f"""
        WITH p AS (SELECT p_partkey % 2 = 0 AS same_split, p_partkey % 3 = 0 AS same_grid, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice / 2500 END AS rho FROM part),
        l AS (SELECT same_split, same_grid, count(*) AS n_pairs, count(rho) AS n_rho_evaluable, median(rho) AS m, list_sort(list(rho) FILTER (rho IS NOT NULL)) AS v FROM p GROUP BY ALL)
        SELECT same_split, same_grid, n_pairs, n_rho_evaluable, round(m, 6) AS median_rho, round({quantile8_sql('v', 0.025)}, 6) AS rho_low, round({quantile8_sql('v', 0.975)}, 6) AS rho_high FROM l""",
    "metric_status": """
        SELECT o_orderpriority AS fit_id, count(*) AS n_scope, CAST(sum(CASE WHEN o_custkey % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_mapped,
               round(avg(CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice / 1000 END), 6) AS quantization_error, 'computed_with_partial_mapping' AS metric_status
        FROM orders GROUP BY 1""",
}
