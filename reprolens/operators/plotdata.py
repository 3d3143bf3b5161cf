"""The tables behind map plots; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid as g
from .train import Ensemble


def one_fit(ensemble: Ensemble, fit_id: str | None = None):
    """The named successful fit; without a name there must be exactly one."""
    found = ensemble.fits.where("error is null")
    found = found.where(F.col("fit_id") == fit_id) if fit_id else found
    rows = found.select("fit_id", "xdim", "ydim").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("name one successful fit")
    return rows[0]


def occupancy_plane(mapping: DataFrame, units: int) -> DataFrame:
    """``unit, value``: rows on each unit, zeros included."""
    every = mapping.sparkSession.range(1, units + 1).select(F.col("id").cast("int").alias("unit"))
    n = mapping.where("bmu is not null").groupBy(F.col("bmu").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "unit", "left").select("unit", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def component_plane(codebook: DataFrame, columns: list[str]) -> DataFrame:
    """``unit, panel, value``: a panel for each variable of a codebook ``unit, <columns>``."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return codebook.selectExpr("unit", f"stack({len(columns)}, {pairs}) as (panel, value)")


def neighbour_distance_plane(codebook: DataFrame, columns: list[str], xdim: int, ydim: int, topology: str = "hexagonal", toroidal: bool = False) -> DataFrame:
    """``unit, value``: mean distance of a unit's codes to those of its neighbours."""
    near = g.adjacency(xdim, ydim, topology, toroidal)
    pairs = [(i + 1, j + 1) for i in range(len(near)) for j in range(len(near)) if near[i, j]]
    edges = F.broadcast(codebook.sparkSession.createDataFrame(pairs, "unit int, other int"))
    a = codebook.select("unit", *(F.col(c).alias(f"a__{c}") for c in columns))
    b = codebook.select(F.col("unit").alias("other"), *(F.col(c).alias(f"b__{c}") for c in columns))
    d = F.sqrt(sum(((F.col(f"a__{c}") - F.col(f"b__{c}")) * (F.col(f"a__{c}") - F.col(f"b__{c}")) for c in columns), F.lit(0.0)))
    return a.join(edges, "unit").join(b, "other").groupBy("unit").agg(F.avg(d).alias("value"))


def cells(spark, xdim: int, ydim: int, topology: str = "hexagonal") -> DataFrame:
    """``unit, corner, x, y``: outlines of the units."""
    rows = []
    for u, (x, y) in enumerate(g.points(xdim, ydim, topology), 1):
        corners = g.hexagon(x, y) if topology == "hexagonal" else [(x - 0.5, y - 0.5), (x + 0.5, y - 0.5), (x + 0.5, y + 0.5), (x - 0.5, y + 0.5)]
        rows += [(u, i, float(a), float(b)) for i, (a, b) in enumerate(corners)]
    return spark.createDataFrame(rows, "unit int, corner int, x double, y double")


def plane(ensemble: Ensemble, kind: str, fit_id: str | None = None, layer: str | None = None, variables: list[str] | None = None) -> DataFrame:
    """``unit, panel, value`` of one fit: ``component``, ``occupancy`` or ``distance``."""
    fit = one_fit(ensemble, fit_id)
    units = fit["xdim"] * fit["ydim"]
    if kind == "occupancy":
        m = ensemble.mapping.where((F.col("fit_id") == fit["fit_id"]) & (F.col("role") == "analysis"))
        return occupancy_plane(m, units).select("unit", F.lit("occupancy").alias("panel"), "value")
    layer = layer or next(iter(ensemble.data.layers))
    names = list(ensemble.data.layers[layer])
    code = ensemble.codebook.where((F.col("fit_id") == fit["fit_id"]) & (F.col("layer") == layer))
    wide = code.select("unit", *(F.get("codes", F.lit(i)).alias(c) for i, c in enumerate(names)))
    if kind == "component":
        chosen = variables or names
        if set(chosen) - set(names):
            raise ValueError("unknown variables")
        return component_plane(wide, chosen)
    if kind == "distance":
        spec = ensemble.spec
        d = neighbour_distance_plane(wide, names, fit["xdim"], fit["ydim"], spec.topology, spec.toroidal)
        return d.select("unit", F.lit("distance").alias("panel"), "value")
    raise ValueError("planes are component, occupancy and distance")
