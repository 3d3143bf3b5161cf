"""Model budgets: which maps are trained, on which seeds, cut at which k."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SpecError(ValueError):
    """A model budget that makes no sense."""


@dataclass(frozen=True)
class Spec:
    grids: tuple[tuple[int, int], ...] = ((7, 5),)
    seeds: tuple[int, ...] = tuple(range(1, 11))
    steps: int = 500
    topology: str = "hexagonal"
    neighbourhood: str = "gaussian"
    toroidal: bool = False
    mode: str = "batch"
    k: tuple[int, ...] = tuple(range(2, 9))
    max_na_fraction: float = 0.0
    layer_weights: dict[str, float] | None = None
    normalize_layers: bool = True
    alpha: tuple[float, float] = field(default=(0.05, 0.01))

    def __post_init__(self):
        if not self.grids or len(set(self.grids)) != len(self.grids) or any(min(g) < 2 for g in self.grids):
            raise SpecError("grids must be distinct and at least 2 by 2")
        if not self.seeds or len(set(self.seeds)) != len(self.seeds) or any(not 0 <= s < 2**31 for s in self.seeds):
            raise SpecError("seeds must be distinct and from 0 to 2^31 - 1")
        if self.topology not in ("hexagonal", "rectangular") or self.neighbourhood not in ("gaussian", "bubble"):
            raise SpecError("unknown topology or neighbourhood")
        if self.mode != "batch":
            raise SpecError("only batch training is implemented: online updates are one row at a time")
        if not self.k or min(self.k) < 2 or max(self.k) > min(x * y for x, y in self.grids):
            raise SpecError("k must be from 2 to the units of the smallest grid")
        if not 0 <= self.max_na_fraction < 1 or self.steps < 1:
            raise SpecError("max_na_fraction is in [0, 1) and steps at least 1")


def expand(spark: SparkSession, spec: Spec) -> DataFrame:
    """``grid_id, xdim, ydim, seed, model_id``: grids times seeds."""
    grids = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spec.grids, 1)], "grid_id int, xdim int, ydim int")
    seeds = spark.createDataFrame([(s,) for s in sorted(spec.seeds)], "seed long")
    both = grids.crossJoin(seeds)
    return both.withColumn("model_id", F.format_string("g%02d_%dx%d_s%d", "grid_id", "xdim", "ydim", "seed"))


class BudgetError(ValueError):
    """Quadratic work beyond its stated limit, found before any of it is done."""


def check_pairs(n_fits: int, n_k: int, limit: int) -> int:
    """Pairwise comparisons of n_fits at n_k levels; raises if over ``limit``."""
    n = n_fits * (n_fits - 1) // 2 * n_k
    if n > limit:
        raise BudgetError(f"{n} pairwise comparisons; the limit is {limit}")
    return n
