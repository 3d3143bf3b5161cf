"""Results on disk: Parquet tables beside a manifest with the contract version, and
deterministic upgrades of older manifests."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.2.0"
#: Tables that each kind of result must have.
KINDS = {
    "ensemble": ("fits", "mapping", "codebook"),
    "partitions": ("labels", "pairwise", "stability"),
    "consensus": ("aligned", "samples", "coverage", "jaccard", "clusters"),
    "transfer": ("metrics",),
    "assessment": ("checks", "status"),
    "sensitivity": ("contrasts",),
}
#: Upgrades by version: a kind's setting and its value where an older result has none.
UPGRADES = {"1.0.0": ("1.1.0", {"scope": "analysis"}), "1.1.0": ("1.2.0", {"external_label_source": "legacy"})}


class ContractError(ValueError):
    """A stored result that this version cannot read."""


@dataclass
class Manifest:
    kind: str
    version: str = VERSION
    tables: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"kind": self.kind, "version": self.version, "tables": list(self.tables), "settings": self.settings}, sort_keys=True)


def _order(version: str) -> tuple[int, ...]:
    try:
        return tuple(int(x) for x in version.split("."))
    except ValueError:
        raise ContractError(f"not a version: {version}") from None


def upgrade(m: Manifest) -> Manifest:
    """The manifest at the current version. Nothing that was not recorded is invented:
    a missing table raises. Upgrading twice changes nothing."""
    if m.kind not in KINDS:
        raise ContractError(f"unknown kind {m.kind}")
    if _order(m.version) > _order(VERSION):
        raise ContractError(f"version {m.version} is newer than {VERSION}")
    lacking = set(KINDS[m.kind]) - set(m.tables)
    if lacking:
        raise ContractError(f"{m.kind} lacks {', '.join(sorted(lacking))}")
    version, settings = m.version, dict(m.settings)
    while version != VERSION:
        if version not in UPGRADES:
            raise ContractError(f"no way from version {version}")
        version, added = UPGRADES[version]
        settings = {**added, **settings}
    return Manifest(m.kind, version, tuple(m.tables), settings)


def save(path: str, kind: str, tables: dict[str, DataFrame], settings: dict | None = None) -> None:
    """Write the tables and the manifest, a one-row text table, last."""
    m = upgrade(Manifest(kind, VERSION, tuple(tables), settings or {}))
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(m.text(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[Manifest, dict[str, DataFrame]]:
    raw = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    m = upgrade(Manifest(raw["kind"], raw["version"], tuple(raw["tables"]), raw["settings"]))
    return m, {t: spark.read.parquet(f"{path}/{t}") for t in m.tables}


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: it tells whether two results are of the
    same origin without collecting them."""
    h = F.xxhash64(*(F.col(c).cast("string") for c in sorted(df.columns)))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("s")).first()
    return f"{r['n']:x}-{(r['x'] or 0) & (2**64 - 1):016x}-{r['s'] or 0:x}"
