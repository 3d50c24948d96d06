"""Safe floors, retained sets and garbage by reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.operators.asof import latest


def unreferenced(items: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Items that none of the references (each with the key's column) names: one anti-join over their union."""
    used = reduce(DataFrame.unionByName, [r.select(key) for r in references]).distinct()
    return items.join(used, key, "left_anti")


def safe_floor(tenants: DataFrame, anchors: list[DataFrame], leases: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """tenants (tenant, head, applied or null, floor) to (tenant, floor). The new floor is the least of head, applied and
    each anchor's `at` (tenant, at); live leases (tenant, domain) hold it at what their domain has acknowledged (tenant,
    domain, observed), and where any of them has no acknowledgement it does not move. It never goes back, and a tenant
    without an applied revision keeps it."""
    out, names = tenants, ["head", "applied"]
    for i, a in enumerate(anchors):
        names.append(f"_a{i}")
        out = out.join(a.groupBy("tenant").agg(F.min("at").alias(f"_a{i}")), "tenant", "left")
    held = leases.join(acknowledged, ["tenant", "domain"], "left").groupBy("tenant").agg((F.count("*") > F.count("observed")).alias("_open"), F.min("observed").alias("_held"))
    out = out.join(held, "tenant", "left")
    target = F.when(F.col("applied").isNull() | F.coalesce("_open", F.lit(False)), F.col("floor")).otherwise(F.least(*names, "_held"))
    return out.select("tenant", F.greatest(target, "floor").cast("long").alias("floor"))


def retained_versions(versions: DataFrame, floors: DataFrame, key: list[str], revision: str, pins: list[DataFrame]) -> DataFrame:
    """Versions at or above their tenant's floor (tenant, floor), the newest of each key at or below it, and those that
    any of the pins (key and revision) names: open handles, changes that are kept."""
    rows = versions.join(floors, "tenant")
    newest = latest(rows.where(F.col(revision) <= F.col("floor")), key, revision).select(*key, revision)
    named = reduce(DataFrame.unionByName, [newest, *(p.select(*key, revision) for p in pins)]).distinct().withColumn("_named", F.lit(True))
    return rows.join(named, [*key, revision], "left").where((F.col(revision) >= F.col("floor")) | F.col("_named")).drop("_named", "floor")


def quotas(usage: DataFrame, kind: str, size: str, ceilings: dict[str, int]) -> DataFrame:
    """Bytes of each class, its ceiling, and whether it is exceeded; classes without a ceiling have none."""
    table = F.create_map(*(F.lit(x) for pair in ceilings.items() for x in pair))
    return usage.groupBy(kind).agg(F.sum(size).cast("long").alias("n_bytes")).withColumn("ceiling", table[F.col(kind)]).withColumn("exceeded", F.coalesce(F.col("n_bytes") > F.col("ceiling"), F.lit(False)))


def has_newer(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """All but the newest of each key."""
    return rows.join(rows.groupBy(*key).agg(F.max(order).alias("_newest")), key).where(F.col(order) < F.col("_newest")).drop("_newest")
