"""Batches of object mutations: versions to append, scoped changes to append, and what is refused.

A batch is a table of requests. Checks are joins against the live objects and give a reason or none; what passes gets a
revision above its tenant's head and becomes version rows and change rows, which a manifest commit makes visible at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.operators.asof import numbered

VERSION = ["tenant", "object_id", "parent_id", "revision", "metadata_revision", "content_revision", "name", "size", "mount", "provider", "tombstone"]


def settled(requests: DataFrame, known: DataFrame, mutation: str, digest: str) -> DataFrame:
    """Adds outcome: apply, replay (known under the same digest) or conflict (under another). Of requests that share a
    mutation the first in order of `request` counts as known for the others."""
    first = requests.groupBy(mutation).agg(F.min_by(F.struct("request", digest), "request").alias("_first"))
    old = known.select(mutation, F.col(digest).alias("_known"))
    rows = requests.join(first, mutation).join(old, mutation, "left")
    same = F.col(digest).eqNullSafe(F.coalesce("_known", F.col("_first")[digest]))
    is_first = F.col("_known").isNull() & (F.col("request") == F.col("_first.request"))
    return rows.withColumn("outcome", F.when(is_first, "apply").when(same, "replay").otherwise("conflict")).drop("_first", "_known")


def with_revisions(requests: DataFrame, heads: DataFrame, tenant: str, order: str) -> DataFrame:
    """revision: above the tenant's head, in order; tenants without a head start at 1."""
    rows = numbered(requests, [tenant], [order], "_n").join(heads.select(tenant, F.col("head").alias("_head")), tenant, "left")
    return rows.withColumn("revision", (F.coalesce("_head", F.lit(0)) + F.col("_n") + 1).cast("long")).drop("_n", "_head")


def parents_of(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Adds there: whether the requested parent is a live object of the tenant."""
    parents = live.select("tenant", F.col("object_id").alias("parent_id"), F.lit(True).alias("there"))
    return requests.join(parents, ["tenant", "parent_id"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def scoped(old: dict[str, Column] | None, new: dict[str, Column] | None, presentations: list[str], upsert_if: Column) -> Column:
    """Array of change structs (presentation, scope_parent, kind, object_revision): a delete in the old scope where
    visibility or the parent is lost, an upsert in the new one where upsert_if holds or visibility is gained."""
    out = []
    for n, p in enumerate(presentations):
        was = F.coalesce(old[p], F.lit(False)) if old else F.lit(False)
        now = F.coalesce(new[p], F.lit(False)) if new else F.lit(False)
        moved = old["parent_id"] != new["parent_id"] if old and new else F.lit(True)
        change = lambda s, kind: F.struct(F.lit(n).alias("presentation"), s["parent_id"].alias("scope_parent"), F.lit(kind).alias("kind"), s["revision"].alias("object_revision"))  # noqa: E731, B023
        if old:
            out.append(F.when(was & (~now | moved), change(old, "delete")))
        if new:
            out.append(F.when(now & (~was | upsert_if), change(new, "upsert")))
    return F.array_compact(F.array(*out))


def changes_of(rows: DataFrame, changes: Column, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.*")


def side(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in ("parent_id", "revision", "name", "size", "mount", "provider")}


def created(requests: DataFrame) -> DataFrame:
    """(…, object_id, revision) to version rows; metadata and content start at the revision."""
    rev = F.col("revision")
    return requests.select("tenant", "object_id", "parent_id", rev, rev.alias("metadata_revision"), rev.alias("content_revision"), "name", "size", "mount", "provider", F.lit(False).alias("tombstone"))


def revised(current: DataFrame, requests: DataFrame) -> DataFrame:
    """current ⋈ requests (tenant, object_id; null fields stay as they are): rows with structs old and new."""
    fields = ["parent_id", "name", "size", "mount", "provider"]
    j = current.alias("o").join(requests.alias("r"), ["tenant", "object_id"])
    new = {c: F.coalesce(F.col(f"r.{c}"), F.col(f"o.{c}")) for c in fields}
    meta = reduce(Column.__or__, [new[c] != F.col(f"o.{c}") for c in ("parent_id", "name", "mount", "provider")])
    content = new["size"] != F.col("o.size")
    structs = F.struct(*(v.alias(c) for c, v in new.items()), F.col("r.revision").alias("revision"), F.when(meta, F.col("r.revision")).otherwise(F.col("o.revision")).alias("metadata_revision"), F.when(content, F.col("r.revision")).otherwise(F.col("o.revision")).alias("content_revision"))
    return j.select("tenant", "object_id", F.struct(F.col("o.revision").alias("revision"), *(F.col(f"o.{c}").alias(c) for c in fields)).alias("old"), structs.alias("new"), meta.alias("metadata_changed"), content.alias("content_changed"))


def deletable(requests: DataFrame, live: DataFrame, root: Column) -> DataFrame:
    """requests (tenant, object_id) with reason: root, missing, not_empty, or null where it may go."""
    own = live.select("tenant", "object_id", "parent_id", "revision", "mount", "provider", F.lit(True).alias("there"))
    children = live.select("tenant", F.col("parent_id").alias("object_id")).distinct().withColumn("children", F.lit(True))
    rows = requests.join(own, ["tenant", "object_id"], "left").join(children, ["tenant", "object_id"], "left")
    return rows.withColumn("reason", F.when(root, "root").when(F.col("there").isNull(), "missing").when(F.col("children"), "not_empty")).drop("there", "children")


def replaced(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """pairs (tenant, source, target, revision): the two versions of each rename-over. The source keeps its id and takes
    the target's place and name, visible where either was; the target becomes an invisible tombstone. Pairs whose ends
    are not both live, or are one object, give nothing."""
    end = lambda a: live.select("tenant", F.col("object_id").alias(a), F.struct("parent_id", "revision", "name", "size", "mount", "provider").alias(f"{a}_was"))
    both = pairs.where("source <> target").join(end("source"), ["tenant", "source"]).join(end("target"), ["tenant", "target"])
    s, t = F.col("source_was"), F.col("target_was")
    version = lambda oid, parent, name, size, mount, provider, content, dead: F.struct(oid.alias("object_id"), parent.alias("parent_id"), name.alias("name"), size.alias("size"), mount.alias("mount"), provider.alias("provider"), content.alias("content_revision"), F.lit(dead).alias("tombstone"))
    rows = F.array(
        version(F.col("target"), t["parent_id"], t["name"], t["size"], F.lit(False), F.lit(False), t["revision"], True),
        version(F.col("source"), t["parent_id"], t["name"], s["size"], s["mount"] | t["mount"], s["provider"] | t["provider"], s["revision"], False),
    )
    return both.select("tenant", "revision", F.explode(rows).alias("v")).select("tenant", "v.object_id", "v.parent_id", "revision", F.col("revision").alias("metadata_revision"), "v.content_revision", "v.name", "v.size", "v.mount", "v.provider", "v.tombstone")


def claims(attempts: DataFrame, operation: str, epoch: str) -> DataFrame:
    """Claim attempts (operation, request, expected, committed): an attempt holds if the epoch that it expects is the one
    before it, and no attempt before it has committed. Adds epoch and state."""
    from pyspark.sql import Window

    w = Window.partitionBy(operation).orderBy("request")
    before = F.max(F.col("committed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = (F.row_number().over(w) - 1).cast("long")
    state = F.when(F.coalesce(before, F.lit(0)) == 1, "refused").when(F.col("expected") != n, "stale").when(F.col("committed"), "committed").otherwise("claimed")
    return attempts.withColumn(epoch, n + 1).withColumn("state", state)


def saved_state(known: DataFrame, saves: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """saves (key, expected, columns): applied where the version is the expected one and no column goes back, else why
    not; version is the one after."""
    j = saves.alias("s").join(known.alias("k"), key, "left")
    back = reduce(Column.__or__, [F.coalesce(F.col(f"s.{c}") < F.col(f"k.{c}"), F.lit(False)) for c in columns])
    at = F.coalesce(F.col("k.version"), F.lit(0))
    outcome = F.when(F.col("s.expected") != at, "moved").when(back, "regression").otherwise("saved")
    return j.select(key, outcome.alias("outcome"), (at + F.when(outcome == "saved", 1).otherwise(0)).cast("long").alias("version"))
