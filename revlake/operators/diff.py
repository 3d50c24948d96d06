"""Snapshot and delta diffs, merges and the change events they emit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.operators.asof import latest


def same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def after_image(staged: DataFrame, current: DataFrame, key: list[str], metadata: list[str], content: list[str], revision: int) -> DataFrame:
    """Staged rows with metadata_revision and content_revision carried forward from the current row where nothing of
    the group changed, else the new revision; changed tells whether anything did. A row without a current one is new."""
    j = staged.alias("staged").join(current.withColumn("_there", F.lit(True)).alias("current"), key, "left")
    there = F.col("_there").isNotNull()
    keep_meta, keep_content = there & same("staged", "current", metadata), there & same("staged", "current", content)
    rev = F.lit(revision).cast("long")
    return j.select(
        *key,
        *(F.col(f"staged.{c}").alias(c) for c in [*metadata, *content]),
        F.when(keep_meta, F.col("current.metadata_revision")).otherwise(rev).alias("metadata_revision"),
        F.when(keep_content, F.col("current.content_revision")).otherwise(rev).alias("content_revision"),
        (~(keep_meta & keep_content)).alias("changed"),
    )


def change_events(before: DataFrame, after: DataFrame, key: list[str], parent: str, visible: list[str], changed: Column) -> DataFrame:
    """Deletes where an object vanished, lost a presentation or moved; upserts where it changed; for each presentation.
    One full outer join, of whose rows each explodes into its events."""
    j = before.alias("old").join(after.alias("new"), key, "full_outer")
    events = []
    for n, v in enumerate(visible):
        old, new = F.coalesce(F.col(f"old.{v}"), F.lit(False)), F.coalesce(F.col(f"new.{v}"), F.lit(False))
        moved = ~F.col(f"old.{parent}").eqNullSafe(F.col(f"new.{parent}"))
        event = lambda side, kind: F.struct(F.lit(n).alias("presentation"), F.col(f"{side}.{parent}").alias("scope_parent"), F.lit(kind).alias("kind"))  # noqa: E731, B023
        events += [F.when(old & (~new | moved), event("old", "delete")), F.when(new & (~old | moved | changed), event("new", "upsert"))]
    return j.select(*key, F.explode(F.array_compact(F.array(*events))).alias("e")).select(*key, "e.*")


def working_set_events(before: DataFrame, after: DataFrame, key: list[str], parent: str, visible: str, changed: Column, containers: DataFrame) -> DataFrame:
    """The events of materialised containers (tenant, domain, container_id): of each changed or vanished object in its old
    container, a delete if it is gone or invisible there, else an upsert; an upsert in the new container of what has come
    to it or to sight. One outer join, then one join with the containers for both kinds."""
    j = before.alias("old").join(after.alias("new"), key, "full_outer")
    old, new = F.coalesce(F.col(f"old.{visible}"), F.lit(False)), F.coalesce(F.col(f"new.{visible}"), F.lit(False))
    was, there = F.col("old.revision").isNotNull(), F.col("new.revision").isNotNull()
    moved = ~F.col(f"old.{parent}").eqNullSafe(F.col(f"new.{parent}"))
    event = lambda side, kind, revision: F.struct(F.col(f"{side}.{parent}").alias("container_id"), kind.alias("kind"), revision.alias("object_revision"))
    gone = ~there | ~new
    first = F.when(was & (~there | changed) & (old | new), event("old", F.when(gone, F.lit("delete")).otherwise(F.lit("upsert")), F.when(gone, F.col("old.revision")).otherwise(F.col("new.revision"))))
    second = F.when(there & changed & new & (~was | ~old | moved), event("new", F.lit("upsert"), F.col("new.revision")))
    tenant = F.coalesce(F.col("old.tenant"), F.col("new.tenant"))
    rows = j.select(*key, tenant.alias("tenant"), F.explode(F.array_compact(F.array(first, second))).alias("e")).select(*key, "tenant", "e.*")
    return rows.join(containers, ["tenant", "container_id"])


def promoted(before: DataFrame, after: DataFrame, key: list[str], changed: Column, revision: int) -> DataFrame:
    """Version rows that a promoted snapshot appends: an invisible tombstone of each live object that vanished, and the
    new row of each that changed."""
    names = before.columns
    j = before.where("not tombstone").alias("old").join(after.alias("new"), key, "full_outer")
    gone = F.col("new.revision").isNull()
    fixed = {"revision": F.lit(revision).cast("long"), "mount": F.lit(False), "provider": F.lit(False), "tombstone": F.lit(True)}
    return j.where(gone | changed).select(*key, *(F.when(gone, fixed.get(c, F.col(f"old.{c}"))).otherwise(F.col(f"new.{c}")).alias(c) for c in names if c not in key))


def folded(current: DataFrame, appended: DataFrame, key: list[str]) -> DataFrame:
    """The current view after versions were appended."""
    return current.join(appended.select(*key), key, "left_anti").unionByName(appended.select(*current.columns))


def set_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one only, with the side."""
    return a.subtract(b).withColumn("side", F.lit("removed")).unionByName(b.subtract(a).withColumn("side", F.lit("added")))


def merge_latest(baseline: DataFrame, staged: DataFrame, key: list[str], sequence: str, action: str) -> DataFrame:
    """The newest staged action of each key decides: delete drops the key, upsert replaces it; other keys stay."""
    last = latest(staged, key, sequence)
    kept = baseline.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.where(F.col(action) == "upsert").select(*kept.columns))


def index_merge(old: DataFrame, deletes: DataFrame, upserts: DataFrame, key: list[str]) -> DataFrame:
    gone = deletes.select(*key).unionByName(upserts.select(*key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(upserts.select(*old.columns))


def plan_conflicts(plans: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Keys that plans want differently."""
    return plans.groupBy(*key).agg(F.count_distinct(payload).alias("variants")).where("variants > 1")


def unchanged_suppressed(staged: DataFrame, known: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """Staged rows whose fingerprint differs from the known one, or is new."""
    old = known.select(*key, F.col(fingerprint).alias("_old"))
    return staged.join(old, key, "left").where(~F.col(fingerprint).eqNullSafe(F.col("_old"))).drop("_old")


def causal_partition(plan: DataFrame, external: DataFrame, provider: DataFrame) -> DataFrame:
    """plan (logical, input, by_provider), changed inputs of either side: a logical is the provider's doing if only the
    provider's plan has it, an input of it changed on the provider's side, and none did on the other."""
    hit = lambda paths, name: paths.select("input").distinct().withColumn(name, F.lit(True))
    rows = plan.join(hit(external, "_e"), "input", "left").join(hit(provider, "_p"), "input", "left")
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return rows.groupBy("logical").agg((any_of("_p") & ~any_of("_e") & F.bool_and("by_provider")).alias("provider_caused"))


def prepared_conflicts(prepared: DataFrame, foreign: DataFrame, after: DataFrame) -> DataFrame:
    """(object_id, problem) of prepared rows against live objects of others: a tombstone that still has a live child, a
    name that is taken, a parent that is not live afterwards."""
    dead, alive = prepared.where("tombstone"), prepared.where("not tombstone")
    child = foreign.select("tenant", F.col("parent_id").alias("object_id"))
    taken = foreign.where("mount").select("tenant", "parent_id", "name")
    parents = after.select("tenant", F.col("object_id").alias("parent_id"))
    found = [(dead.join(child, ["tenant", "object_id"], "left_semi"), "live_child"), (alive.where("mount").join(taken, ["tenant", "parent_id", "name"], "left_semi"), "name_taken"), (alive.join(parents, ["tenant", "parent_id"], "left_anti"), "no_parent")]
    return reduce(DataFrame.unionByName, [df.select("object_id", F.lit(problem).alias("problem")) for df, problem in found])
