"""Latest-wins delivery queues, fair tickets and waiters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.operators.asof import latest
from revlake.plans.store import kept


def claimable(queue: DataFrame, presentation: str, revision: str, state: str, window: int, flying: tuple[str, ...]) -> DataFrame:
    """The one delivery to claim now, or none: of presentations with nothing in flight the newest pending row, the oldest
    such revision first (then by presentation), as long as fewer than `window` deliveries are in flight at all."""
    busy = queue.where(F.col(state).isin(*flying))
    full = busy.limit(window).agg((F.count("*") >= window).alias("_full"))  # one row
    newest = latest(queue.where(F.col(state) == "pending"), [presentation], revision)
    free = newest.join(busy.select(presentation).distinct(), presentation, "left_anti")
    return free.orderBy(revision, presentation).limit(1).join(F.broadcast(full)).where("not _full").drop("_full")


def superseded(queue: DataFrame, presentation: str, revision: str, state: str) -> DataFrame:
    """Pending rows below the newest of their presentation become superseded."""
    top = F.max(revision).over(Window.partitionBy(presentation))
    return queue.withColumn("new_state", F.when((F.col(state) == "pending") & (F.col(revision) < top), "superseded").otherwise(F.col(state)))


def expired(queue: DataFrame, deadline: str, now, state: str, flying: tuple[str, ...]) -> DataFrame:
    return queue.where(F.col(state).isin(*flying) & (F.col(deadline) <= F.lit(now)))


def coalesced(requests: DataFrame, tenant: str, desired: str, applied: DataFrame) -> DataFrame:
    """Latest desired revision of each tenant and how many waiters its applied revision releases."""
    last = requests.groupBy(tenant).agg(F.max(desired).alias("latest_desired"))
    freed = requests.join(applied, tenant).where(F.col(desired) <= F.col("applied")).groupBy(tenant).agg(F.count("*").alias("released"))
    return last.join(freed, tenant, "left").withColumn("released", F.coalesce("released", F.lit(0)))


def tickets(queue: DataFrame, order: str, base: int) -> DataFrame:
    """Dense tickets after base, without a single-partition window: counts of range partitions, then numbers within."""
    parted = queue.repartitionByRange(order).withColumn("_p", F.spark_partition_id())

    parted = kept(parted)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("_p").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    numbered = parted.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return numbered.join(F.broadcast(sizes), "_p").withColumn("ticket", (F.col("_base") + F.col("_n") + base).cast("long")).drop("_p", "_n", "_base")


def rotated(queue: DataFrame, ticket: str, batch: int) -> DataFrame:
    """Fair rotation: the `batch` lowest tickets are served and go to the end with new ones after the highest, in their
    order. Adds served and new_ticket."""
    served = queue.orderBy(ticket).limit(batch).withColumn("_turn", F.row_number().over(Window.orderBy(ticket)))  # batch rows
    top = queue.agg(F.max(ticket).alias("_top"))
    turns = F.broadcast(served.select(F.col(ticket).alias("_ticket"), "_turn"))
    rows = queue.join(turns, F.col(ticket) == F.col("_ticket"), "left").join(F.broadcast(top))
    served_now = F.col("_turn").isNotNull()
    return rows.select(*queue.columns, served_now.alias("served"), F.when(served_now, F.col("_top") + F.col("_turn")).otherwise(F.col(ticket)).cast("long").alias("new_ticket"))


def recovered(queue: DataFrame, owners: DataFrame, owner: str, state: str, flying: tuple[str, ...]) -> DataFrame:
    """What was in flight under an owner that is no more has an unknown outcome and is never sent again."""
    alive = owners.select(owner).distinct().withColumn("_alive", F.lit(True))
    lost = F.col(state).isin(*flying) & F.col("_alive").isNull()
    return queue.join(alive, owner, "left").withColumn("new_state", F.when(lost, "unknown").otherwise(F.col(state))).drop("_alive")


def not_included(causes: DataFrame, activations: DataFrame) -> DataFrame:
    """activations (presentation, activation, revision), causes (activation, cause): (presentation, newer, missing) of the
    newest activation of each presentation that lacks causes of older ones."""
    newest = latest(activations, ["presentation"], "revision").select("presentation", F.col("activation").alias("newer"), F.col("revision").alias("_top"))
    older = activations.join(newest, "presentation").where(F.col("revision") < F.col("_top")).select("presentation", "newer", "activation")
    wanted = older.join(causes, "activation").select("presentation", "newer", "cause").distinct()
    had = causes.select(F.col("activation").alias("newer"), "cause").distinct()
    return wanted.join(had, ["newer", "cause"], "left_anti").groupBy("presentation", "newer").agg(F.count("*").alias("missing"))
