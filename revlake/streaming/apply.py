"""Micro-batches of source changes applied to a published table: fold, suppress what is unchanged, commit once.

A batch folds to the newest change of each object; upserts whose fingerprint the table has already are dropped, and the
rest is merged and committed under the batch's own mutation id, so a batch that runs again changes nothing. A batch that
does not continue where the table stands asks for a snapshot, which repair() publishes in place of everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revlake.operators.asof import latest
from revlake.operators.diff import index_merge, unchanged_suppressed
from revlake.plans.store import kept
from revlake.sources.manifest import HeadMoved, Manifest, Table

CHANGE = "object_id string, revision long, action string, fingerprint string, identity string, name string"
SCHEMA = "object_id string, revision long, fingerprint string, identity string, name string"


class SnapshotRequired(RuntimeError):
    pass


def renames(batch: DataFrame, current: DataFrame) -> DataFrame:
    """(old, new) ids of objects that went while their identity came back under another id in the same batch."""
    last = latest(batch, ["object_id"], "revision")
    gone = last.where("action = 'delete'").select("object_id").join(current.select("object_id", "identity"), "object_id").select(F.col("object_id").alias("old"), "identity")
    return gone.join(last.where("action = 'upsert'").select(F.col("object_id").alias("new"), "identity"), "identity").where("old <> new").select("old", "new")


def digest(rows: DataFrame) -> str:
    """Of a set of rows in any order."""
    got = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{got.n}:{got.s}"


def apply_batch(batch: DataFrame, batch_id: int, table: Table, expected_from: int | None = None) -> Manifest:
    """The head after the batch. expected_from: the revision that the batch's oldest change has to follow directly."""
    rows = kept(batch)
    oldest = rows.agg(F.min("revision")).first()[0]
    if expected_from is not None and oldest is not None and oldest != expected_from + 1:
        raise SnapshotRequired(f"the batch begins at {oldest} and not at {expected_from + 1}")
    head = table.head()
    known = head.mutations.get(f"batch-{batch_id}")
    if known:  # the table refuses another digest under a known id
        return table.commit(rows, head, f"batch-{batch_id}", digest(rows))
    current = table.read(head)
    last = latest(rows, ["object_id"], "revision")
    put = unchanged_suppressed(last.where("action = 'upsert'"), current, ["object_id"], "fingerprint").select(*current.columns)
    cut = last.where("action = 'delete'").join(current, "object_id", "left_semi")
    put, cut = kept(put), kept(cut.select("object_id"))
    if not put.limit(1).count() and not cut.limit(1).count():
        return head
    return table.commit(index_merge(current, cut, put, ["object_id"]), head, f"batch-{batch_id}", digest(rows), replace=True)


def repair(snapshot: Callable[[], DataFrame], table: Table, mutation: str, attempts: int = 3) -> Manifest:
    """Publishes a snapshot of all live objects in place of the table; taken again while other commits come between."""
    for _ in range(attempts - 1):
        try:
            return _replace(snapshot(), table, mutation)
        except HeadMoved:
            continue
    return _replace(snapshot(), table, mutation)


def _replace(changes: DataFrame, table: Table, mutation: str) -> Manifest:
    rows = latest(changes, ["object_id"], "revision").where("action = 'upsert'")
    rows = kept(rows.select(*(c.split(" ")[0] for c in SCHEMA.split(", "))))
    return table.commit(rows, table.head(), mutation, digest(rows), replace=True)


def applied(stream: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, i: apply_batch(df, i, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
