"""Streaming forms: an exactly-once ledger of event batches, and latest-wins coalescing.

Ledger: foreachBatch writes each micro-batch under its batch id, so a batch that runs again overwrites itself. A batch
record (stream, epoch, cursor) that is known with the same digest is dropped; with another digest the batch fails.
Coalescing: applyInPandasWithState keeps the greatest desired revision of each tenant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["stream", "epoch", "cursor"]


class DigestConflict(RuntimeError):
    pass


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """batch: (stream, epoch, cursor, digest, ...)."""
    spark = batch.sparkSession
    try:
        known = spark.read.option("basePath", path).parquet(path).where(F.col("batch_id") != batch_id).select(*KEY, F.col("digest").alias("_known"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = spark.createDataFrame([], batch.select(*KEY, F.col("digest").alias("_known")).schema)
    one = batch.groupBy(*KEY).agg(F.count_distinct("digest").alias("variants")).where("variants > 1")
    old = batch.join(known, KEY).where(F.col("digest") != F.col("_known"))
    if one.limit(1).count() or old.limit(1).count():
        raise DigestConflict(f"batch {batch_id} repeats a cursor with another digest")
    fresh = batch.dropDuplicates(KEY).join(known, KEY, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ledger(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, i: append_batch(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get[0] if state.exists else -1
    old = best
    for b in batches:
        best = max(best, int(b["revision"].max()))
    if best > old:
        state.update((best,))
        yield pd.DataFrame({"tenant": [key[0]], "desired": [best]})


def coalesced(stream: DataFrame) -> DataFrame:
    """(tenant, revision) to (tenant, desired), emitted whenever a tenant's greatest revision grows."""
    return stream.groupBy("tenant").applyInPandasWithState(_newest, "tenant string, desired long", "desired long", "update", GroupStateTimeout.NoTimeout)
