"""Event inbox in batch form: ordinals, gaps, quotas, watermarks, echoes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, group: list[str], sequence: str) -> DataFrame:
    """Rows whose predecessor is missing."""
    before = F.lag(sequence).over(Window.partitionBy(*group).orderBy(sequence))
    return df.withColumn("expected", (before + 1).cast("long")).where(F.col("expected").isNotNull() & (F.col(sequence) != F.col("expected")))


def quota(df: DataFrame, group: str, rows: int, size: str, most_bytes: int) -> DataFrame:
    """Row and byte sums of each inbox and whether it overflows (then it is dropped and a snapshot is required)."""
    out = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.sum(size).cast("long").alias("n_bytes"))
    return out.withColumn("overflow", (F.col("n_rows") > rows) | (F.col("n_bytes") > most_bytes))


def contiguous_watermark(inbox: DataFrame, checkpoints: DataFrame, group: str, stream: str, stored: DataFrame | None = None) -> DataFrame:
    """Least unapplied sequence less one, else the last received; never below the stored one (group, floor)."""
    j = inbox.join(checkpoints, [group, stream], "left")
    pending = F.when(F.coalesce(F.col("applied"), F.lit(-1)) < F.col("through"), F.col("sequence"))
    out = j.groupBy(group).agg(F.coalesce(F.min(pending) - 1, F.max("sequence")).cast("long").alias("watermark"))
    if stored is None:
        return out
    return out.join(stored, group, "left").select(group, F.greatest("watermark", "floor").cast("long").alias("watermark"))


def next_record(inbox: DataFrame, checkpoints: DataFrame, group: str, stream: str) -> DataFrame:
    """First unapplied record of each group."""
    rows = inbox.join(checkpoints, [group, stream], "left").where(F.coalesce("applied", F.lit(-1)) < F.col("through"))
    return rows.groupBy(group).agg(F.min_by(F.struct("sequence", stream), "sequence").alias("r")).select(group, "r.*")


def echoes(events: DataFrame, operations: DataFrame, path: str, width: int = 1024) -> DataFrame:
    """Operations all of whose effects were seen within (start, stop]. Sequences are cut into stretches of `width`, and an
    operation's window into those that it meets, so the join goes by (path, stretch) and a hot path is split."""
    rows = events.withColumn("_cut", F.floor(F.col("sequence") / width))
    spread = operations.withColumn("_cut", F.explode(F.sequence(F.floor((F.col("start") + 1) / width), F.floor(F.greatest("start", "stop") / width))))
    seen = spread.join(rows, [path, "_cut"]).where((F.col("sequence") > F.col("start")) & (F.col("sequence") <= F.col("stop")))
    counts = seen.groupBy("op").agg(F.count_distinct(path).alias("seen"))
    wanted = operations.groupBy("op").agg(F.count_distinct(path).alias("wanted"))
    return wanted.join(counts, "op", "left").select("op", "wanted", F.coalesce("seen", F.lit(0)).alias("seen"), (F.coalesce("seen", F.lit(0)) == F.col("wanted")).alias("matched"))


def settlements(requests: DataFrame, inbox: DataFrame, checkpoints: DataFrame, group: str, stream: str) -> DataFrame:
    """requests (group, sequence, operation), inbox with predecessor, through and the operation that settled it or null:
    advance (the applied event is the record's predecessor), replay (applied already, by this operation) or conflict."""
    rows = requests.join(inbox.select(group, "sequence", stream, "predecessor", "through", F.col("operation").alias("_by")), [group, "sequence"], "left").join(checkpoints, [group, stream], "left")
    applied = F.coalesce("applied", F.lit(-1))
    other = F.col("_by").isNotNull() & (F.col("_by") != F.col("operation"))
    outcome = F.when(F.col("through").isNull(), "conflict").when(applied >= F.col("through"), F.when(F.col("_by").eqNullSafe(F.col("operation")), "replay").otherwise("conflict")).when((applied != F.col("predecessor")) | other, "conflict").otherwise("advance")
    return rows.select(group, "sequence", "operation", outcome.alias("outcome"), F.when(outcome == "advance", F.col("through")).otherwise(F.col("applied")).alias("applied"))


def collectable(inbox: DataFrame, checkpoints: DataFrame, expectations: DataFrame, group: str, stream: str) -> DataFrame:
    """Records whose stream has applied them, of groups without open expectations."""
    done = inbox.join(checkpoints, [group, stream]).where(F.col("applied") >= F.col("through"))
    return done.join(expectations.select(group).distinct(), group, "left_anti")


def collapsed(events: DataFrame, batch: list[str], event: str, most: int) -> DataFrame:
    """One row a batch of more than `most` events: rescan at its largest event; the events themselves of the others."""
    sizes = events.groupBy(*batch).agg(F.count("*").alias("_n"), F.max(event).alias("_cursor"))
    over = sizes.where(F.col("_n") > most).select(*batch, F.col("_cursor").alias(event), F.lit("rescan").alias("kind"))
    small = events.join(sizes.where(F.col("_n") <= most).select(*batch), batch, "left_semi").select(*batch, event, F.lit("event").alias("kind"))
    return over.unionByName(small)


def discontinuities(batches: DataFrame, stream: list[str], cursor: str, epoch: str) -> DataFrame:
    """Batches whose event ids went back, or whose root is another than before: the cursor starts again at zero."""
    w = Window.partitionBy(*stream).orderBy("arrival")
    wrapped, changed = F.col(cursor) < F.lag(cursor).over(w), F.col(epoch) != F.lag(epoch).over(w)
    rows = batches.withColumn("reason", F.when(changed, "root_changed").when(wrapped, "ids_wrapped"))
    return rows.where("reason is not null").withColumn("restart", F.lit(0).cast("long"))


def covered(fences: DataFrame, checkpoints: DataFrame, group: str, stream: str) -> DataFrame:
    """Groups whose applied events cover the fence of every stream."""
    rows = fences.join(checkpoints, [group, stream], "left")
    return rows.groupBy(group).agg(F.bool_and(F.coalesce("applied", F.lit(-1)) >= F.col("fence")).alias("reached"))
