"""Latest and as-of views of append-only versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlake.plans.store import kept


def latest(df: DataFrame, keys: list[str], *newest_first: str) -> DataFrame:
    """The newest row of each key; plans as a window group limit, so each task keeps one row a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in newest_first))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of(df: DataFrame, keys: list[str], revision: str, bound: Column | int) -> DataFrame:
    """The newest row of each key at or below bound. Liveness has to be filtered above this, never below."""
    return latest(df.where(F.col(revision) <= bound), keys, revision)


def live(df: DataFrame, tombstone: str = "tombstone") -> DataFrame:
    return df.where(~F.col(tombstone))


def as_of_floor(df: DataFrame, keys: list[str], revision: str, floors: DataFrame, on: str, floor: str) -> DataFrame:
    """As of a bound of the row's own group: floors (on, floor)."""
    return latest(df.join(floors, on).where(F.col(revision) <= F.col(floor)), keys, revision)


def dense_number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers rows of a key from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """As dense_number, for few keys with many rows each: rows are dealt by ranges of (keys, order), numbered within
    their range, and the counts of the ranges before are added, so no task holds a key as a whole."""
    parted = kept(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy(*keys, "_p").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    sizes = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_p").alias("_q"), "_base")
    own = parted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)))
    same = F.col("_p") == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return own.join(sizes, same).withColumn(name, (F.col("_base") + F.col("_n") - 1).cast("long")).select(*df.columns, name)


def lagged(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """Adds the struct of columns of the row before, within a key; for few keys with many rows each. Rows are dealt by
    ranges of (keys, order); the first row of a range takes the last one of the range before."""
    parted = kept(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    lasts = parted.groupBy(*keys, "_p").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    before = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_p")))
    before = before.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_p").alias("_q"), "_carried")
    w = Window.partitionBy(*keys, "_p").orderBy(*order)
    own = parted.withColumn("_own", F.lag(F.struct(*columns)).over(w)).withColumn("_n", F.row_number().over(w))
    same = F.col("_p") == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return own.join(before, same).select(*df.columns, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_own")).alias(name))
