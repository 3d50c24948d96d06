"""Keyset pages, byte-bounded pages and the checks of page order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.operators.asof import lagged


class StaleAnchorError(ValueError):
    def __init__(self, anchor: int, floor: int):
        super().__init__(f"anchor {anchor} is outside of what is kept from {floor} on")
        self.anchor, self.floor = anchor, floor


def check_anchor(anchor: int, floor: int, head: int) -> None:
    """An anchor equal to the floor or the head is valid."""
    if not floor <= anchor <= head:
        raise StaleAnchorError(anchor, floor)


def keyset(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next rows after an exclusive cursor, with one row of look-ahead (top-k, no global sort)."""
    if after is not None:
        df = df.where(F.struct(*keys) > F.struct(*(F.lit(x).cast(df.schema[k].dataType).alias(k) for k, x in zip(keys, after, strict=True))))
    return df.orderBy(*keys).limit(limit + 1)


def page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> tuple[list, tuple | None]:
    """(rows, next cursor or None) for callers on the driver; a page is bounded by limit."""
    rows = keyset(df, keys, after, limit).collect()
    return rows[:limit], tuple(rows[limit - 1][k] for k in keys) if len(rows) > limit else None


def byte_bounded(df: DataFrame, key: str, size: str, cap: int, limit: int, group: list[str]) -> DataFrame:
    """Rows of each group in order of key while their sizes stay within cap; the first row always comes, limit rows at most."""
    w = Window.partitionBy(*group).orderBy(key)
    out = df.withColumn("running_bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).withColumn("_rn", F.row_number().over(w))
    return out.where(((F.col("running_bytes") <= cap) | (F.col("_rn") == 1)) & (F.col("_rn") <= limit)).drop("_rn")


def order_violations(df: DataFrame, group: list[str], arrival: str, keys: list[str], few_groups: bool = False) -> DataFrame:
    """Rows that don't come strictly after the one before them. few_groups: groups are few and large, so each is checked
    in ranges of the arrival."""
    if few_groups:
        rows = lagged(df, group, [arrival], keys, "_before")
    else:
        rows = df.withColumn("_before", F.lag(F.struct(*keys)).over(Window.partitionBy(*group).orderBy(arrival)))
    return rows.where(F.col("_before").isNotNull() & ~(F.struct(*keys) > F.col("_before"))).drop("_before")


def keyed_lookup(request: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Request order (position) and absences are kept."""
    return request.join(target.withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))
