"""What the operators of this subpackage share: tables, scratch tables, connected components."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local one only where it is unset and the
    executors are on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="revlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/revlake/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile go as soon as it has ended: its result is a table, which nothing has to
    be worked out again for."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Stored:
    """A table written to the shared folder: its lineage ends there, so a lost executor costs one read. drop() once the
    last reader has run; what a lazy result still reads stays, or until sweep() if it was made under a tag."""

    left: ClassVar[dict[str, tuple[SparkSession, str | None]]] = {}

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, label)
        with shuffles_let_go(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.left[self.path] = self.spark, _tag.get()
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        self.left.pop(self.path, None)
        drop(self.spark, self.path)


def stored(df: DataFrame, label: str) -> DataFrame:
    return Stored(df, label).df


_tag: contextvars.ContextVar[str | None] = contextvars.ContextVar("tag", default=None)


@contextlib.contextmanager
def tagged(tag: str) -> Iterator[None]:
    """Scratch tables made meanwhile go with sweep(tag)."""
    token = _tag.set(tag)
    try:
        yield
    finally:
        _tag.reset(token)


def sweep(spark: SparkSession, tag: str) -> None:
    """Drops this session's scratch tables under a tag. For callers who know that every result that reads them has been
    written, such as the stages of a pipeline whose results are Parquet."""
    for path, (owner, made) in list(Stored.left.items()):
        if owner is spark and made == tag:
            Stored.left.pop(path)
            drop(spark, path)


def packed(docs: DataFrame) -> DataFrame:
    """All columns of a row as the one column `row`, whose names then clash with nothing that is put beside it."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"))


def unpacked(rows: DataFrame, **replaced: Column) -> list[Column]:
    """The columns that packed() took in, some of them replaced; new ones come last."""
    names = rows.schema["row"].dataType.names
    own = [replaced.get(c, F.col("row").getField(c)).alias(c) for c in names]
    return own + [v.alias(c) for c, v in replaced.items() if c not in names]


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distributed union-find. nodes (id long), edges (a long, b long, in any direction, repeats allowed) to
    (id, component): the smallest id that can be reached. Nodes without edges are their own component.

    Each round hooks the root of either end of an edge under the smaller root it meets, then halves the paths to
    the roots. Only edges between different roots stay, deduplicated, so a group of n copies given as a star takes
    one round and long chains take O(log n). Rows of a round are written to the shared folder.
    """
    spark = nodes.sparkSession
    ids = nodes.select("id").distinct()
    live = Stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    parent = None
    while live.df.limit(1).count():
        # every root hooks under the least root beside it; hooking goes downwards only, so there are no cycles
        hook = live.df.groupBy("a").agg(F.min("b").alias("up"))
        hooks = Stored(_flatten(hook.select(F.col("a").alias("id"), F.col("up").alias("component"))), "cc-hooks")
        if parent is None:
            merged = hooks
        else:
            up = hooks.df.select(F.col("id").alias("component"), F.col("component").alias("_up"))
            moved = parent.df.join(up, "component", "left").select("id", F.coalesce("_up", "component").alias("component"))
            merged = Stored(moved.unionByName(hooks.df), "cc-parent")
        to = hooks.df
        left = live.df.join(to.select(F.col("id").alias("a"), F.col("component").alias("_ra")), "a", "left")
        both = left.join(to.select(F.col("id").alias("b"), F.col("component").alias("_rb")), "b", "left")
        ends = both.select(F.coalesce("_ra", "a").alias("_x"), F.coalesce("_rb", "b").alias("_y")).where("_x <> _y")
        after = Stored(ends.select(F.greatest("_x", "_y").alias("a"), F.least("_x", "_y").alias("b")).distinct(), "cc-edges")
        for old in {live, parent, hooks} - {None, merged}:
            old.drop()
        live, parent = after, merged
    live.drop()
    if parent is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(parent.df, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _flatten(hooks: DataFrame) -> DataFrame:
    """Follows each hook to the end of its chain (path doubling)."""
    now = Stored(hooks, "cc-chain")
    while True:
        up = now.df.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        after = Stored(now.df.join(up, "component", "left").select("id", F.coalesce("_up", "component").alias("component"), F.col("_up").isNotNull().alias("_moved")), "cc-chain")
        now.drop()
        now = after
        if not now.df.where("_moved").limit(1).count():
            return now.df.select("id", "component")


def crc32_of_id(column: str) -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
