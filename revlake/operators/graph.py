"""Lineage closures and trees by frontier joins; frontiers are written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.plans.store import kept


def closure(edges: DataFrame, roots: DataFrame, most: int = 10_000) -> DataFrame:
    """edges (child, parent), roots (node): (node, depth) of all that roots reach upwards. Visited nodes are dropped
    from the frontier, so cycles end; each round joins the frontier alone. What has been seen grows
    with the tables and is joined by merging, so it never goes through the driver."""
    seen = kept(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.select(F.col("node").alias("child")).join(edges, "child").select(F.col("parent").alias("node")).where("node is not null").distinct()
        frontier = kept(step.join(seen.hint("merge"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)
    raise RecursionError(f"more than {most} rounds")


def ancestors(edges: DataFrame) -> DataFrame:
    """edges (child, parent) of a forest to (child, parent, distance) of all ancestors, by path doubling: each round joins
    the paths of up to d links with each other, so chains of n links take log2(n) rounds. Cycles raise an error."""
    paths = kept(edges.where("parent is not null").select("child", "parent").distinct().withColumn("distance", F.lit(1)))
    longest, most = 1, 1 << 40
    while True:
        tails = paths.select(F.col("child").alias("parent"), F.col("parent").alias("far"), F.col("distance").alias("more"))
        # a path of `longest` links goes on, by each known path of its end
        onward = paths.where(F.col("distance") == longest).join(tails, "parent").select("child", F.col("far").alias("parent"), (F.col("distance") + F.col("more")).alias("distance"))
        onward = kept(onward)
        if not onward.limit(1).count():
            return paths
        if onward.where("child = parent").limit(1).count() or longest > most:
            raise RecursionError("the edges have a cycle")
        paths, longest = kept(paths.unionByName(onward)), longest * 2


def lineage(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) along predecessor chains, each child with one parent at most. Path doubling: every node's jump goes
    twice as far each round, and the reached nodes grow by what their jumps reach, so a chain of n links takes log2(n)
    joins of tables written once."""
    # merge joins: frontiers and jumps grow with the tables, so none of them goes through the driver
    jumps = kept(edges.where("parent is not null").select("child", "parent").distinct())
    reached = kept(roots.select("node", F.lit(0).alias("depth")))
    step = 1
    while True:
        more = kept(reached.join(jumps.hint("merge"), reached["node"] == jumps["child"]).select(F.col("parent").alias("node"), (F.col("depth") + step).alias("depth")))
        if not more.limit(1).count():
            return reached
        if step > 1 << 40:
            raise RecursionError("the edges have a cycle")
        reached = kept(reached.unionByName(more).groupBy("node").agg(F.min("depth").alias("depth")))
        far = jumps.select(F.col("child").alias("parent"), F.col("parent").alias("far")).hint("merge")
        jumps, step = kept(jumps.join(far, "parent").select("child", F.col("far").alias("parent"))), step * 2


def unreachable(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Orphans and members of cycles."""
    return nodes.join(seen, "node", "left_anti")


def child_count(live: DataFrame, parent: str) -> DataFrame:
    return live.groupBy(parent).agg(F.count("*").alias("children"))


def resolve(requests: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """requests (request, parts array, at), entries (parent, name, node): one join a path level; misses drop out."""
    for level in range(depth):
        step = requests.where(F.size("parts") > level).withColumn("name", F.get("parts", F.lit(level)))
        done = requests.where(F.size("parts") <= level)
        requests = step.join(entries.withColumnRenamed("parent", "at"), ["at", "name"]).select("request", "parts", F.col("node").alias("at")).unionByName(done.select("request", "parts", "at"))
    return requests
