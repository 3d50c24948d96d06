"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents come in blocks. With whole-number weights w of sum W, block j of a source is released at slot
floor(j * W / w) and due by slot ceil((j + 1) * W / w); in each slot the released block that is due first runs. At any
slot a source is less than one block off its share. The schedule repeats every W slots, so only one period is worked
out. Sources of one weight have the same windows and take their slots in a row, so a period is a list of stretches, whose
number goes by the sum of the different weights and not by the sources: there may be any number of these. A source that
runs out leaves its slots empty and the others move up, so no document is dropped or repeated.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.llm.common import Stored, packed, stored, unpacked
from revlake.operators.asof import numbered

BLOCK, MOST_BLOCKS, BUCKET = 64, 1_000_000, 8192


def schedule(classes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """classes (weight, sources) to one period's stretches (weight, j, first, till, slot): block j of the class's sources
    number first to till - 1, one a slot from `slot` on. Earliest deadline first; ties to the larger weight."""
    total = sum(w * n for w, n in classes)
    waiting = sorted((j * total // w, -w, j, -(-(j + 1) * total // w), n) for w, n in classes for j in range(w))
    ready: list[list[int]] = []
    out, t, k = [], 0, 0
    while t < total:
        while k < len(waiting) and waiting[k][0] <= t:
            _, minus, j, due, n = waiting[k]
            heapq.heappush(ready, [due, minus, j, 0, n])
            k += 1
        top = ready[0]
        due, minus, j, first, n = top
        run = min(n - first, (waiting[k][0] if k < len(waiting) else total) - t)
        if t + run > due:
            raise ArithmeticError("a block is late")
        out.append((-minus, j, first, first + run, t))
        t += run
        top[3] = first + run  # the order in the heap goes by what stands before
        if top[3] == n:
            heapq.heappop(ready)
    return out


def _before(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over rows of the same `by` with a smaller order (a whole number), over buckets of BUCKET
    orders, so that no task sees more than a bucket of them."""
    bucketed = rows.withColumn("_bucket", F.floor(F.col(order) / BUCKET))
    sums = bucketed.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return bucketed.join(sums, [*by, "_bucket"]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_bucket", "_base")


def mix(docs: DataFrame, weights: dict[str, int], default: int = 1, block: int = BLOCK) -> DataFrame:
    """docs, all columns kept, with block, slot and position (from 0, gapless) added under those names.

    Within a source, documents come in order of their id's md5, equal ones in any order. weights: whole numbers by source;
    `default` for others. Defined cases: rows without a source are a source of their own with the default weight;
    repeated rows are placed one by one; an empty table gives no rows; columns named like the added ones are replaced,
    others may have any names. Weights have to be positive, and different ones to add up to MOST_BLOCKS at most; sources
    may be as many as there are.
    """
    spark = docs.sparkSession
    used = {default, *weights.values()}
    if any(w < 1 for w in used) or sum(used) > MOST_BLOCKS:
        raise ValueError("weights that are not positive, or too large")
    rows = Stored(packed(docs).withColumn("rid", F.monotonically_increasing_id()), "mix-rows").df  # rid is final once stored
    source = F.col("row.source").cast("string")
    of = F.lit(default)
    for name, w in weights.items():
        of = F.when(source == name, w).otherwise(of)
    at = F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary"))
    slim = rows.select("rid", F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("s"), of.cast("long").alias("w"), at.alias("at"))
    # sources by number within their weight, documents by number within their source; a hot one is split by ranges
    sources = stored(numbered(slim.select("s", "w").distinct(), ["w"], ["s"], "i"), "mix-sources")
    classes = [(r.w, r["count"]) for r in sources.groupBy("w").count().collect()]  # as many as there are different weights
    total = sum(w * n for w, n in classes)
    stretches = F.broadcast(spark.createDataFrame(schedule(classes), "w long, j long, first long, till long, start long"))  # 2 * MOST_BLOCKS rows at most
    ranked = stored(numbered(slim.select("rid", "s", "at"), ["s"], ["at", "rid"], "rank").select("rid", "s", F.floor(F.col("rank") / block).alias("block"), (F.col("rank") % block).alias("in")), "mix-ranks")
    blocks = ranked.groupBy("s", "block").agg(F.count("*").alias("n")).join(sources, "s").withColumn("j", F.col("block") % F.col("w"))
    timed = blocks.join(stretches, ["w", "j"]).where("i >= first AND i < till")
    timed = stored(timed.select("s", "block", "n", (F.floor(F.col("block") / F.col("w")) * total + F.col("start") + F.col("i") - F.col("first")).alias("slot")), "mix-slots")
    starts = _before(timed.withColumn("all", F.lit(0)), ["all"], "slot", "n", "before").select("s", "block", "slot", "before")
    placed = ranked.join(starts, ["s", "block"]).select("rid", "block", "slot", (F.col("before") + F.col("in")).alias("position"))
    joined = rows.join(placed.hint("merge"), "rid")
    return joined.select(*unpacked(joined, block=F.col("block"), slot=F.col("slot"), position=F.col("position")))
