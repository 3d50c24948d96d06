"""What the two vector searches share: valid vectors, row blocks, and the merge of partial results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.llm.common import stored


def valid(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """(vec_id, v array<double>) of vectors without null or non-finite components; zero vectors only with zero_too."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    return rows if zero_too else rows.where(F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as a matrix."""
    return np.array(column.tolist(), np.float64)


def numbered(queries: DataFrame, label: str) -> DataFrame:
    """Queries with a number `q`, as rows may repeat: each is a query of its own. Numbers are final once stored."""
    return stored(queries.withColumn("q", F.monotonically_increasing_id()), label)


def merged(partial: DataFrame, k: int) -> DataFrame:
    """The k best of each query row (q) from partial results: score descending, then vec_id."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: partition selection, then ties at the border in order of id."""
    if len(scores) > k:
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= border)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
