"""Exact top-k by inner product: exhaustive, term at a time.

Vectors become sparse integer rows. Rows are dealt into blocks, whose columns are the postings of a term (row, weight);
queries are dealt into blocks too. For each pair of blocks the terms of the queries are taken one after another, and
each scatters its weighted postings into a dense array of scores (queries x rows); a partition selection keeps the k
best of each query in the block, and the partial results are merged. The work is queries x rows by definition; what one
task holds is one block of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import stored
from revlake.llm.vectors import merged, numbered, top, valid

ROWS, QUERIES, TILE = 4096, 2048, 64


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of integer queries (q, terms) against integer rows (r, terms), term at a time."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    for term in range(rows.shape[1]):
        at = np.flatnonzero(rows[:, term])
        asked = np.flatnonzero(queries[:, term])
        if not len(at) or not len(asked):
            continue
        added = queries[asked, term, None] * rows[at, term]
        if len(at) == len(rows) and len(asked) == len(queries):
            scores += added
        else:
            scores[np.ix_(asked, at)] += added
    return scores


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query by sum of floor(256 * x) products.

    vectors and queries: (vec_id, embedding). A query's own vec_id is no candidate. Defined cases: vectors that are
    null or hold null or non-finite components take no part; vectors of another length than the query are no
    candidates of it; repeated rows are candidates, and queries, one by one; fewer than k candidates give fewer rows; an empty table
    gives none; other columns are not read. Scores have to fit in 64 bits: larger ones raise an error.
    """
    whole = F.transform("v", lambda x: F.floor(x * 256).cast("long"))
    sparse = lambda df: valid(df, zero_too=True).select("vec_id", F.size("v").alias("width"), whole.alias("w"))
    rows, asked = stored(sparse(vectors), "topk-rows"), numbered(sparse(queries), "topk-queries")
    blocks = lambda df, n: max(1, -(-df.count() // n))
    nr, nq = blocks(rows, ROWS), blocks(asked, QUERIES)
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    # each block of rows meets each block of queries: rows go out once for each query block, queries once for each row block
    right = rows.withColumn("rb", deal(nr, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    left = asked.withColumn("qb", deal(nq, 2)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width in sorted(set(q["width"]) & set(r["width"])):
            a, b = q[q["width"] == width], r[r["width"] == width]
            x, y = (np.array(c["w"].tolist(), np.int64).reshape(len(c), width) for c in (a, b))
            if width and np.abs(x).astype(float).max() * np.abs(y).astype(float).max() * width >= 2.0**63:
                raise ArithmeticError("an inner product may not fit in 64 bits")
            ids = b["vec_id"].to_numpy()
            for at in range(0, len(a), TILE):
                scores = accumulate(x[at : at + TILE], y)
                for number, query, s in zip(a["q"].to_numpy()[at : at + TILE], a["vec_id"].to_numpy()[at : at + TILE], scores, strict=True):
                    other = ids != query
                    best = top(s, ids, k) if other.all() else np.flatnonzero(other)[top(s[other], ids[other], k)]
                    out.append(pd.DataFrame({"q": number, "query_id": query, "vec_id": ids[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    partial = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(search, "q long, query_id long, vec_id long, score long")
    return merged(partial, k)
