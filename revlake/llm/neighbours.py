"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (TRAIN vectors, by hash) and every row is put in a leaf, so the tree's size is
bounded and the leaves' grow with the input. A query walks the tree through a priority queue of branches by distance
to their centres, which orders all leaves for it. How many leaves are visited is calibrated: for a sample of queries
the true neighbours are found by brute force, and the visits are widened until the wanted share of them lies in the
visited leaves. Visited leaves are scored exactly, in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import stored
from revlake.llm.vectors import matrix, merged, numbered, top, valid

TRAIN, BRANCH, LEAF_SAMPLE, MOST_LEAVES = 20_000, 12, 96, 4096
CALIBRATE, BLOCK = 192, 2048


@dataclass
class Tree:
    """Nodes by number: the children's numbers and centres, or the leaf's number."""

    children: dict[int, list[int]]
    centres: dict[int, np.ndarray]
    leaf: dict[int, int]

    def assign(self, v: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector."""
        out = np.zeros(len(v), np.int64)
        todo = [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = (v[rows] @ self.centres[node].T - 0.5 * (self.centres[node] ** 2).sum(1)).argmax(1)
                todo += [(c, rows[near == j]) for j, c in enumerate(self.children[node])]
        return out

    def order(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves of a unit vector, best bin first: `most` of them, and more until they hold `least` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or sizes is not None and held < least):
            _, node = heapq.heappop(queue)
            while node not in self.leaf:
                d = ((self.centres[node] - q) ** 2).sum(1)
                best = int(d.argmin())
                for j, c in enumerate(self.children[node]):
                    if j != best:
                        heapq.heappush(queue, (float(d[j]), c))
                node = self.children[node][best]
            out.append(self.leaf[node])
            held += int(sizes[self.leaf[node]]) if sizes is not None else 0
        return out


def fit(sample: np.ndarray, seed: int = 4, rounds: int = 8) -> Tree:
    """Hierarchical k-means of unit vectors, splitting while a node holds over LEAF_SAMPLE of them."""
    rng = np.random.default_rng(seed)
    tree = Tree({}, {}, {})
    todo, number = [(0, sample)], 1
    while todo:
        node, v = todo.pop(0)
        distinct = np.unique(v, axis=0) if len(v) > LEAF_SAMPLE else v
        if len(v) <= LEAF_SAMPLE or len(distinct) <= BRANCH or len(tree.leaf) + len(todo) + BRANCH > MOST_LEAVES:
            tree.leaf[node] = len(tree.leaf)
            continue
        c = distinct[rng.choice(len(distinct), BRANCH, replace=False)]
        for _ in range(rounds):
            near = (v @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
            c = np.array([v[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        near = (v @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        used = [j for j in range(len(c)) if (near == j).any()]
        if len(used) < 2:
            tree.leaf[node] = len(tree.leaf)
            continue
        tree.centres[node] = c[used]
        tree.children[node] = list(range(number, number + len(used)))
        number += len(used)
        todo += [(n, v[near == j]) for n, j in zip(tree.children[node], used, strict=True)]
    return tree


def units(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(1, keepdims=True)
    w = v / big  # so that neither very large nor very small components overflow
    return w / np.sqrt((w * w).sum(1, keepdims=True))


class Best:
    """The k best rows of each of some queries so far. A matrix product finds who can be among them; the scores
    themselves are summed row by row, so equal vectors get equal scores wherever they stand."""

    def __init__(self, numbers: np.ndarray, queries: np.ndarray, k: int):
        self.numbers, self.queries, self.k = numbers, queries, k
        self.score = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, uq: np.ndarray, ids: np.ndarray, uv: np.ndarray) -> None:
        """Unit vectors of the queries at these places, and rows for each of them."""
        if not len(ids) or not len(at):
            return
        rough = uq @ uv.T
        rough[self.queries[at][:, None] == ids[None, :]] = -np.inf
        m, tied = self.k + 3, []
        if len(ids) > m:
            pick = np.argpartition(rough, len(ids) - m, axis=1)[:, -m:]
            values = np.sort(np.take_along_axis(rough, pick, 1), 1)
            # equal ones beyond the m picked can matter: those queries look at all that tie
            tied = np.flatnonzero((values[:, 0] >= values[:, -self.k] - 1e-9) & (values[:, -self.k] > -np.inf))
        else:
            pick = np.broadcast_to(np.arange(len(ids)), (len(at), len(ids)))
        exact = (uv[pick] * uq[:, None, :]).sum(2)
        exact[np.take_along_axis(rough, pick, 1) == -np.inf] = -np.inf
        names = np.where(exact == -np.inf, np.iinfo(np.int64).max, ids[pick])
        before = self.score[at].copy(), self.ids[at].copy()
        self._merge(at, exact, names)
        for j in tied:
            r = rough[j]
            keep = np.flatnonzero((r >= np.partition(r, len(r) - self.k)[len(r) - self.k] - 1e-9) & (r > -np.inf))
            exact = (uv[keep] * uq[j]).sum(1)
            chosen = top(exact, ids[keep], self.k)
            self.score[at[j]], self.ids[at[j]] = before[0][j], before[1][j]
            self._merge(at[j : j + 1], exact[None, chosen], ids[keep][None, chosen])

    def _merge(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[at], score], 1), np.concatenate([self.ids[at], ids], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def frame(self) -> pd.DataFrame:
        q, j = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"q": self.numbers[q], "query_id": self.queries[q], "vec_id": self.ids[q, j], "score": self.score[q, j]})


PARTIAL = "q long, query_id long, vec_id long, score double"


def _truth(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded set of queries: each batch of rows keeps its k best, then they are merged."""
    asked = rows.sparkSession.sparkContext.broadcast((q_ids, q))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best = Best(np.arange(len(asked.value[0])), asked.value[0], k)
                best.add(np.arange(len(asked.value[0])), asked.value[1], b["vec_id"].to_numpy(), units(matrix(b["v"])))
                yield best.frame()

    return merged(rows.select("vec_id", "v").mapInPandas(search, PARTIAL), k)


def _all_pairs(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exhaustive search among vectors of the same length, in pairs of blocks."""
    blocks = lambda df: max(1, -(-df.count() // BLOCK))
    nr, nq = blocks(rows), blocks(asked)
    deal = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by = ["width", "rb", "qb"]
    left = asked.withColumn("width", F.size("v")).withColumn("qb", deal(nq)).withColumn("rb", spread(nr))
    right = rows.withColumn("width", F.size("v")).withColumn("rb", deal(nr)).withColumn("qb", spread(nq))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best = Best(a["q"].to_numpy(), a["vec_id"].to_numpy(), k)
        if len(a) and len(b):
            uq, uv, ids = units(matrix(a["v"])), units(matrix(b["v"])), b["vec_id"].to_numpy()
            for j in range(0, len(a), 512):
                at = np.arange(j, min(j + 512, len(a)))
                best.add(at, uq[at], ids, uv)
        return best.frame()

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, PARTIAL)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score of about the k nearest rows of each query by cosine.

    vectors and queries: (vec_id, embedding); a query's own vec_id is no candidate. Defined cases: vectors that are
    null, zero, or hold null or non-finite components take no part; a query's candidates are the vectors of its length,
    and those of another length than the table's most usual one are searched exhaustively among themselves; repeated
    rows are candidates, and queries, one by one; ties go to the smaller vec_id; fewer than k candidates give fewer rows;
    an empty table gives none; other columns are not read.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    every, wanted = valid(vectors, zero_too=False), numbered(valid(queries, zero_too=False), "hkm-queries")
    usual = every.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if usual is None:
        return spark.createDataFrame([], result)
    whole, asked = (df.where(F.size("v") == usual.width) for df in (every, wanted))
    odd = wanted.where(F.size("v") != usual.width)
    rest = _all_pairs(every.where(F.size("v") != usual.width), odd, k) if odd.limit(1).count() else None
    by_hash = lambda df, salt, n: df.select(F.xxhash64("vec_id", F.lit(salt)).alias("at"), "vec_id", "v").orderBy("at", "vec_id").limit(n).toPandas()
    trial = by_hash(asked, 2, CALIBRATE)
    if not len(trial):
        return merged(rest, k) if rest else spark.createDataFrame([], result)
    tree = spark.sparkContext.broadcast(fit(units(matrix(by_hash(whole, 1, TRAIN)["v"]))))
    leaves = len(tree.value.leaf)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.value.assign(units(matrix(b.to_pandas()["v"]))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], names=["leaf", "vec_id", "v"])

    rows = stored(whole.mapInArrow(index, "leaf long, vec_id long, v array<double>"), "hkm-rows")
    ids, q = trial["vec_id"].to_numpy(), matrix(trial["v"])
    found = _truth(rows, ids, units(q), k).select("query_id", "vec_id").distinct()
    # rows of one vec_id may lie in several leaves: one of them stands for it, so at most CALIBRATE * k rows come back
    truth = found.join(rows.select("vec_id", "leaf"), "vec_id").groupBy("query_id", "vec_id").agg(F.min("leaf").alias("leaf")).collect()
    place = {i: {leaf: n for n, leaf in enumerate(tree.value.order(u, leaves))} for i, u in zip(ids.tolist(), units(q), strict=True)}
    ranks = np.sort([place[r.query_id][r.leaf] for r in truth])
    visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1

    # shards of about BLOCK rows: several small leaves, or one of the blocks of a leaf with very many rows
    sizes = {r.leaf: r["count"] for r in rows.groupBy("leaf").count().collect()}  # MOST_LEAVES rows at most
    first, blocks, shard, filled = np.zeros(leaves, np.int64), np.ones(leaves, np.int64), 0, 0
    for leaf, count in sorted(sizes.items()):
        if filled and filled + count > BLOCK:
            shard, filled = shard + 1, 0
        first[leaf], blocks[leaf] = shard, -(-count // BLOCK)
        shard, filled = (shard + int(blocks[leaf]), 0) if count > BLOCK else (shard, filled + count)
    held = np.array([sizes.get(i, 0) for i in range(leaves)], np.int64)
    places = spark.sparkContext.broadcast((first, blocks, held))
    shards = F.broadcast(spark.createDataFrame([(i, int(first[i]), int(blocks[i])) for i in range(leaves)], "leaf long, first long, blocks long"))
    right = rows.join(shards, "leaf").select((F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks"))).alias("shard"), "leaf", "vec_id", "v")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, blocks, held = places.value
        for b in batches:
            if not b.num_rows:
                continue
            row, shard, asked = [], [], []
            for i, x in enumerate(units(matrix(b.to_pandas()["v"]))):
                wanted: dict[int, list[int]] = {}
                for leaf in tree.value.order(x, visits, held, k + 1):
                    for s in range(first[leaf], first[leaf] + blocks[leaf]):
                        wanted.setdefault(s, []).append(leaf)
                row += [i] * len(wanted)
                shard += wanted.keys()
                asked += wanted.values()
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(asked, pa.list_(pa.int64())), *(c.take(pa.array(row, pa.int64())) for c in b.columns)], names=["shard", "leaves", "q", "vec_id", "v"])

    left = asked.select("q", "vec_id", "v").mapInArrow(walk, "shard long, leaves array<long>, q long, vec_id long, v array<double>")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best = Best(a["q"].to_numpy(), a["vec_id"].to_numpy(), k)
        if len(a) and len(b):
            uq, uv, ids, leaf = units(matrix(a["v"])), units(matrix(b["v"])), b["vec_id"].to_numpy(), b["leaf"].to_numpy()
            wanted: dict[int, list[int]] = {}
            for i, x in enumerate(a["leaves"]):
                for y in x:
                    wanted.setdefault(int(y), []).append(i)
            for y, queries in wanted.items():
                at = np.flatnonzero(leaf == y)
                for j in range(0, len(queries), 512):
                    q = np.array(queries[j : j + 512])
                    best.add(q, uq[q], ids[at], uv[at])
        return best.frame()

    partial = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(search, PARTIAL)
    return merged(partial.unionByName(rest) if rest else partial, k)
