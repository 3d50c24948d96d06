"""Exact Jaccard join of documents' word shingles in the metric space of Jaccard distances.

Unrelated documents are all at distance 1 from any pivot, and a window of 2r around every region's border would then
copy every document into every region. So the space is first cut where nothing can be linked: a document's shingles
fall into more classes, by hash, than two linked documents can differ in shingles, hence linked documents agree on a
whole class, and a class's digest is a key that they share (documents also enter the next size range when a partner
could be in it). Documents connected by shared keys form a province; links never leave one.

Within a province pivots create Voronoi regions: every document goes to its nearest pivot's region and, by the
triangle inequality, also to those of pivots at most 2r farther (r: the largest distance of a link). Regions are joined
recursively with new pivots, down to regions whose documents have all been pivots or are connected already. Distances to
pivots are exact, so the links fall out on the way. Regions of over LEAF documents that pivots cannot part (nearly all
of them lie within the windows of one another) are taken apart by their rarest shingles instead. Provinces with more
than `province` documents or `volume` shingles are parted by keys of single shingles first; what is still larger goes
through the same step as distributed rounds that move ids, and a region that its pivots cannot part is dealt into pairs
of blocks, so what a task holds is bounded in documents and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.llm.common import Stored, connected_components, stored
from revlake.llm.hashing import mixed, shingles, slices

RANGE = 1.5
PIVOTS, LEAF, PROVINCE, VOLUME, SLICES = 8, 256, 5_000, 2_000_000, 4
A, B, C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def size_ranges(size: int, num: int, den: int) -> list[int]:
    """The ranges [RANGE**i, RANGE**(i+1)) of the size itself and of the largest size of a partner."""
    at = lambda n: int(np.log(n) / np.log(RANGE) + 1e-9)
    return list(range(at(size), at(size * den // num) + 1))


def classes(limit: int, num: int, den: int) -> tuple[int, int]:
    """(most shingles that a linked pair differs in, classes) where the larger of the pair has at most limit."""
    # 1 - t of the union differ at most, and the union is at most limit / t
    differ = (den - num) * (limit * den // num) // den
    return differ, differ + 1 + (differ + 3) // 6


def ranged_keys(s: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """For each size range of a set (most shingles that a linked pair differs in there, keys). A shingle lies in one class,
    so of n keys of a range at most `differ` are not shared with a linked set, and of any order of all keys that
    both sets go by, the first differ + 1 of either set contain one that is shared."""
    out = []
    x, y = mixed(s * A), mixed(s * B)
    for i in size_ranges(len(s), num, den) if len(s) else ():
        differ, m = classes(int(RANGE ** (i + 1)), num, den)  # the larger set of a pair lies in its own range, below that
        c = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(c, kind="stable")
        c = c[order]
        cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        digest = np.add.reduceat(y[order], cut)
        named = c[cut]
        if len(named) <= differ:  # so few classes have shingles that a pair may agree on empty ones alone
            rest = np.setdiff1d(np.arange(m, dtype=np.uint64), named)
            named, digest = np.concatenate([named, rest]), np.concatenate([digest, np.zeros(len(rest), np.uint64)])
        out.append((differ, mixed(digest ^ mixed((named + np.uint64(i << 32)) * C))))
    return out


def keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set, of which any linked set has one too."""
    return np.concatenate([np.zeros(0, np.uint64), *(k for _, k in ranged_keys(s, num, den))])


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Region:
    """Exact links among sets, enough to connect all that links connect. by: how many came from pivots, and how many from
    rare shingles."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, num: int, den: int):
        self.flat, self.size, self.num, self.den = flat, size, num, den
        self.forest, self.links, self.by = Forest(len(size)), [], {"pivots": 0, "shingles": 0}
        self.begin = np.cumsum(size) - size

    def shared(self, p: int, among: np.ndarray) -> np.ndarray:
        """Exact intersection sizes of set p with others."""
        size = self.size[among]
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.zeros(len(among), np.int64)
        at = np.arange(ends[-1]) + np.repeat(self.begin[among] - (ends - size), size)
        own, x = self.flat[self.begin[p] : self.begin[p] + self.size[p]], self.flat[at]
        if not len(own):
            return np.zeros(len(among), np.int64)
        place = np.minimum(np.searchsorted(own, x), len(own) - 1)
        sums = np.concatenate([[0], np.cumsum(own[place] == x)])
        return sums[ends] - sums[ends - size]

    def pivot(self, p: int, among: np.ndarray) -> np.ndarray:
        """Distances to p; those linked are joined."""
        both = self.shared(p, among)
        union = self.size[among] + self.size[p] - both
        for j in among[(self.den * both >= self.num * union) & (among != p)].tolist():
            self.join(p, j, "pivots")
        return 1 - both / np.maximum(union, 1)

    def join(self, i: int, j: int, by: str) -> None:
        if self.forest.join(i, j):
            self.links.append((i, j))
            self.by[by] += 1

    def roots(self, among: np.ndarray) -> np.ndarray:
        return np.fromiter((self.forest.root(i) for i in among.tolist()), np.int64, len(among))

    def solve(self) -> list[tuple[int, int]]:
        todo = [np.arange(len(self.size))]
        while todo:
            here = todo.pop()
            roots = self.roots(here)
            if len(here) < 2 or (roots == roots[0]).all():
                continue
            chosen, cells = self.cells(here)
            if sum(len(c) ** 2 for c in cells) <= 0.8 * len(here) ** 2:
                todo += cells
            elif len(here) <= LEAF:  # the pivots' links are known, the others take their turn as pivots
                todo.append(here[~np.isin(here, chosen)])
            else:
                self.one_by_one(here)
        return self.links

    def cells(self, here: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        """Pivots that lie far from each other, and their Voronoi regions with the documents near the borders, without
        the pivots themselves, whose links are found by then."""
        chosen, columns = [int(here[0])], []
        while True:
            columns.append(self.pivot(chosen[-1], here))
            least = np.min(columns, 0)
            if len(chosen) == PIVOTS or least.max() == 0:
                break
            chosen.append(int(here[least.argmax()]))
        d = np.array(columns)
        near = (d <= d.min(0) + 2 * (1 - self.num / self.den) + 1e-9) & ~np.isin(here, chosen)
        return chosen, [here[row] for row in near]

    def one_by_one(self, here: np.ndarray) -> None:
        """The finest regions: pivots of a single shingle. Linked sets share one of their rarest shingles: of `size`
        shingles, ranked by how many documents here have them, they can differ in all but so many that the first
        size - least shared + 1 of both meet. Documents outside the largest connected part look at those who meet
        them there; what is within that part is settled."""
        size = self.size[here]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.begin[here] - (ends - size), size)
        names, place, count = np.unique(self.flat[at], return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, count))] = np.arange(len(names))
        owner = np.repeat(np.arange(len(here)), size)
        order = np.lexsort((rank[place], owner))
        ranked = rank[place][order]
        first = size + (-(self.num * size) // self.den) + 1  # size - ceil(t * size) + 1
        nth = np.arange(len(ranked)) - np.repeat(ends - size, size)
        keep = nth < np.repeat(first, size)
        heads, head_of = ranked[keep], owner[keep]
        by = np.argsort(heads, kind="stable")
        posting, posted = heads[by], head_of[by]
        low, high = np.searchsorted(posting, heads), np.searchsorted(posting, heads, "right")
        cut = np.concatenate([[0], np.cumsum(np.bincount(head_of, minlength=len(here)))])
        starts, marked = ends - size, np.zeros(len(names), bool)
        label = self.roots(here)  # kept in step with the forest

        def meet(i: int, others: np.ndarray) -> None:
            """Exact links of the i-th document to others (places in here)."""
            own = place[starts[i] : ends[i]]
            marked[own] = True
            if 4 * len(others) < len(here):
                each = size[others]
                upto = np.cumsum(each)
                hits = marked[place[np.arange(upto[-1]) + np.repeat(starts[others] - (upto - each), each)]]
                both = np.add.reduceat(hits, upto - each, dtype=np.int64)
            else:
                both = np.add.reduceat(marked[place], starts, dtype=np.int64)[others]
            marked[own] = False
            linked = others[self.den * both >= self.num * (size[i] + size[others] - both)]
            for j in linked[label[linked] != label[i]].tolist():
                self.join(int(here[i]), int(here[j]), "shingles")
            merged = np.unique(np.append(label[linked], label[i]))
            if len(merged) > 1:
                label[np.isin(label, merged)] = merged[0]

        everyone = np.arange(len(here))
        values, members = np.unique(label, return_counts=True)
        seed = int(np.flatnonzero(label == values[members.argmax()])[0])
        if len(here) > 500:  # a few of the part's own members first, so that most of it is settled in bulk
            for i in np.random.default_rng(len(here)).permutation(len(here))[:32].tolist():
                meet(i, everyone)
            values, members = np.unique(label, return_counts=True)
            seed = int(np.flatnonzero(label == values[members.argmax()])[0])
        for i in everyone.tolist():
            # whoever is in the seed's part by now is met by the others, in their turn
            if label[i] == label[seed]:
                continue
            mine = slice(cut[i], cut[i + 1])
            met = [posted[x:y] for x, y in zip(low[mine].tolist(), high[mine].tolist(), strict=True) if y - x > 1]
            if not met:
                continue
            others = np.unique(np.concatenate(met)) if sum(map(len, met)) < len(here) else everyone
            others = others[(self.num * size[others] <= self.den * size[i]) & (self.num * size[i] <= self.den * size[others]) & (label[others] != label[i])]
            if len(others):
                meet(i, others)


def sets_of(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, digest, ranges): of each size range what may differ, and the keys."""
    kind = pa.list_(pa.struct([("differ", pa.int32()), ("keys", pa.list_(pa.int64()))]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingles(part.column(1).to_pylist(), words)
                made = [ranged_keys(s, num, den) for s in sets]
                digests = [f"{int(s.sum(dtype=np.uint64)):016x}{int(np.bitwise_xor.reduce(mixed(s * C), initial=np.uint64(0))):016x}{len(s):x}" for s in sets]
                each = [x for m in made for x in m]
                flat = np.concatenate([np.zeros(0, np.uint64), *(k for _, k in each)]).view(np.int64)
                inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(k) for _, k in each)]), pa.int32()), pa.array(flat))
                ranges = pa.StructArray.from_arrays([pa.array([d for d, _ in each], pa.int32()), inner], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), ranges)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests), lists.cast(kind)], names=["doc_id", "n_shingles", "digest", "ranges"])

    return docs.mapInArrow(cut, "doc_id long, n_shingles long, digest string, ranges array<struct<differ: int, keys: array<long>>>")


def near_pairs(stands: DataFrame) -> Stored:
    """stands (id, ranges): (a, b) that connect all linked documents. Keys go from rare to frequent, and of each range of
    a document only the first differ + 1 count; those that nobody shares come first. So passages that many documents
    have in common, whose keys are the frequent ones, do not connect documents that differ otherwise. Frequencies and
    least ids are summed up on the way, so a hot key is no hot task, and joins on it may be split. Keys are counted in
    SLICES, one after another: the shuffle files of one go before the next one's are written."""
    each = stands.select("id", F.posexplode("ranges").alias("r", "x")).select("id", "r", F.col("x.differ").alias("differ"), F.size("x.keys").alias("n"), F.explode("x.keys").alias("key"))
    shared = []
    for k in range(SLICES):
        part = each.where(F.pmod("key", F.lit(SLICES)) == k)
        often = part.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        shared.append(Stored(part.join(often.hint("merge"), "key"), "jaccard-shared"))
    own = Window.partitionBy("id", "r")
    first = F.row_number().over(own.orderBy("c", "key")) + F.col("n") - F.count("*").over(own) <= F.col("differ") + 1
    whole = reduce(DataFrame.unionByName, [x.df for x in shared])
    kept = Stored(whole.withColumn("_first", first).where("_first").select("key", "id"), "jaccard-kept")
    for x in shared:
        x.drop()
    least = kept.df.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b < most").select("key", "b")
    near = Stored(kept.df.join(least.hint("merge"), "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "jaccard-near")
    kept.drop()
    return near


ROW = "region long, id long, shingles array<long>"


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of an array column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(column.offsets.to_numpy())


def _solved(rows: DataFrame, num: int, den: int) -> DataFrame:
    """ROW to (a, b, pivot): links within regions, each of which a task can hold; pivot tells how a link was found."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, flats, sizes = None, [], [], []

        def settle() -> pa.RecordBatch:
            name = np.concatenate(ids)
            region = Region(np.concatenate(flats), np.concatenate(sizes).astype(np.int64), num, den)
            found = np.array(region.solve(), np.int64).reshape(-1, 2)
            share = pa.array([region.by["pivots"]] + [0] * (len(found) - 1) if len(found) else [], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(name[found[:, 0]]), pa.array(name[found[:, 1]]), share], names=["a", "b", "by_pivots"])

        for batch in batches:
            region = batch.column(0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])) if len(region) else np.zeros(0, np.int64)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(region)], strict=True):
                if region[i] != now and ids:
                    yield settle()
                    ids, flats, sizes = [], [], []
                now = region[i]
                flat, size = _flat(batch.column(2).slice(i, j - i))
                ids.append(batch.column(1).slice(i, j - i).to_numpy(zero_copy_only=False))
                flats.append(flat)
                sizes.append(size)
        if ids:
            yield settle()

    return rows.select("region", "id", "shingles").repartition("region").sortWithinPartitions("region").mapInArrow(solve, "a long, b long, by_pivots long")


class Blocks(NamedTuple):
    """Pairs of blocks as regions, and the table that they are read from."""

    source: Stored
    df: DataFrame


def _voronoi(rows: DataFrame, num: int, den: int, level: int, province: int, volume: int) -> tuple[DataFrame, DataFrame, Blocks]:
    """One distributed round over ROW: links to the regions' pivots (a, b), the rows of the new regions, and those of
    regions that the pivots could not part, dealt into pairs of blocks. Distances move as ids; shingles join them after."""
    dealt = rows.withColumn("at", F.xxhash64("id", F.lit(level))).withColumn("size", F.size("shingles"))
    ones = dealt.groupBy("region", F.pmod("at", F.lit(PIVOTS)).alias("nth")).agg(F.min_by(F.struct("id", "shingles"), "at").alias("pivot"), F.count("*").alias("m"), F.sum("size").alias("v"))
    parts = F.greatest(F.ceil(F.sum("m") / province), F.ceil(F.sum("v") / volume)).cast("int")
    first = stored(ones.groupBy("region").agg(F.collect_list("pivot").alias("pivots"), F.sum("m").alias("m"), F.sum("v").alias("v"), parts.alias("parts")), "jaccard-pivots")
    salted = dealt.join(first.select("region", "parts"), "region").withColumn("part", F.pmod("at", F.col("parts")).cast("int")).select("region", "part", "id", "shingles")
    lead = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("region", "part", "pivots")

    def measure(key, p: pa.Table, docs: pa.Table) -> pa.Table:
        pivots = p.column("pivots").to_pylist()[0] if p.num_rows else []
        sets = [np.array(x["shingles"], np.int64).view(np.uint64) for x in pivots]
        flat, size = _flat(docs.column("shingles").combine_chunks())
        region = Region(np.concatenate([*sets, flat]), np.concatenate([[len(s) for s in sets], size]).astype(np.int64), num, den)
        among, ids = np.arange(len(pivots), len(pivots) + len(size)), docs.column("id").to_numpy()
        d, out = [], []
        for j, x in enumerate(pivots):
            both = region.shared(j, among)
            union = region.size[among] + region.size[j] - both
            d.append(1 - both / np.maximum(union, 1))
            hit = np.flatnonzero(den * both >= num * union)
            out.append((np.zeros(len(hit), np.int64), ids[hit], np.full(len(hit), x["id"], np.int64), np.ones(len(hit), bool)))
        d = np.array(d)
        near = d <= d.min(0) + 2 * (1 - num / den) + 1e-9
        for j in range(len(pivots)):
            at = np.flatnonzero(near[j])
            name = mixed(np.array([np.int64(key[0].as_py()).view(np.uint64) + np.uint64(j + 1) * C]))[0].view(np.int64)
            out.append((np.full(len(at), name), ids[at], np.zeros(len(at), np.int64), np.zeros(len(at), bool)))
        region_of, doc, other, linked = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"parent": pa.array(np.full(len(doc), key[0].as_py())), "region": pa.array(region_of), "id": pa.array(doc), "other": pa.array(other), "linked": pa.array(linked)})

    made = stored(lead.groupBy("region", "part").cogroup(salted.groupBy("region", "part")).applyInArrow(measure, "parent long, region long, id long, other long, linked boolean"), "jaccard-round")
    found, cells = made.where("linked"), made.where("not linked")
    whole = cells.groupBy("parent", "region").count().groupBy("parent").agg(F.max("count").alias("largest")).join(first.select(F.col("region").alias("parent"), "m", "v"), "parent")
    stuck = stored(whole.where(F.col("largest") > F.col("m") / 2).select(F.col("parent").alias("region"), "m", "v"), "jaccard-stuck")
    moved = cells.join(stuck.select(F.col("region").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("_p"), F.col("id").alias("_i"), F.col("region").alias("_r"))
    onward = rows.join(moved, (F.col("region") == F.col("_p")) & (F.col("id") == F.col("_i"))).select(F.col("_r").alias("region"), "id", "shingles")
    # what the pivot with most links holds together needs no pairs of its own: the others meet everyone, block by block
    main = found.groupBy("parent", "other").count().groupBy("parent").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
    held = found.join(main, ["parent", "other"], "left_semi").select(F.col("parent").alias("region"), "id").distinct().withColumn("held", F.lit(True))
    source = Stored(rows.join(stuck.select("region"), "region", "left_semi").join(held, ["region", "id"], "left").select("region", "id", "shingles", F.coalesce("held", F.lit(False)).alias("held")), "jaccard-blocks")
    rest = source.df
    blocks = lambda many: F.greatest(F.ceil(F.sum(many.cast("long")) * 2 / province), F.ceil(F.sum(F.when(many, F.size("shingles")).otherwise(0)) * 2 / volume)).cast("int")
    size = rest.groupBy("region").agg(blocks(~F.col("held")).alias("odd"), blocks(F.lit(True)).alias("all")).where("odd > 0")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(level)), F.col(n)).cast("int")
    odd = rest.where(~F.col("held")).join(size, "region").withColumn("i", own("odd")).withColumn("j", spread("all"))
    everyone = rest.join(size, "region").withColumn("j", own("all")).withColumn("i", spread("odd"))
    everyone = everyone.where(F.col("held") | (F.col("i") != own("odd")))  # there the row of odd stands already
    pairs = odd.select("region", "i", "j", "id", "shingles").unionByName(everyone.select("region", "i", "j", "id", "shingles"))
    return found.select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit(1).cast("long").alias("by_pivots")), onward, Blocks(source, pairs.select(F.xxhash64("region", "i", "j").alias("region"), "id", "shingles"))


def links(rows: DataFrame, num: int, den: int, province: int = PROVINCE, volume: int = VOLUME) -> DataFrame:
    """ROW, with one row of each (region, id): (a, b, by_pivots) enough exact links within regions to connect all that
    is linked; the sum of by_pivots tells how many of them were distances to pivots."""
    def too_large(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("region").agg(F.count("*").alias("m"), F.sum(F.size("shingles")).alias("v"))
        return sizes.where((F.col("m") > province) | (F.col("v") > volume) & (F.col("m") > 2 * PIVOTS)).select("region")

    out, level, onward = [], 0, None
    if too_large(rows).limit(1).count():
        # what keys of whole classes have put together is parted by single shingles first: a set shares all but
        # n - ceil(t * n) of its own with each set that it is linked to
        big = stored(too_large(rows), "jaccard-named")
        out.append(stored(_solved(rows.join(big, "region", "left_anti"), num, den), "jaccard-links"))
        large = Stored(rows.join(big, "region", "left_semi").select("id", "shingles"), "jaccard-big")
        n = F.size("shingles")
        differ = (n - F.ceil(n * num / den)).cast("int")
        near = near_pairs(large.df.select("id", F.array(F.struct(differ.alias("differ"), F.col("shingles").alias("keys"))).alias("ranges")))
        parts = connected_components(near.df.select(F.explode(F.array("a", "b")).alias("id")).distinct(), near.df).withColumnRenamed("component", "region")
        onward = Stored(large.df.join(parts.hint("merge"), "id").select("region", "id", "shingles"), "jaccard-onward")
        near.drop()
        large.drop()
        rows = onward.df
    while True:
        big = too_large(rows)
        if not big.limit(1).count():
            break
        big = Stored(big, "jaccard-named").df
        out.append(stored(_solved(rows.join(big, "region", "left_anti"), num, den), "jaccard-links"))
        parted = Stored(rows.join(big, "region", "left_semi").select("region", "id", "shingles"), "jaccard-big")
        if onward:
            onward.drop()
        to_pivots, further, blocks = _voronoi(parted.df, num, den, level, province, volume)
        onward = Stored(further, "jaccard-onward")
        parted.drop()
        out += [to_pivots, stored(_solved(blocks.df, num, den), "jaccard-links")]
        blocks.source.drop()
        # each region on the way has at most half of its parent's documents
        rows, level = onward.df, level + 1
    return reduce(DataFrame.unionByName, [*out, stored(_solved(rows, num, den), "jaccard-links")])


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, province: int = PROVINCE, volume: int = VOLUME) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest doc_id that links of similarity >= num / den reach.

    Defined cases: null and empty texts, and texts of white space, have no shingles and are linked with nothing; texts
    of fewer words are one shingle; rows that share a doc_id are one document with several texts; a row without doc_id
    gets the component of the documents with its very set, if any, else null; an empty table gives no rows; other
    columns are not read. Sets are compared by 64-bit hashes of shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = Stored(sets_of(docs, words, num, den).withColumn("nth", F.monotonically_increasing_id()), "jaccard-sets")  # nth is final once stored
    least = made.df.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "nth")).alias("h"))
    named = stored(least.select("digest", F.col("h.doc_id").alias("id"), "h.nth"), "jaccard-heads")
    heads = named.select("digest", "id")
    # one document stands for all with its very set
    stands = made.df.select("nth", F.col("doc_id").alias("id"), "ranges").join(named.select("nth").hint("merge"), "nth", "left_semi")
    stands = Stored(stands.select("id", "ranges"), "jaccard-stands")
    slim = stored(made.df.select("doc_id", "n_shingles", "digest"), "jaccard-slim")
    made.drop()
    near = near_pairs(stands.df)
    stands.drop()
    members = near.df.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    provinces = stored(connected_components(members, near.df).withColumnRenamed("component", "region"), "jaccard-provinces")
    near.drop()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingles(part.column(2).to_pylist(), words)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["region", "id", "shingles"])

    rows = docs.join(provinces.hint("merge"), docs["doc_id"] == provinces["id"]).select("region", "id", "text").mapInArrow(cut, ROW)
    # the texts of documents that share an id are one set of links, but several rows: each under a number of its own
    rows = Stored(rows.where(F.size("shingles") > 0).withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    found = links(rows.df.select("region", F.col("row").alias("id"), "shingles"), num, den, province, volume)
    name = rows.df.select("row", "id")
    found = found.join(name.select(F.col("row").alias("a"), F.col("id").alias("_a")), "a").join(name.select(F.col("row").alias("b"), F.col("id").alias("_b")), "b")
    found = stored(found.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b"), "jaccard-links")
    rows.drop()
    # documents with equal sets and rows that share a doc_id hang together as well
    same = slim.where("n_shingles > 0 and doc_id is not null").join(heads, "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    parts = connected_components(slim.where("doc_id is not null").select(F.col("doc_id").alias("id")), found.unionByName(same))
    by_id = slim.join(heads, "digest", "left").withColumn("id", F.coalesce("doc_id", F.when(F.col("n_shingles") > 0, F.col("id"))))
    return by_id.join(parts, "id", "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
