"""Packing of documents into fixed-length token sequences.

A document's ids, with one separator id behind them, are cut into whole sequences and a remainder. First-fit
decreasing over a tournament tree of bin capacities then packs the pieces, independently in randomised groups: a
piece's group is a seeded hash of (document, start), so a hot source or a very long document spreads over all groups
and each group holds about pieces_per_group pieces however large the input is. Where a mixture is to govern the sequences, groups are
stretches of its order instead, of exactly pieces_per_group pieces but for the last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm import fasttokens, mixing
from revlake.llm.common import stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SEPARATOR = 1


class Tournament:
    """A complete binary tree over bins in the order they were opened; a node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for length, and the tokens already in it are capacity - room before."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        before = room[node]
        room[node] -= length
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return leaf, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Ties keep their order. Every length must be in [1, capacity]."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = Tournament(max(1, len(lengths) - full), capacity)
    for i in order[full:].tolist():
        leaf, before = tree.place(int(lengths[i]))
        bins[i], offsets[i] = full + leaf, capacity - before
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cuts each document's ids (and the separator) at multiples of capacity; null text counts as empty. Each piece has
    its document's columns `keep`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = fasttokens.words(tokenizer, "byte")
        tail = np.array([SEPARATOR], np.uint32)
        for batch in batches:
            rows, of = [], []
            for n, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), words.ids(batch.column(1).to_pylist()), strict=True)):
                ids = np.concatenate([ids, tail]).astype("<u4")
                rows += [(doc, at, len(x := ids[at : at + capacity]), zlib.crc32(x.tobytes()), len(ids)) for at in range(0, len(ids), capacity)]
                of += [n] * (len(rows) - len(of))
            cuts = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*cuts, *(batch.column(c).take(pa.array(of, pa.int64())) for c in keep)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *keep])

    fields = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep).mapInArrow(cut, PIECES + fields)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, pieces_per_group: int = 8192, seed: int = 20) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    Defined cases: a null or empty text is one piece holding the separator; repeated rows are packed one by one; a null
    doc_id stays null; an empty table gives no rows; other columns, whatever their names, are not read. sequence_id is
    unique over all groups.
    """
    cut = stored(pieces(docs, tokenizer, capacity), "pieces")
    groups = max(1, -(-cut.count() // pieces_per_group))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start"), F.lit(groups)))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["_group"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="_group")

    return dealt.groupBy("_group").applyInPandas(fill, PIECES + ", sequence_id long, offset long")


def pack_mixed(docs: DataFrame, tokenizer: str, weights: dict[str, int], capacity: int = 2048, pieces_per_group: int = 1024, position: str | None = None) -> DataFrame:
    """As pack, but in the order of the mixture of docs' sources, or of docs' column `position` (whole numbers, each once)
    where they have been mixed already: pieces are numbered in it, each stretch of
    pieces_per_group numbers is packed on its own, and sequence_id goes up with the stretches, within one with the least
    number in the sequence. So any run of stretches has each source's documents in its share, to a block or two. A very
    long document spreads over as many stretches as it fills."""
    doc = F.col(position).cast("long") if position else F.monotonically_increasing_id()
    named = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", doc.alias("_doc"))
    cut = stored(pieces(named, tokenizer, capacity, ("_doc", "source")), "pieces")  # ids are final once stored
    each = cut.where("start = 0").select("_doc", "doc_id", "source", F.ceil(F.col("doc_tokens") / capacity).alias("_n"))
    mixed = each.withColumn("position", F.col("_doc")) if position else mixing.mix(each, weights)
    mixed = mixed.withColumn("_all", F.lit(0)).select("_doc", "position", "_n", "_all")
    starts = mixing._before(stored(mixed, "mixed"), ["_all"], "position", "_n", "_first").select("_doc", "_first")
    number = F.col("_first") + F.floor(F.col("start") / capacity)
    dealt = cut.drop("source").join(starts, "_doc").withColumn("_number", number).withColumn("_group", F.floor(F.col("_number") / pieces_per_group)).drop("_doc", "_first")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_number"], ascending=[False, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        least = group["_number"].groupby(bins).min()  # by bin, from 0
        place = np.empty(len(least), np.int64)
        place[np.argsort(least.to_numpy(), kind="stable")] = np.arange(len(least))
        return group.assign(sequence_id=group["_group"].to_numpy() * (1 << 32) + place[bins], offset=offsets).drop(columns=["_group", "_number"])

    return dealt.groupBy("_group").applyInPandas(fill, PIECES + ", sequence_id long, offset long")
