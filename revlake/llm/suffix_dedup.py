"""Removal of long repeated byte strings by column-wise suffix-array construction over many documents.

A byte goes if a string of `size` bytes over it also starts anywhere else. Three steps find those strings exactly:

1. Windows. Every window of `size` bytes picks an anchor, the leftmost least hash of the short strings in it. Equal
   windows pick equal anchors, and the windows of one anchor stand side by side, so a document becomes segments: the
   bytes of the windows of one anchor. Each window of the input lies in one segment, and equal windows lie in segments
   with equal anchor keys. Only keys that occur again matter; equal segments of a key are counted, not kept apart.
2. Suffixes. Keys with different segments are dealt out by key, and the segments of a task go in collections of
   bounded size through a column-wise multi-string construction (class Columns): each round inserts one symbol of every
   segment, from the end backwards, into the collection's Burrows-Wheeler transform and its array of common prefixes,
   which are rewritten in order into external files. Runs of common prefixes of at least `size` are the repeats. A key
   with very many segments is split first: its windows part by how far they reach left of the anchor, each half gets a
   longer common core and so a finer key (and shorter segments, many of which become equal), again and again.
3. Bytes. The intervals of each document are merged and cut out.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import Stored, stored
from revlake.llm.hashing import Hashes

ANCHOR = 32
#: Bytes of one collection, and segments of one key above which the key is split.
COLLECTION, GROUP = 3_000_000, 20_000
#: Every key that has different segments is split this often before any of them is sorted.
REFINED = 2
CHUNK = 1 << 20
END = 0


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of every `width` neighbours (keys below 2**40, fewer than 2**24 of them)."""
    n = len(keys)
    k = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    k[:n] = (keys << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    rows = k.reshape(-1, width)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def segments(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Of each segment: document, start, length, anchor's start within it, anchor's key, digest of its bytes. The
    texts together, or the longest alone, are taken at once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    b = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    width = size - ANCHOR + 1
    out = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(b) < size:
        return tuple(out)
    h = Hashes(b)
    at = np.arange(len(b) - ANCHOR + 1)
    grams = h.of(at, at + ANCHOR)
    keys = grams >> np.uint64(24)
    first, last, places = [], [], []
    step = (1 << 24) - width
    for k in range(0, len(keys) - width + 1, step):  # parts overlap by a window
        p = least_places(keys[k : k + step + width - 1], width) + k
        start = np.arange(k, k + len(p))
        doc = np.searchsorted(ends, start, "right")
        fits = start + size <= ends[np.minimum(doc, len(ends) - 1)]
        p, start, doc = p[fits], start[fits], doc[fits]
        if len(p):
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
            f = np.flatnonzero(new)
            first.append(start[f])
            last.append(start[np.append(f[1:], len(p)) - 1])
            places.append(p[f])
    if not first:
        return tuple(out)
    first, last, places = map(np.concatenate, (first, last, places))
    doc = np.searchsorted(ends, first, "right")
    return doc, first - (ends[doc] - sizes[doc]), last + size - first, places - first, grams[places], h.of(first, last + size)


class Columns:
    """Burrows-Wheeler transform and common prefixes of a collection of strings (bytes below 0xFF), symbol by symbol.

    Every string's suffixes stand in one sorted order; bwt[i] is the symbol before suffix i (END before a whole
    string), lcp[i] what suffix i has in common with the one before it, counted up to `most`. A round takes the suffixes
    that the last round inserted, puts the next symbol before each, and finds the new suffix's place by counting equal
    symbols before it; the common prefix with a new neighbour is one more than the least entry between their tails.
    Both arrays are read and rewritten in order, from one file to the other.
    """

    def __init__(self, strings: list[bytes], folder: str, most: int = 255):
        n = len(strings)
        self.n, self.turn, self.most = n, 0, most
        self.files = [[open(f"{folder}/{name}-{k}", "w+b", buffering=0) for name in ("bwt", "lcp")] for k in (0, 1)]  # noqa: SIM115
        self.prefix = np.uint8 if most <= 255 else np.uint16 if most <= 65535 else np.uint32
        length = np.fromiter(map(len, strings), np.int64, n)
        text = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
        end = np.cumsum(length)
        rounds = int(length.max(initial=0))
        bwt = np.where(length > 0, text[np.maximum(end, 1) - 1] if len(text) else 0, END).astype(np.uint8)
        self._write(bwt, np.zeros(n, self.prefix))
        live, place, symbol = np.arange(n), np.arange(n), bwt
        for done in range(1, rounds + 1):
            bwt, lcp = self._read()
            keep = length[live] >= done
            live, place, symbol = live[keep], place[keep], symbol[keep]
            order = np.argsort(bwt, kind="stable")
            # all suffixes that start with a symbol, after this round, in order of their tails: places go up within a symbol
            by = np.lexsort((place, symbol))
            live, place, symbol = live[by], place[by], symbol[by]
            starts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
            new = np.empty(len(place), np.int64)
            cut = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(symbol) else np.zeros(0, np.int64)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(symbol)], strict=True):
                low = starts[symbol[i]]
                new[i:j] = low + np.searchsorted(order[low : starts[symbol[i] + 1]], place[i:j])
            # rows of END stand for whole strings; the empty suffixes take their room, n rows in front
            at = new - starts[END + 1] + n
            total = len(bwt) + len(new)
            left = self._common(bwt, lcp, order, new, symbol, -1)
            right = self._common(bwt, lcp, order, new, symbol, +1)
            before = np.where(length[live] > done, text[np.maximum(end[live] - done, 1) - 1], END).astype(np.uint8)
            old = np.ones(total, bool)
            old[at] = False
            next_bwt, next_lcp = np.empty(total, np.uint8), np.empty(total, self.prefix)
            next_bwt[old], next_lcp[old] = bwt, lcp
            follow = at + 1 < total
            next_lcp[at[follow] + 1] = right[follow]
            next_bwt[at], next_lcp[at] = before, left
            self._write(next_bwt, next_lcp)
            place, symbol = at, before
        self.bwt, self.lcp = self._read()
        for pair in self.files:
            for f in pair:
                f.close()

    def _common(self, bwt, lcp, order, new, symbol, side) -> np.ndarray:
        """Common prefix of each new suffix with the one beside it in the order after this round."""
        beside = new + side
        ok = (beside >= 0) & (beside < len(order))
        other = order[np.clip(beside, 0, len(order) - 1)]
        ok &= bwt[other] == symbol
        own = order[new]
        low, high = np.minimum(own, other) + 1, np.maximum(own, other) + 1
        out = np.zeros(len(new), lcp.dtype)
        if ok.any():
            pick = np.flatnonzero(ok)
            pick = pick[np.argsort(-low[pick], kind="stable")]  # then stretches between pairs cost nothing
            pairs = np.stack([low[pick], high[pick]], 1).ravel()
            least = np.minimum.reduceat(np.append(lcp, lcp.dtype.type(self.most)), pairs)[::2]
            out[pick] = np.minimum(least, self.most - 1) + 1
        return out

    def _write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.turn ^= 1
        self.rows = len(bwt)
        for f, x in zip(self.files[self.turn], (bwt, lcp), strict=True):
            f.seek(0)  # what lies behind the new rows is not read
            f.write(memoryview(x).cast("B"))

    def _read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for f, kind in zip(self.files[self.turn], (np.uint8, self.prefix), strict=True):
            f.seek(0)
            out.append(np.fromfile(f, kind, self.rows))
        return out[0], out[1]

    def places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each suffix length: (length, strings that have it, their places in the order), by walking backwards."""
        order = np.argsort(self.bwt, kind="stable")
        step = np.empty(len(order), np.int64)
        step[order] = np.arange(len(order))
        live, place, length = np.arange(self.n), np.arange(self.n), 0
        while len(live):
            yield length, live, place
            more = self.bwt[place] != END
            live, place = live[more], step[place[more]]
            length += 1


def repeats(strings: list[bytes], weights: np.ndarray, size: int) -> np.ndarray:
    """Bool (strings, starts): whether the window that starts there occurs again; weights count equal strings."""
    most = max(map(len, strings))
    out = np.zeros((len(strings), most - size + 1), bool)
    with tempfile.TemporaryDirectory() as folder:
        c = Columns(strings, folder, max(255, size))
        run = np.cumsum(c.lcp < size)
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        long_ones = [(k, live, place) for k, live, place in c.places() if k >= size]
        total = np.zeros(run[-1] + 1 if len(run) else 1, np.int64)
        for _, live, place in long_ones:
            np.add.at(total, run[place], weights[live])
        for k, live, place in long_ones:
            out[live, length[live] - k] = total[run[place]] > 1
        for name in os.listdir(folder):
            os.remove(f"{folder}/{name}")
    return out


PIECE = "key long, digest long, uid long, start long, length int, core int"
SEGMENT = "key long, uid long, start long, core_start int, core_end int, n long, body binary"
SPAN = "uid long, start long, stop long"


def _find(docs: DataFrame, size: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, texts = batch.column(0).to_numpy(zero_copy_only=False), [t.encode() for t in batch.column(1).to_pylist()]
            k = 0
            while k < len(texts):
                m, total = k + 1, len(texts[k])
                while m < len(texts) and total + len(texts[m]) <= CHUNK:
                    total += len(texts[m])
                    m += 1
                doc, start, length, core, key, digest = segments(texts[k:m], size)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(uids[k:m][doc]), pa.array(start), pa.array(length.astype(np.int32)), pa.array(core.astype(np.int32))], names=["key", "digest", "uid", "start", "length", "core"])
                k = m

    return docs.where(F.octet_length("text") >= size).select("uid", "text").mapInArrow(cut, PIECE)


def _refined(parts: list[tuple], size: int) -> list[tuple]:
    """Rows of SEGMENT split once: each half's windows share a longer core, which is its key."""
    out = []
    for _, uid, start, a, b, n, body in parts:
        for begin, end, c, d in halves(body, a, b, size):
            fine = hashlib.blake2b(body[c:d], digest_size=8, key=b"%d" % (c == a)).digest()
            out.append((int.from_bytes(fine, "little", signed=True), uid, start + begin, c - begin, d - begin, n, body[begin:end]))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "uid", "start", "core_start", "core_end", "n", "body"])


def _bodies(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (key, n, uid, start, length, core): the segments with their bytes, split REFINED times, as SEGMENT."""
    asked = wanted.groupBy("uid").agg(F.collect_list(F.struct("key", "n", "start", "length", "core")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = text.encode()
                rows = [(a["key"], uid, a["start"], a["core"], a["core"] + ANCHOR, a["n"], body[a["start"] : a["start"] + a["length"]]) for a in asked]
                for _ in range(REFINED):
                    rows = _refined(rows, size)
                yield _batch(rows)

    one = docs.select("uid", "text").dropDuplicates(["uid"])
    return one.join(asked, "uid").select("uid", "text", "asked").mapInArrow(cut, SEGMENT)


def halves(body: bytes, core_start: int, core_end: int, size: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, core_start, core_end) of two parts of a segment that share out its windows: those that reach at most
    half as far left of the core as they could in any segment, and the others. Each part's core is what all its windows
    cover; one without windows is left out."""
    spare = size - (core_end - core_start)
    if spare <= 0:
        return []
    half = spare // 2  # depends on the core's length alone, so equal windows take the same side
    left, right = core_start, len(body) - core_end
    out = []
    if right >= spare - half:  # at most half to the left
        out.append((max(0, core_start - half), len(body), core_start, core_end + spare - half))
    if left >= half + 1:
        out.append((0, min(len(body), core_end + spare - half - 1), core_start - half - 1, core_end))
    return [p for p in out if p[1] - p[0] >= size]


def _split(rows: DataFrame, size: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(_refined(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), size))

    return rows.mapInArrow(cut, SEGMENT)


def _suffixes(rows: DataFrame, size: int) -> DataFrame:
    """Intervals that repeat, of the segments with n = 1; rows of a key stand together in a task. There are as many tasks
    as collections, as their work goes by bytes times rounds and far exceeds what reading them costs."""
    tasks = max(1, -(-rows.count() * 2 * size // COLLECTION))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block):
            bodies: dict[bytes, int] = {}
            group = [bodies.setdefault(r[3], len(bodies)) for r in block]
            weights = np.bincount(group, [r[2] for r in block], len(bodies)).astype(np.int64)
            hit = repeats(list(bodies), weights, size)
            spans = []
            for (uid, start, n, _), g in zip(block, group, strict=True):
                if n == 1 and hit[g].any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[g].astype(np.int8), [0]])))
                    spans += [(uid, start + int(a), start + int(b) - 1 + size) for a, b in edge.reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(3)], names=["uid", "start", "stop"])

        block, group, now, volume = [], [], None, 0

        def settle():
            if len({r[3] for r in group}) > 1 or sum(r[2] for r in group) > 1 and any(r[2] == 1 for r in group):
                block.extend(group)

        for batch in batches:
            for key, uid, start, n, body in zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "start", "n", "body")), strict=True):
                if key != now:
                    settle()
                    group, now = [], key
                    if volume > COLLECTION:
                        if block:
                            yield flush(block)
                        block, volume = [], 0
                group.append((uid, start, n, body))
                volume += len(body)
        settle()
        if block:
            yield flush(block)

    return rows.select("key", "uid", "start", "n", "body").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(build, SPAN)


def repeated(docs: DataFrame, size: int = 200, group: int = GROUP) -> DataFrame:
    """(uid, start, stop) of bytes to remove, merged or not. docs: (uid long, equal for equal rows only; text string)."""
    pieces = Stored(_find(docs, size), "suffix-pieces")
    kinds = pieces.df.groupBy("key", "digest", "length").agg(F.count("*").alias("n"), F.min(F.struct("uid", "start", "core")).alias("one"))
    kinds = Stored(kinds, "suffix-kinds")
    keys = kinds.df.groupBy("key").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.min("n").alias("least")).where("all > 1")
    keys = stored(keys, "suffix-keys")
    # equal segments: all their windows repeat
    same = pieces.df.join(kinds.df.where("n > 1").select("key", "digest", "length"), ["key", "digest", "length"], "left_semi").select("uid", "start", (F.col("start") + F.col("length")).alias("stop"))
    same = stored(same, "suffix-same")
    mixed = keys.where("kinds > 1 and least = 1").select("key")
    wanted = kinds.df.join(mixed, "key", "left_semi").select("key", "n", "length", "one.*")
    bodies = stored(_bodies(docs, wanted, size), "suffix-bodies")
    pieces.drop()
    kinds.drop()
    rows, settled = _collapse(bodies)
    spans = same.unionByName(settled)
    while True:
        big = rows.groupBy("key").agg(F.count("*").alias("m"), F.max(F.col("core_end") - F.col("core_start")).alias("core")).where((F.col("m") > group) & (F.col("core") < size)).select("key")
        if not big.limit(1).count():
            break
        spans = spans.unionByName(_suffixes(rows.join(big, "key", "left_anti"), size))
        rows, settled = _collapse(stored(_split(rows.join(big, "key", "left_semi").select(*rows.columns), size), "suffix-split"))
        spans = spans.unionByName(settled)
    return spans.unionByName(_suffixes(rows, size))


def _collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split segments that have become equal are settled; one row of each, with the sum of n, stays where its key has
    different segments that are not settled yet."""
    by = ["key", "core_start", "core_end", "body"]
    kinds = stored(rows.groupBy(*by).agg(F.sum("n").alias("n"), F.min(F.struct("uid", "start")).alias("one")), "suffix-equal")
    open_ones = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("key")
    left = stored(kinds.join(open_ones, "key", "left_semi").select("key", "one.uid", "one.start", "core_start", "core_end", "n", "body"), "suffix-open")
    equal = rows.where("n = 1").join(kinds.where("n > 1").select(*by), by, "left_semi")
    return left, equal.select("uid", "start", (F.col("start") + F.octet_length("body")).alias("stop"))


def remove_repeats(docs: DataFrame, size: int = 200, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, stop) of each row.

    Defined cases: null text is empty; texts under `size` bytes lose nothing; rows that are equal in doc_id and text
    are repeats of each other; null doc_ids stay null; an empty table gives no rows; other columns are not read.
    """
    uid: Column = F.xxhash64("doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("uid", uid)
    spans = repeated(docs.select("uid", "text"), size, group).groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body, merged = text.encode(), []
                for s in spans or ():
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["stop"])
                    else:
                        merged.append([s["start"], s["stop"]])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(body[at:a])
                    at = b
                digest.update(body[at:])
                rows.append((doc, len(body), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"start": a, "stop": b} for a, b in merged]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"
    return docs.join(spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(cut, out)
