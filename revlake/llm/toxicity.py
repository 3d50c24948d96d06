"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, toxic and ordinary, share everything but the top order: in each class the probability of a character after
up to five characters of its word is discounted on its own, and what is discounted falls back on one model of both
classes' continuation counts. An expression that neither class knows has the same probability in both; rare ones, with
fewer documents than the discount, lean on the shared counts alone. A word counts once a document, so that a junk
document does not outweigh others. The evidence is the difference of the two log-likelihoods per character, of the run
of RUN words where it is largest, so one insult in a very long text weighs as much as in a short one. A logistic fit on
labelled rows that no count came from turns it into a score.

Counts cover all labelled rows that may be learned from and stay distributed under their exact keys, however many there
are. Each distinct word of the texts is scored once, by joins of its (context, character) pairs with the counts' tables.
Values of the HEAD most frequent words are broadcast; runs of words with others among them get their values by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import stored
from revlake.llm.hashing import slices

CONTEXT, LOWER, DISCOUNT = 5, 4, 0.75
#: The top order's discount is this share of the smaller class's documents, within these bounds.
CLASS_DISCOUNT = (0.05, 1.0, 12.0)
RUN, LEAST = 3, 15
WORD = re.compile(r"\w+")
#: The characters below 256, those that are in no word as spaces.
LATIN = bytes(i if WORD.match(chr(i)) else 32 for i in range(256))
#: Words are valued in whole units of 1 / UNIT, so that sums do not depend on their order.
FLUSH, HEAD, UNIT, SLICES = 500_000, 300_000, 1 << 32, 4
LONGEST = 64
#: Stands for a word without a value among the most frequent ones; no value is that low.
MISSING = -(1 << 62)
BINS, CLIP = 4000, 20000


def words_in(text: str | None) -> list[str]:
    """WORD.findall() of the text in lower case. Texts of characters below 256, the most, are parted without it, faster."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(low)


def word_counts(labelled: DataFrame) -> DataFrame:
    """(text, toxic) to (word, ordinary, toxic), summed on the way: one row of each word a batch, then one in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[dict, dict] = ({}, {})

        def rows():
            words = list({**sums[0], **sums[1]})
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([s.get(w, 0) for w in words], pa.int64()) for s in sums)], names=["word", "ordinary", "toxic"])
            for s in sums:
                s.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = sums[toxic]
                for w in set(words_in(text)):
                    s[w] = s.get(w, 0) + 1
                if len(sums[0]) + len(sums[1]) > FLUSH:
                    yield rows()
        yield rows()

    counted = labelled.mapInArrow(count, "word string, ordinary long, toxic long")
    return counted.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def parts(word: str) -> list[tuple[str, str]]:
    """(context, character) of each character of the word and of its end. Words over LONGEST characters are junk of
    some kind, of which each stretch of LONGEST characters is taken as a word."""
    out = []
    for k in range(0, len(word), LONGEST):
        s = f"^{word[k : k + LONGEST]}$"
        out += [(s[max(0, i - CONTEXT) : i], s[i]) for i in range(1, len(s))]
    return out


def ratios(counts: DataFrame, class_discount: float) -> tuple[DataFrame, DataFrame]:
    """Log-ratio toxic to ordinary of each (context, character) that was seen, and of what each context leaves over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for word, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key in parts(word):
                    s = sums.setdefault(key, [0, 0])
                    s[0] += a
                    s[1] += b
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in sums], pa.string()) for i in (0, 1)] + [pa.array([s[i] for s in sums.values()], pa.int64()) for i in (0, 1)], names=["context", "next", "n0", "n1"])

    grams = stored(counts.mapInArrow(cut, "context string, next string, n0 long, n1 long").groupBy("context", "next").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "kn-grams")
    # shared continuation counts: in how many contexts of either class a character follows
    low = F.expr(f"right(context, {LOWER})")
    pairs = grams.groupBy(low.alias("low"), "next").agg(F.count("*").alias("kinds"))
    ones = grams.groupBy("next").agg(F.count("*").alias("kinds_1"))
    total = grams.agg(F.count("*").alias("all_kinds"), F.count_distinct("next").alias("alphabet"))
    lows = pairs.groupBy("low").agg(F.sum("kinds").alias("low_kinds"), F.count("*").alias("low_next"))
    d = F.lit(DISCOUNT)
    base = F.greatest(F.col("kinds_1") - d, F.lit(0.0)) / F.col("all_kinds") + d / F.col("all_kinds")
    shared = pairs.join(lows, "low").join(ones, "next").crossJoin(F.broadcast(total)).select("low", "next", (F.greatest(F.col("kinds") - d, F.lit(0.0)) / F.col("low_kinds") + d * F.col("low_next") / F.col("low_kinds") * base).alias("shared"))
    # the larger class is scaled to the smaller one's size, so that equal discounts leave over equal shares
    size = grams.agg(F.sum("n0"), F.sum("n1")).first()
    least = min(float(size[0] or 0), float(size[1] or 0))
    scaled = grams.select("context", "next", *((F.col(f"n{i}") * (least / size[i] if size[i] else 0.0)).alias(f"n{i}") for i in (0, 1)))
    strong = F.lit(class_discount)
    sums = [x for i in (0, 1) for x in (F.sum(f"n{i}").alias(f"all{i}"), F.sum(F.least(F.col(f"n{i}"), strong)).alias(f"rest{i}"))]
    rest = [F.when(F.col(f"all{i}") > 0, F.col(f"rest{i}") / F.col(f"all{i}")).otherwise(1.0).alias(f"rest{i}") for i in (0, 1)]
    contexts = stored(scaled.groupBy("context").agg(*sums).select("context", "all0", "all1", *rest), "kn-contexts")
    p = [F.when(F.col(f"all{i}") > 0, F.greatest(F.col(f"n{i}") - strong, F.lit(0.0)) / F.col(f"all{i}")).otherwise(0.0) + F.col(f"rest{i}") * F.col("shared") for i in (0, 1)]
    seen = scaled.withColumn("low", low).join(contexts, "context").join(shared, ["low", "next"]).select("context", "next", F.log(p[1] / p[0]).alias("ratio"))
    left = contexts.select("context", F.log(F.col("rest1") / F.col("rest0")).alias("rest"))
    return stored(seen, "kn-seen"), stored(left, "kn-left")


def words_of(texts: DataFrame) -> DataFrame:
    """(text) to (word, n): the distinct words, with the number of texts that each occurs in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array(sums.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in set(words_in(text)):
                    sums[w] = sums.get(w, 0) + 1
                if len(sums) > FLUSH:
                    yield rows()
                    sums.clear()
        yield rows()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_values(words: DataFrame, seen: DataFrame, left: DataFrame) -> DataFrame:
    """(word, n) to (word, n, value): the log-likelihood difference in units. A pair that was not seen has what its
    context leaves over, one of an unknown context 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contexts, chars = [], [], []
            for i, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for context, char in parts(w):
                    ids.append(i)
                    contexts.append(context)
                    chars.append(char)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contexts, pa.string()), pa.array(chars, pa.string())], names=["_id", "context", "next"])

    words = stored(words.withColumn("_id", F.monotonically_increasing_id()), "kn-words")  # ids are final once stored
    sums = []
    for k in range(SLICES):  # the shuffle files of one slice go before the next one's are written
        grams = words.where(F.pmod(F.xxhash64("_id"), F.lit(SLICES)) == k).select("_id", "word").mapInArrow(cut, "_id long, context string, next string")
        valued = grams.join(left.hint("merge"), "context").join(seen.hint("merge"), ["context", "next"], "left")
        units = F.round(F.coalesce("ratio", "rest", F.lit(0.0)) * UNIT).cast("long")
        sums.append(stored(valued.groupBy("_id").agg(F.sum(units).alias("value")), "kn-sums"))
    return words.join(reduce(DataFrame.unionByName, sums), "_id", "left").select("word", "n", F.coalesce("value", F.lit(0)).alias("value"))


def runs(words: list[str], known: dict[str, int]) -> tuple[float | None, list[dict], list[str]]:
    """The largest evidence of runs of RUN words (of all words, if fewer) that are known; of the other runs the known
    words' sum, the length, and where the other words are in the last list. 0 without words."""
    if not words:
        return 0.0, [], []
    n, k = len(words), min(RUN, len(words))
    values = np.fromiter(map(known.get, words, repeat(MISSING)), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    gaps = np.flatnonzero(values == MISSING).tolist()
    others: dict[str, int] = {}
    at = {i: others.setdefault(words[i], len(others)) for i in gaps}
    values[gaps] = 0
    unknown = np.zeros(n, np.int64)
    unknown[gaps] = 1
    unknown, sums, lengths = (np.concatenate([[0], np.cumsum(x)]) for x in (unknown, values, lengths))
    unknown, sums, lengths = (x[k:] - x[:-k] for x in (unknown, sums, lengths))
    lengths, sure = np.maximum(lengths, LEAST), unknown == 0
    best = float((sums[sure] / lengths[sure]).max() / UNIT) if sure.any() else None
    rest = {(int(sums[i]), int(lengths[i]), tuple(at[x] for x in range(i, i + k) if x in at)) for i in np.flatnonzero(~sure).tolist()}
    return best, [{"sum": a, "length": b, "at": list(c)} for a, b, c in sorted(rest)], list(others)


def runs_of(texts: list[str | None], known: dict[str, int]) -> list[tuple[float | None, list[dict], list[str]]]:
    """runs() of each text's words; texts whose words are all known are worked out together."""
    each = [words_in(t) for t in texts]
    words = list(chain.from_iterable(each))
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    values = np.fromiter(map(known.get, words, repeat(MISSING)), np.int64, len(words))
    gaps = np.concatenate([[0], np.cumsum(values == MISSING)])
    whole = (sizes >= RUN) & (gaps[bounds[1:]] == gaps[bounds[:-1]])
    largest = np.zeros(len(each))
    if whole.any():
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        sums, lengths = (np.concatenate([[0], np.cumsum(x)]) for x in (values, lengths))
        found = (sums[RUN:] - sums[:-RUN]) / np.maximum(lengths[RUN:] - lengths[:-RUN], LEAST)
        # a text's last runs would reach into the next one
        spans = np.stack([bounds[:-1][whole], bounds[1:][whole] - RUN + 1], 1).ravel()
        largest[whole] = np.maximum.reduceat(np.append(found, 0.0), spans)[::2] / UNIT
    return [(x, [], []) if sure else runs(w, known) for w, x, sure in zip(each, largest.tolist(), whole.tolist(), strict=True)]


def score_all(texts: DataFrame, values: DataFrame, model) -> DataFrame:
    """Adds evidence to (…, text) and drops text. values are those of all words, model of the most frequent ones."""
    keep, place = [c for c in texts.columns if c != "text"], texts.columns.index("text")
    run = pa.struct([("sum", pa.int64()), ("length", pa.int64()), ("at", pa.list_(pa.int32()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in (part for b in batches for part in slices(b, place)):
            got = runs_of(batch.column("text").to_pylist(), known)
            found = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.float64(), pa.list_(run), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], names=[*keep, "evidence", "_rest", "_words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema)
    first = texts.mapInArrow(score, f"{fields}, evidence double, _rest array<struct<sum: bigint, length: bigint, at: array<int>>>, _words array<string>")
    first = stored(first.withColumn("_id", F.monotonically_increasing_id()), "kn-runs")  # ids are final once stored
    done, late = (first.where(F.size("_rest") == 0), first.where(F.size("_rest") > 0))
    # rare words only, so no key is hot
    asked = late.select("_id", F.posexplode("_words").alias("_at", "word")).join(values.select("word", "value").hint("merge"), "word")
    answers = asked.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_values"))
    summed = lambda r: F.aggregate(r["at"], r["sum"], lambda a, i: a + F.get("_values", i)["value"]) / r["length"]
    largest = answers.join(late.select("_id", "_rest").hint("merge"), "_id").select("_id", (F.array_max(F.transform("_rest", summed)) / UNIT).alias("_largest"))
    late = late.drop("_rest", "_words").join(largest.hint("merge"), "_id").withColumn("evidence", F.greatest("evidence", "_largest"))
    return done.select(*keep, "evidence").unionByName(late.select(*keep, "evidence"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted one-feature logistic regression with a small ridge (Newton steps)."""
    scale = float(np.sqrt(np.average(x * x, weights=weight))) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6]) * weight.sum() / 100
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (y - p)) - ridge @ w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w[0] / scale, w[1]


def calibrated(scored: DataFrame) -> tuple[float, float]:
    """From (evidence, toxic) of all calibration rows, as a histogram of at most 2 * CLIP + 1 bins a class."""
    place = F.least(F.greatest(F.floor(F.col("evidence") * BINS), F.lit(-CLIP)), F.lit(CLIP)).cast("int")
    got = scored.groupBy(place.alias("bin"), "toxic").count().collect()
    if len({r.toxic for r in got}) < 2:
        return 0.0, (-30.0, 30.0)[got[0].toxic] if got else 0.0
    return logistic(*(np.array(v, float) for v in ([(r.bin + 0.5) / BINS for r in got], [r.toxic for r in got], [r["count"] for r in got])))


def known_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of documents with a label 0 or 1; of several labels the largest counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias(name)).where(F.col(name).isin(0, 1))
    return known.groupBy("doc_id").agg(F.max(name).alias(name)).hint("merge")  # one plan at every size


def label_rows(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, text, label) of the documents with a known label."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known_labels(labels, name), "doc_id")


def fit(labelled: DataFrame, texts: DataFrame, head: int = HEAD):
    """(doc_id, text, toxic) to the values of all words of texts, those of the most frequent ones as a broadcast, and
    the calibration. A fourth of the rows, by a hash of the text, calibrate and are not counted."""
    aside = F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(4)) == 0
    counts = word_counts(labelled.where(~aside).select("text", "toxic"))
    sizes = [r["count"] for r in labelled.where(~aside).groupBy("toxic").count().collect()]
    share, low, high = CLASS_DISCOUNT
    seen, left = ratios(counts, max(low, min(high, share * min(sizes, default=0))))
    words = words_of(texts.select("text").unionByName(labelled.where(aside).select("text")))
    values = stored(word_values(words, seen, left), "kn-values")
    top = values.orderBy(F.desc("n"), "word").limit(head).select("word", "value").toArrow()
    model = texts.sparkSession.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    return values, model, calibrated(score_all(labelled.where(aside).select("toxic", "text"), values, model))


def toxicity(docs: DataFrame, labelled: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, evidence, score, predicted of each row of docs, learned from labelled (doc_id, text, toxic).

    Defined cases: null and empty texts and texts without words have evidence 0; repeated rows stay; a null doc_id
    stays null; an empty table gives no rows; without labelled rows of both classes every score is the one class's (or
    0.5 without any); other columns are not read.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    values, model, (slope, shift) = fit(labelled, named)
    scored = score_all(named, values, model)
    score = 1 / (1 + F.exp(-(F.col("evidence") * slope + shift)))
    return scored.select("doc_id", "evidence", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, labelled: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that are not toxic. Null and empty texts stay, as their evidence is 0
    and ordinary documents are the rule; columns may have any names but `evidence`, which is replaced."""
    named = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    values, model, (slope, shift) = fit(labelled, named)
    scored = score_all(named, values, model)
    score = 1 / (1 + F.exp(-(F.col("evidence") * slope + shift)))
    return scored.where(score < threshold).select("row.*")
