"""Quality by a linear-chain conditional random field over a document's lines.

Each line is good or bad; its evidence comes from its own features and those of the lines before and after it, and
neighbouring lines' labels hold together through transition weights. A labelled document gives its label to all its
lines. The forward-backward marginals of the lines, weighted by their length, are the document's share of good text; a
logistic fit on labelled documents that were not trained on turns it into a score.

Training takes at most TRAIN_DOCS labelled documents (those with the least hash of the text) with at most TRAIN_LINES
lines in all, so the driver's part does not grow with the input. Scoring reads every line of every document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.toxicity import logistic

TRAIN_DOCS, TRAIN_LINES, CHAIN = 6000, 120_000, 256
UPPER, LOWER, DIGIT, SPACE, STOP, COMMA, MARK, SYMBOL, LETTER = range(9)
KINDS = 9
FEATURES = KINDS + 8


@cache
def kinds() -> np.ndarray:
    out = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x10000):
        s = unicodedata.category(chr(c))
        out[c] = UPPER if s == "Lu" else LOWER if s == "Ll" else LETTER if s[0] in "LM" else DIGIT if s[0] == "N" else SPACE if s[0] in "ZC" else MARK if s[0] == "P" else SYMBOL
    out[0x10000:] = LETTER
    for c in ".?;:":
        out[ord(c)] = STOP
    for c in ",'-\"()":
        out[ord(c)] = COMMA
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) of the text's lines, and each line's length with its end."""
    text = text or ""
    lines = text.split("\n")
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(len(lines)), sizes + 1)[: len(cp)]
    shares = np.bincount(owner * KINDS + kinds()[cp], minlength=len(lines) * KINDS).reshape(-1, KINDS)[:, :KINDS].astype(float)
    shares[:-1, SPACE] -= 1  # the line ends
    out = np.zeros((len(lines), FEATURES))
    out[:, :KINDS] = shares / np.maximum(sizes, 1)[:, None]
    for i, line in enumerate(lines):
        words = line.split()
        if n := len(words):
            same = sum(map(str.__eq__, words, words[1:]))
            out[i, KINDS : KINDS + 5] = len(set(words)) / n, same / n, min(len(line) / n, 30) / 10, n < 4, words[0][:1].isupper()
        out[i, KINDS + 5] = np.log1p(n) / 5
        out[i, KINDS + 6] = line.rstrip()[-1:] in {".", "!", "?"}
    out[:, KINDS + 7] = sizes == 0
    assert ends[-1] == len(cp) + 1
    return out, sizes + 1


def chained(f: np.ndarray) -> np.ndarray:
    """A line's features, its neighbours', and whether it is first, last, and a constant."""
    n = len(f)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    edge = np.zeros((n, 3))
    edge[0, 0] = edge[-1, 1] = 1
    edge[:, 2] = 1
    return np.hstack([f, before, after, edge])


def forward_backward(u: np.ndarray, size: np.ndarray, t: np.ndarray):
    """u (chains, steps): log-odds of good of each line, padded; t (2, 2): transition weights. Returns the marginals of
    good, expected transitions and log-partition of each chain."""
    m, steps = u.shape
    e = np.stack([np.ones_like(u), np.exp(np.clip(u, -30, 30))], 2)
    k = np.exp(t)
    alpha, scale = np.empty((m, steps, 2)), np.empty((m, steps))
    live = np.arange(steps)[None, :] < size[:, None]
    for i in range(steps):
        a = e[:, i] if i == 0 else (alpha[:, i - 1] @ k) * e[:, i]
        z = a.sum(1)
        alpha[:, i], scale[:, i] = a / z[:, None], z
    beta = np.ones((m, steps, 2))
    pairs = np.zeros((2, 2))
    for i in range(steps - 2, -1, -1):
        right = e[:, i + 1] * beta[:, i + 1] / scale[:, i + 1, None]
        beta[:, i] = np.where(live[:, i + 1, None], right @ k.T, 1.0)
        pairs += np.einsum("ma,ab,mb->ab", alpha[:, i] * live[:, i + 1, None], k, right)
    p = alpha * beta
    return p[:, :, 1] / p.sum(2), pairs, (np.log(scale) * live).sum(1)


def padded(chains: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of chains of like lengths: (places, padded array, lengths)."""
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    k = 0
    while k < len(order):
        part = [order[k]]
        while k + len(part) < len(order) and len(part) < 512 and len(chains[order[k + len(part)]]) <= 8 + 1.5 * len(chains[part[0]]):
            part.append(order[k + len(part)])
        k += len(part)
        size = np.array([len(chains[i]) for i in part])
        out = np.zeros((len(part), size.max(), *chains[part[0]].shape[1:]))
        for j, i in enumerate(part):
            out[j, : size[j]] = chains[i]
        yield part, out, size


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def good(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted marginal of good of each text."""
        parts = [features(t) for t in texts]
        chains = [chained((f - self.mean) / self.spread) @ self.weights for f, _ in parts]
        out = np.zeros(len(texts))
        for places, u, size in padded(chains):
            p = forward_backward(u, size, self.moves)[0]
            for j, i in enumerate(places):
                w = parts[i][1]
                out[i] = (p[j, : size[j]] * w).sum() / w.sum()
        return out

    def score(self, good: np.ndarray) -> np.ndarray:
        x = np.log(np.clip(good, 1e-4, 1) / np.clip(1 - good, 1e-4, 1))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30)))


def train(texts: list[str | None], labels: np.ndarray, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Maximises the mean conditional log-likelihood of the line labels by Adam; a fifth of the texts calibrates."""
    aside = np.arange(len(texts)) % 5 == 4
    raw = [features(t)[0] for t, a in zip(texts, aside, strict=True) if not a]
    stack = np.concatenate(raw) if raw else np.zeros((1, FEATURES))
    mean, spread = stack.mean(0), stack.std(0) + 1e-3
    chains, goals = [], []
    for f, y in zip(raw, labels[~aside], strict=True):
        x = chained((f - mean) / spread)
        for k in range(0, len(x), CHAIN):  # very long texts train as several chains
            chains.append(x[k : k + CHAIN])
            goals.append(y)
    goal = np.array(goals, float)
    groups = [(goal[np.array(places)], x, size) for places, x, size in padded(chains)]
    total = sum(int(size.sum()) for _, _, size in groups) or 1
    model = Model(mean, spread, np.zeros(3 * FEATURES + 3), np.zeros((2, 2)))
    state = [np.zeros(model.weights.size + 4) for _ in range(2)]
    theta = np.zeros(model.weights.size + 4)
    for step in range(1, steps + 1):
        g = np.zeros_like(theta)
        for y, x, size in groups:
            p, pairs, _ = forward_backward(x @ theta[:-4], size, theta[-4:].reshape(2, 2))
            live = np.arange(x.shape[1])[None, :] < size[:, None]
            g[:-4] += np.einsum("mt,mtf->f", (y[:, None] - p) * live, x)
            have = np.zeros((2, 2))
            have[0, 0], have[1, 1] = ((size - 1) * (1 - y)).sum(), ((size - 1) * y).sum()
            g[-4:] += (have - pairs).ravel()
        g = g / total - ridge * theta
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        theta = theta + rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
    model.weights, model.moves = theta[:-4], theta[-4:].reshape(2, 2)
    if aside.any():
        good = model.good([t for t, a in zip(texts, aside, strict=True) if a])
        x, y = np.log(np.clip(good, 1e-4, 1) / np.clip(1 - good, 1e-4, 1)), labels[aside].astype(float)
        if 0 < y.mean() < 1:
            model.slope, model.shift = logistic(x, y, np.ones(len(x)))
            model.slope = max(model.slope, 1e-3)
    return model


def training_rows(docs: DataFrame, known: DataFrame) -> tuple[list[str | None], np.ndarray]:
    """docs (doc_id, text), known (doc_id, quality): the documents with the least hashes, within both bounds. Texts
    are fetched by a scan with the chosen ids, and not shuffled."""
    at = F.xxhash64("text", F.lit("sample"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    found = docs.select("doc_id", at.alias("at"), lines.alias("lines")).where(F.col("lines") <= TRAIN_LINES // 10).join(known, "doc_id")
    kept, total = {}, 0
    for r in found.orderBy("at", "doc_id").limit(TRAIN_DOCS).collect():
        total += r.lines
        if total > TRAIN_LINES:
            break
        kept[r.doc_id] = r.quality
    ids = F.broadcast(docs.sparkSession.createDataFrame(list(kept.items()), "doc_id long, quality int"))  # TRAIN_DOCS ids at most
    rows = docs.join(ids, "doc_id").orderBy("doc_id", "text").limit(TRAIN_DOCS).toArrow()
    return rows.column("text").to_pylist(), rows.column("quality").to_numpy()


def quality(docs: DataFrame, known: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, n_lines, good, score, predicted of each row of docs, learned from those in known (doc_id, quality 0/1).

    Defined cases: null and empty texts are one empty line and get its score; repeated rows stay; a null doc_id stays
    null; an empty table gives no rows; without labelled rows all weights are 0 and every score is 0.5; other columns
    are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, labels = training_rows(rows, known)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(1).to_pylist()
                good = model.value.good(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()), pa.array(good), pa.array(model.value.score(good))], names=["doc_id", "n_lines", "good", "score"])

    return rows.mapInArrow(score, "doc_id long, n_lines long, good double, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
