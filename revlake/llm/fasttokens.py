"""Exact BPE ids of whole texts from the tokenizers library, one library call for each distinct word.

Both vocabularies split a text into words by a fixed pattern before merging, and merges never cross words. The split is
done here on arrays of code points; each distinct word is encoded once by the library itself and remembered by a
64-bit hash. Texts with characters outside the blocks listed in SAFE, or with a special token's string, go to the
library whole, so nothing depends on this module's tables agreeing with the library's beyond those blocks.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Blocks whose categories and case have been stable for many versions of Unicode.
SAFE = ((0x00, 0x130), (0x131, 0x220), (0x390, 0x3A2), (0x3A3, 0x3CF), (0x400, 0x482), (0x48A, 0x500), (0x2010, 0x2028), (0x202A, 0x205F), (0x3001, 0x3021), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
#: Endings that the patterns take together with their apostrophe.
ONE, TWO = "stmd", ("re", "ve", "ll")
UNSAFE = 255
REMEMBERED = 1_000_000
CHUNK = 1 << 19


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind, lower case, random odd word."""
    kind = np.full(0x110000, UNSAFE, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for low, high in SAFE:
        for c in range(low, high):
            s = chr(c)
            category = unicodedata.category(s)
            kind[c] = SPACE if 9 <= c <= 13 or c in (0x20, 0x85, 0xA0) else LETTER if category[0] == "L" else NUMBER if category[0] == "N" else OTHER if category not in ("Cn", "Zs") else UNSAFE
            if len(s.lower()) == 1:
                lower[c] = ord(s.lower())
    x = np.arange(0x110000, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return kind, lower, x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D | 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """style: "byte" (a space belongs to the word after it) or "word" (NFC, lower case, white space dropped)."""

    def __init__(self, path: str, style: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.style, self.known = Tokenizer.from_file(path), style, {}
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marks where words start; first marks where documents start."""
        n = len(cp)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= first
        space = kind == SPACE
        if self.style == "byte":
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
            start[last] = True
            start[last[cp[last] == 0x20] + 1] = False
        else:
            start |= kind == NUMBER
        quote = np.flatnonzero((cp == 0x27) & start)
        if len(quote):
            edge = np.append(np.flatnonzero(first), n)
            end = edge[np.searchsorted(edge, quote, "right")]
            at = lambda k: np.where(quote + k < end, cp[np.minimum(quote + k, n - 1)], 0)
            a, b = at(1), at(2)
            took = np.where(np.isin(a, [ord(c) for c in ONE]), 2, 0)
            for pair in TWO:
                took = np.where((a == ord(pair[0])) & (b == ord(pair[1])), 3, took)
            quote, end, took = quote[took > 0], end[took > 0], took[took > 0]
            for k in (1, 2):
                start[(quote + k)[took > k]] = False
            after = quote + took
            start[after[after < end]] = True
        return start

    def _chunk(self, cp: np.ndarray, kind: np.ndarray, sizes: np.ndarray):
        """Of safe texts: where words start and end, their hashes, the text of each word."""
        _, lower, mix = tables()
        if self.style == "word":
            cp = lower[cp]
        first = np.zeros(len(cp) + 1, bool)
        first[np.cumsum(sizes) - sizes] = True  # an empty text marks its neighbour's start, which is one anyway
        at = np.flatnonzero(self._starts(cp, kind, first[:-1]))
        till = np.append(at[1:], len(cp))
        up, down = _powers(1 << max(20, (len(cp) + 1).bit_length()))
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mix[cp] * up[: len(cp)], out=sums[1:])
        hashes = (sums[till] - sums[at]) * down[at]
        if self.style == "word":
            words = kind[at] != SPACE
            at, till, hashes = at[words], till[words], hashes[words]
        owner = np.searchsorted(np.cumsum(sizes), at, "right")
        return cp, at, till, hashes, owner

    def _learn(self, cp, at, till, hashes) -> tuple[np.ndarray, list[bytes]]:
        """The place of each word among the distinct ones, and the distinct ones' ids as bytes."""
        distinct, where, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in known]
        if new:
            words = [cp[at[where[i]] : till[where[i]]].tobytes().decode("utf-32-le") for i in new]
            for i, ids in zip(new, self._encode(words), strict=True):
                known[keys[i]] = ids
        return place, [known[k] for k in keys]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Of each word. Those that the library splits off again when they stand in a row go in one call for many."""
        out: list[bytes] = [b""] * len(words)
        glue = "" if self.style == "byte" else " "
        rows = [i for i, w in enumerate(words) if self.style == "word" or (w[0] == " " and w[1:].isalpha())]
        for k in range(0, len(rows), 512):
            part = rows[k : k + 512]
            e = self.library.encode(glue.join([words[i] for i in part]), add_special_tokens=False)
            ids, owner = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            if len(owner) == 0 or owner[-1] != len(part) - 1:  # the library parts them otherwise: each on its own then
                for i in part:
                    out[i] = np.array(self.library.encode(words[i], add_special_tokens=False).ids, np.uint32).tobytes()
                continue
            for j, i in enumerate(part):
                out[i] = ids[cuts[j] : cuts[j + 1]].tobytes()
        rest = sorted({*range(len(words))} - {*rows})
        for i, e in zip(rest, self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def _split(self, texts: list[str | None]):
        """Yields (places, code points, kinds, sizes) of runs of safe texts, then the rest as (places, texts)."""
        kinds = tables()[0]
        odd, run, size = [], [], 0
        for i, text in enumerate([*texts, None]):
            if i < len(texts):
                text = text or ""
                if self.style == "word" and not text.isascii():
                    text = unicodedata.normalize("NFC", text)
                if any(s in text for s in self.specials):
                    odd.append(i)
                    continue
                run.append((i, text))
                size += len(text)
            if size >= CHUNK or i == len(texts) and size:
                places, sizes = np.array([i for i, _ in run]), np.array([len(t) for _, t in run])
                cp = np.frombuffer("".join([t for _, t in run]).encode("utf-32-le"), np.uint32)
                kind = kinds[cp]
                if (wrong := kind == UNSAFE).any():
                    bad = np.zeros(len(run), bool)
                    bad[np.searchsorted(np.cumsum(sizes), np.flatnonzero(wrong), "right")] = True
                    odd += places[bad].tolist()
                    keep = np.repeat(~bad, sizes)
                    places, sizes, cp, kind = places[~bad], sizes[~bad], cp[keep], kind[keep]
                if len(cp):
                    yield places, cp, kind, sizes
                run, size = [], 0
        if odd:
            yield odd, [texts[i] for i in odd]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for places, *run in self._split(texts):
            if len(run) == 1:
                out[places] = [len(x) for x in self._whole(run[0])]
                continue
            *words, owner = self._chunk(*run)
            place, ids = self._learn(*words)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            out[places] = np.bincount(owner, sizes[place], len(places)).astype(np.int64)
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for places, *run in self._split(texts):
            if len(run) == 1:
                found = self._whole(run[0])
            else:
                *words, owner = self._chunk(*run)
                place, ids = self._learn(*words)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                flat, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
                each = sizes[place]
                ends = np.cumsum(each)
                all_ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[place] - (ends - each), each)]
                found = np.split(all_ids, np.cumsum(np.bincount(owner, each, len(places)).astype(np.int64))[:-1])
            for i, x in zip(places, found, strict=True):
                out[i] = x
        return out


@cache
def words(path: str, style: str) -> Words:
    """One for each Python worker."""
    return Words(path, style)
