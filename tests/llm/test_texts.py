"""Operators on texts against brute force, with nulls, empty and long texts, repeats, clashing columns, no rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from revlake.llm import common, fasttokens, jaccard_join, line_dedup, mixing, packing, quality, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, source string, component_id string, n_lines string, position string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    base = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 90))) for _ in range(12)]
    passage = " ".join(rng.choice(words) + str(rng.randint(0, 900)) for _ in range(60))
    out = [None, "", " \n\t ", "one", "One", "two words", "x" * 5000, "ab" * 300]
    for b in base:
        out += [b, b]
        w = b.split()
        for k in (1, 2, 9):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "changed%d" % rng.randint(0, 99)
            out.append(" ".join(v))
        out.append(b[: len(b) // 2] + "\n" + passage + "\n" + b[len(b) // 2 :])
    return list(enumerate(out)) + [(3, "one"), (None, base[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 5 else None, "x", "y", "z") for i, t in texts], SCHEMA)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


class Parts:
    def __init__(self):
        self.up = {}

    def root(self, i):
        self.up.setdefault(i, i)
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("n,num,province", [(3, 90, 20000), (5, 80, 20000), (5, 80, 6)])
def test_jaccard_components(docs, texts, n, num, province):
    sets = [(i, shingles(t, n)) for i, t in texts if i is not None]
    p = Parts()
    for a, x in sets:
        p.root(a)
        for b, y in sets:
            if x and y and 100 * len(x & y) >= num * len(x | y):
                p.join(a, b)
    got = jaccard_join.jaccard_components(docs, n, num, 100, province).collect()
    assert len(got) == len(texts)
    want = collections.Counter((i, len(s), p.root(i)) for i, s in sets)
    assert collections.Counter(tuple(r) for r in got if r.doc_id is not None) == want
    orphans = sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None)
    assert orphans[0] == (0, None) and orphans[1][1] == p.root(8)


def test_keys_are_shared_by_all_linked_pairs():
    rng = np.random.default_rng(1)
    for num in (80, 90):
        for size in (1, 2, 5, 9, 10, 11, 19, 40, 333, 2000):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            for _ in range(20):
                drop = rng.random(len(a)) < rng.random() * (1 - num / 100)
                b = np.unique(np.concatenate([a[~drop], rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 10), np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both):
                    assert set(jaccard_join.keys(a, num, 100)) & set(jaccard_join.keys(b, num, 100))


def test_line_dedup(docs, texts, spark):
    rows = [(i, t) for i, t in texts if i is not None][:-1]
    occurrences, sets = [], {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            line = re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ").lower()
            if line:
                occurrences.append((i, k, line))
                b = line.encode()
                sets[line] = {b[j : j + 8] for j in range(max(1, len(b) - 7))}
    p = Parts()
    for a, x in sets.items():
        p.root(a)
        for b, y in sets.items():
            if 100 * len(x & y) >= 80 * len(x | y):
                p.join(a, b)
    seen, gone = set(), collections.defaultdict(set)
    for i, k, line in sorted(occurrences):
        if p.root(line) in seen:
            gone[i].add(k)
        seen.add(p.root(line))
    part = spark.createDataFrame([(i, t, "s", "c", "n", "p") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(part).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i].text == want and got[i].n_removed == len(gone[i]) and got[i].component_id == "c"
    assert line_dedup.dedup_lines(docs).count() == len(texts)


def test_line_dedup_finds_short_lines(spark):
    """Dated, numbered and one-word lines, whose links brute force knows."""
    rng = random.Random(11)
    lines = ["2023-01-01 12:34:56", "2023-01-01 12:34:57"]
    for k in range(40):
        lines += [f"20{rng.randint(10, 99)}-0{k % 9 + 1}-1{k % 10} {rng.randint(10, 99)}:{rng.randint(10, 99)}:{x}" for x in rng.sample(range(10, 60), 2)]
        host = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
        lines += ["a" + host, "b" + host, f"{k}7 " + host[:20] + " " + host[20:], f"{k}8 " + host[:20] + " " + host[20:]]
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} for x in lines]
    p = Parts()
    for i, x in enumerate(sets):
        p.root(i)
        for j in range(i):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                p.join(i, j)
    want = {i for i in range(len(lines)) if p.root(i) != i}
    assert 1 in want and len(want) > 60
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed = 1")
    assert {r.doc_id for r in got.collect()} == want


def test_suffix_columns():
    rng = random.Random(2)
    import tempfile

    for _ in range(60):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        with tempfile.TemporaryDirectory() as folder:
            c = suffix_dedup.Columns(strings, folder)
        order = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert [strings[k][i - 1] + 1 if i else 0 for _, k, i in order] == c.bwt.tolist()
        common = lambda a, b: next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert [0] + [common(a[0], b[0]) for a, b in zip(order, order[1:], strict=False)] == c.lcp.tolist()


@pytest.mark.parametrize("group", [20000, 2])
def test_suffix_dedup(docs, texts, group):
    bodies = [(i, (t or "").encode()) for i, t in texts]
    count = collections.Counter(b[k : k + 200] for _, b in bodies for k in range(len(b) - 199))
    want = collections.Counter()
    for i, b in bodies:
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                mask[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        want[i, len(b), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.remove_repeats(docs, group=group).drop("spans").collect()
    assert collections.Counter(tuple(r) for r in got) == want


def test_tokens_equal_the_library():
    rng = random.Random(1)
    alphabet = " '  \n\tstmdrvelaZİſéñß1２²½.,!?Σσς中文가 ́é"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    odd += ["'s", "it'stuff", "''s", " 's", "a  \n b", "<|endoftext|> x", "", None, "I'LL we'Re don'T"]
    for name, style in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        words = fasttokens.Words(public_tokenizers.path(name), style)
        want = [e.ids for e in words.library.encode_batch([t or "" for t in odd], add_special_tokens=False)]
        assert [x.tolist() for x in words.ids(odd)] == want and words.counts(odd).tolist() == list(map(len, want))


def test_packing_is_a_round_trip(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = fasttokens.Words(path, "byte")
    want = collections.defaultdict(list)
    for (i, _), ids in zip(texts, words.ids([t for _, t in texts]), strict=True):
        want[i].append([*ids.tolist(), 1])
    rows = packing.pack(docs, path, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    for r in rows:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in want[r.doc_id])
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_first_fit_decreasing_against_a_plain_one():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 33, 200)
    bins, offsets = packing.first_fit_decreasing(lengths, 32)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        j = next((j for j, r in enumerate(room) if r >= lengths[i]), len(room))
        if j == len(room):
            room.append(32)
        assert bins[i] == j and offsets[i] == 32 - room[j]
        room[j] -= lengths[i]


def test_token_counts_use_the_cache(docs, texts, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    words = fasttokens.Words(path, "word")
    n = words.counts([t for _, t in texts])
    want = collections.Counter((i, len((t or "").encode()), int(k), bool(k > 10)) for (i, t), k in zip(texts, n, strict=True))
    for _ in range(2):
        got = token_counts.token_counts(docs, path, f"{tmp_path}/cache", limit=10)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert token_counts.read_cache(docs.sparkSession, f"{tmp_path}/cache").count() == len({re.sub("[ \t\n\x0b\f\r]+", " ", t or "") for _, t in texts})


def test_mixing_stays_within_a_block(docs, texts, spark):
    weights = {"a": 5, "b": 2}
    rows = spark.createDataFrame([(i, "abc"[min(2, i % 4)]) for i in range(4000)] + [(None, None), (1, "b"), (1, "b")], "doc_id long, source string")
    got = sorted(mixing.mix(rows, weights, block=4).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(got)))
    share = {"a": 5, "b": 2, "c": 1, None: 1}
    last = {s: max(r.slot for r in got if r.source == s) for s in share if s}
    count = collections.Counter()
    for slot, source in sorted({(r.slot, r.source) for r in got}):
        if slot >= min(last.values()):
            break
        count[source] += 1
        for s in "abc":
            assert abs(count[s] - (slot + 1) * share[s] / 9) < 1
    assert mixing.mix(docs, {}).count() == len(texts)
    with pytest.raises(ValueError):
        mixing.mix(rows, {"a": 0})


def test_models_on_empty_and_odd_texts(docs, texts, spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    known = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(docs, known).count() == len(texts)
    bad = spark.createDataFrame([(i, f"plain words {i} and " + ("nastyword " if i % 2 else "nice ") + f"more {i}", i % 2) for i in range(600)], "doc_id long, text string, toxic int")
    got = toxicity.toxicity(bad, bad).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) == 600
    assert toxicity.reject(bad, bad).count() == 300


@pytest.mark.parametrize("head", [0, 50, toxicity.HEAD])
def test_evidence_uses_exact_keys_whatever_is_broadcast(spark, head):
    rng = random.Random(3)
    # so many distinct pairs that arrays of 2**21 places would mix thousands of them up
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(3, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 25))), i % 2) for i in range(3000)]
    odd = [(-1, None), (-2, ""), (-3, "..."), (-4, "one"), (-5, rows[0][1]), (-5, rows[0][1]), (None, "ab " + rows[1][1])]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows[:300]] + odd, "doc_id long, text string")
    seen, left = toxicity.ratios(toxicity.word_counts(labelled.select("text", "toxic")), 1.0)
    values = common.stored(toxicity.word_values(toxicity.words_of(docs), seen, left), "test-values")
    top = {r.word: r.value for r in values.orderBy("n", "word").limit(head).collect()}
    got = toxicity.score_all(docs, values, spark.sparkContext.broadcast(top)).collect()
    seen, left = {(r.context, r.next): r.ratio for r in seen.collect()}, {r.context: r.rest for r in left.collect()}

    def evidence(text):
        w = re.findall(r"\w+", (text or "").lower())
        each = [sum(seen.get(p, left.get(p[0], 0.0)) for p in toxicity.parts(x)) for x in w]
        k = min(toxicity.RUN, len(w))
        return max((sum(each[i : i + k]) / max(toxicity.LEAST, sum(len(x) + 1 for x in w[i : i + k])) for i in range(len(w) - k + 1)), default=0.0) if w else 0.0

    want = sorted((i if i is not None else -9, evidence(t)) for i, t in [r[:2] for r in rows[:300]] + odd)
    got = sorted((r.doc_id if r.doc_id is not None else -9, r.evidence) for r in got)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-7)


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(5)
    import itertools

    u, t = rng.normal(size=5), rng.normal(size=(2, 2))
    p, pairs, z = quality.forward_backward(u[None], np.array([5]), t)
    total, one, moves = 0.0, np.zeros(5), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=5):
        w = np.exp(u @ np.array(y) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        one += w * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            moves[a, b] += w
    assert np.allclose(p[0], one / total) and np.allclose(pairs, moves / total) and np.isclose(z[0], np.log(total))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(empty, path).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert mixing.mix(empty, {}).count() == 0


def test_marks_and_sketches_lose_no_linked_pair(spark):
    """Lines with repeated shingles, short and long: what tells pairs apart before the texts are compared never parts a
    linked pair, and parts most pairs of long lines that are fairly alike but not linked."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    lines, pairs = [], []
    for size in [1, 2, 3, 8, 60, 120] * 20:
        a = [rng.choice(words) for _ in range(size)] * rng.choice((1, 1, 3))
        b = [rng.choice(words) if rng.random() < rng.choice((0.01, 0.05, 0.1)) else w for w in a]
        lines += [" ".join(a), " ".join(b)]
        pairs.append((len(lines) - 2, len(lines) - 1))
    shingles = [{x[j : j + 8] for j in range(max(1, len(x) - 7))} for x in lines]
    rows = common.stored(spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "node long, rid long, line string"), "test-lines")
    signatures = common.stored(line_dedup.signed(rows), "test-signatures")
    of = lambda x: signatures.select(*(F.col(c).alias(f"{c}_{x}") for c in signatures.columns))
    asked = spark.createDataFrame(pairs, "node_a long, node_b long").join(of("a"), "node_a").join(of("b"), "node_b")
    apart = {(r.node_a, r.node_b) for r in asked.where(line_dedup.unlike("a", "b", 80, 100)).collect()}
    linked = {(i, j) for i, j in pairs if 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])}
    assert linked and linked != set(pairs) and not apart & linked
    marked = {r.rid: set(r.m) for r in rows.select("rid", line_dedup.marks(F.col("line").cast("binary")).alias("m")).collect()}
    differ = {(i, j): len(marked[i] ^ marked[j]) for i, j in pairs}
    assert all(n <= len(shingles[i] ^ shingles[j]) for (i, j), n in differ.items())
    assert all(n >= 0.9 * len(shingles[i] ^ shingles[j]) for (i, j), n in differ.items())


def test_texts_scored_together_fare_as_each_alone():
    rng = random.Random(3)
    known = {f"w{k}": rng.randint(-(10**12), 10**12) for k in range(50)}
    texts = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 40)] * 30 + [None, " w1 ", "w1 w2 w3"]
    rng.shuffle(texts)
    got = toxicity.runs_of(texts, known)
    for t, (best, rest, others) in zip(texts, got, strict=True):
        w = (t or "").split()
        k = min(toxicity.RUN, len(w))
        runs = [w[i : i + k] for i in range(len(w) - k + 1)] if w else []
        sure = [sum(known[x] for x in r) / max(toxicity.LEAST, sum(len(x) + 1 for x in r)) / toxicity.UNIT for r in runs if all(x in known for x in r)]
        assert best == (pytest.approx(max(sure)) if sure else None if runs else 0.0)
        assert set(others) == {x for x in w if x not in known} and len(rest) <= len(runs) - len(sure)


def test_sketches_part_what_is_fairly_alike(spark, monkeypatch):
    """Variants of one long line, an eighth of the words changed in most: 21,945 pairs, of which no more than a few for
    each line are left to be compared as texts, and all links are found."""
    rng = random.Random(29)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    far = [" ".join(rng.choice(words) if rng.random() < 0.12 else w for w in base) for _ in range(150)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(60)]
    lines = sorted({*far, *near})
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} for x in lines]
    p = Parts()
    for i, x in enumerate(sets):
        p.root(i)
        for j in range(i):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                p.join(i, j)
    asked, verify = [], line_dedup.verified

    def counted(pairs, *rest):
        asked.extend(pairs.select("a", "b").collect())
        return verify(pairs, *rest)

    monkeypatch.setattr(line_dedup, "verified", counted)
    rows = common.stored(spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "node long, rid long, line string"), "test-lines")
    parts = {r.node: r.component for r in line_dedup.components(rows, 80, 100).collect()}
    assert {i: p.root(i) for i in range(len(lines)) if p.root(i) != i} == parts
    assert len(asked) < 5 * len(lines)


def test_pairs_of_a_band_meet_in_one_round(spark, monkeypatch):
    """Forty lines, each two in two of 30 words apart, alike by 0.75 to 0.8: bands of more lines than have centres in the
    first round. No pair is linked, and few are compared in two rounds: only those that share bands of different sizes."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    base = [word() for _ in range(30)]
    lines = [" ".join([*base[:10], word(), *base[11:20], word(), *base[21:]]) for _ in range(40)]
    asked, verify = [], line_dedup.verified

    def counted(pairs, *rest):
        asked.append([(r.a, r.b) for r in pairs.select("a", "b").collect()])
        return verify(pairs, *rest)

    monkeypatch.setattr(line_dedup, "verified", counted)
    rows = common.stored(spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "node long, rid long, line string"), "test-lines")
    assert line_dedup.components(rows, 80, 100).count() == 0
    later = collections.Counter(frozenset(p) for call in asked[1:] for p in call)
    assert len(asked) > 3 and len(later) > 100 and sum(n > 1 for n in later.values()) < 0.15 * len(later)


def test_lines_are_verified_with_and_without_arrays(spark, monkeypatch):
    """Repeated shingles, lines shorter than a shingle, bytes beyond ASCII; a pair makes no row of each shingle."""
    rng = random.Random(37)
    words = ["".join(rng.choice("abcdefgh\u00e9\u4e2d") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    lines = ["", "a", "b", "aaaaaaa", "a" * 8, "a" * 9, "a" * 500, "ab" * 300]
    for size in [2, 5, 30, 90] * 25:
        a = [rng.choice(words) for _ in range(size)] * rng.choice((1, 1, 3))
        lines += [" ".join(a), " ".join(rng.choice(words) if rng.random() < 0.04 else w for w in a)]
    pairs = [(i, j) for i in range(8) for j in range(i)] + [(i, i + 1) for i in range(8, len(lines) - 1)]
    sets = [{b[j : j + 8] for j in range(max(1, len(b) - 7))} for b in (x.encode() for x in lines)]
    want = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    texts = common.stored(spark.createDataFrame(list(enumerate(lines)), "node long, line string"), "test-lines")
    asked = common.stored(spark.createDataFrame(pairs, "a long, b long"), "test-pairs")
    longest = max(len(x.encode()) for x in lines)
    got = line_dedup.verified(asked, texts, 80, 100, longest)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want
    monkeypatch.setattr(line_dedup, "LONG", 100)
    assert sorted(map(tuple, line_dedup.verified(asked, texts, 80, 100, longest).collect())) == sorted(want)


def test_words_equal_the_expression():
    rng = random.Random(5)
    every = [chr(i) for i in range(256)] + list("İſſΣσßẞ中文가́² \u0085\u2028")
    texts = ["".join(rng.choice(every if k % 3 else every[:256]) for _ in range(rng.randint(0, 60))) for k in range(3000)] + [None, ""]
    for x in [*texts, *every]:
        assert toxicity.words_in(x) == toxicity.WORD.findall((x or "").lower())
