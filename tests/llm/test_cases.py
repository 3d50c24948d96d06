"""Cases that operators share: clashing names, repeated queries, odd lengths, large parameters, links by path, recall."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from revlake.llm import common, exact_topk, jaccard_join, line_dedup, mixing, neighbours, suffix_dedup

DATA = "/root/testdata/sf0.001"
#: Names that operators use inside.
CLASHING = ["row", "rid", "uid", "node", "line", "band", "cut", "s", "w", "at", "block", "slot", "position", "n_lines", "_drop", "_key", "_uid", "_lines", "_text", "_gone", "id"]


@pytest.fixture(scope="module")
def odd_rows(spark):
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    text = "one line of some length here\nanother line that is not like it at all\n" + " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (2, text), (2, text), (None, text), (None, None), (3, ""), (4, None), (5, "x" * 90_000), (6, "ordinary words, " * 9000), (7, " \n\t ")]
    rows = [(i, t, "en", "src0" if k % 2 else None, len(t or ""), *CLASHING) for k, (i, t) in enumerate(rows)]
    rows[0] = (*rows[0][:5], *(f"own {c}" for c in CLASHING))
    return rows, fields


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_on_no_rows(spark, odd_rows, name):
    rows, fields = odd_rows
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(rows, fields)
    got = stage(spark, docs, DATA)
    found = got.collect()
    ids = collections.Counter(r.doc_id for r in found if name != "packing" or r.start == 0)
    if name == "near_duplicates":
        # of the five rows with one text a single one stays, the first by id
        assert ids == collections.Counter([1, None, 3, 4, 5, 6, 7])
    else:
        assert ids == collections.Counter(r[0] for r in rows)
    if name != "packing":
        assert got.columns == docs.columns
        first = next(r for r in found if r.doc_id == 1)
        assert all(first[c] == f"own {c}" for c in CLASHING)
    if name == "line_dedup":
        by_id = {r.doc_id: r.text for r in found if r.doc_id}
        assert by_id[5] == "x" * 90_000 and by_id[3] == "" and by_id[4] is None and by_id[7] == " \n\t "
        # rows without id come first, so their copies of the lines are the ones that stay
        assert by_id[1] == by_id[2] == ""
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_repeated_queries_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(9, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id in (0, 50, 1000)").unionByName(df.where("vec_id = 50"))
    for search in (neighbours.nearest, exact_topk.exact_topk):
        got = collections.defaultdict(list)
        for r in search(df, queries).collect():
            got[r.query_id].append((r["rank"], r.vec_id))
        assert {q: len(x) for q, x in got.items()} == {0: 5, 50: 10, 1000: 5}
        assert len(set(got[50])) == 5 and {i for _, i in got[50]}.isdisjoint({50})
        assert all(i > 1000 for _, i in got[1000])
    assert exact_topk.exact_topk(df.limit(0), queries).count() == 0


def test_repeats_longer_than_a_byte_counts(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(1, "A" + passage), (2, "B" + passage + "C"), (3, passage[:299])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs, size=300).collect()} == {1: 900, 2: 900, 3: 0}


def test_schedule_keeps_every_source_within_a_block():
    rng = random.Random(4)
    for _ in range(40):
        classes = [(w, rng.randint(1, 6)) for w in sorted({rng.randint(1, 12) for _ in range(rng.randint(1, 4))})]
        total = sum(w * n for w, n in classes)
        slots = {}
        for w, j, first, till, slot in mixing.schedule(classes):
            for i in range(first, till):
                slots[slot + i - first] = (w, i)
        assert sorted(slots) == list(range(total))
        count = collections.Counter()
        for t in range(total):
            count[slots[t]] += 1
            assert all(abs(count[w, i] - (t + 1) * w / total) < 1 for w, n in classes for i in range(n))


def test_mixing_takes_any_number_of_sources(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "concat('host', id % 12000) AS source")
    got = mixing.mix(rows, {"host1": 3}, block=1)
    assert got.count() == 30_000 and got.select("position").distinct().count() == 30_000
    assert got.selectExpr("max(position)").first()[0] == 29_999


def test_links_come_from_pivots():
    rng = np.random.default_rng(8)
    for num, sizes in ((80, (2, 5, 40)), (90, (200,))):
        for n in sizes:
            base = [np.unique(rng.integers(0, 1 << 62, 150, np.uint64)) for _ in range(max(1, n // 9))]
            sets = []
            for k in range(n):
                b = base[k % len(base)].copy()
                b[rng.random(len(b)) < rng.random() * 0.12] = rng.integers(0, 1 << 62, 1, np.uint64)[0]
                sets.append(np.unique(b))
            region = jaccard_join.Region(np.concatenate(sets), np.array([len(s) for s in sets]), num, 100)
            region.solve()
            linked = {(i, j) for i in range(n) for j in range(i) if 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= num * (len(sets[i]) + len(sets[j]) - x)}
            forest = jaccard_join.Forest(n)
            for i, j in linked:
                forest.join(i, j)
            assert [region.forest.root(i) for i in range(n)] == [forest.root(i) for i in range(n)]
            assert region.by == {"pivots": len(region.links), "shingles": 0}


def test_small_bounds_give_the_same_components(spark):
    """Provinces and bytes bounded so low that the distributed rounds and the pairs of blocks do the work."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(120):
        w = list(base[i % 4])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.jaccard_components(docs, 3, 80, 100).collect()))
    assert len({c for _, _, c in want}) < 120
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs, 3, 80, 100, province=10, volume=1500).collect())) == want


def test_line_recall_against_all_pairs(spark):
    """Lines of the smallest table with variants of few changed words: at least 99 % of the linked pairs end together."""
    rng = random.Random(21)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").limit(60).collect()]
    lines = sorted({" ".join(x.lower().split()) for t in texts for x in t.split("\n")} - {""})[:350]
    for line in list(lines):
        w = line.split(" ")
        for k in range(rng.choice((0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice(("changed", "words", "here", f"n{k}"))
        lines.append(" ".join(w))
    lines = sorted(set(lines))
    sets = [{b[j : j + 8] for j in range(max(1, len(b) - 7))} for b in (x.encode() for x in lines)]
    holders = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for s in x:
            holders[s].append(i)
    pairs = {(i, j) for h in holders.values() if len(h) < 60 for i in h for j in h if i < j}
    linked = [(i, j) for i, j in pairs if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    rows = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "node long, rid long, line string")
    parts = {r.node: r.component for r in line_dedup.components(common.stored(rows, "test-lines"), 80, 100).collect()}
    together = sum(parts.get(i, i) == parts.get(j, j) for i, j in linked)
    assert len(linked) > 150 and together >= 0.99 * len(linked)


def test_models_on_no_rows_and_on_very_long_texts(spark, tmp_path):
    import public_tokenizers
    from revlake.llm import quality, token_counts, toxicity

    known = spark.createDataFrame([(i, f"plain text number {i} with more words {'awfulword ' * (i % 2)}", i % 2) for i in range(300)], "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    none = known.limit(0).drop("toxic")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert toxicity.toxicity(none, known).count() == 0 and toxicity.reject(none, known).count() == 0
    assert quality.quality(none, marks).count() == 0
    assert token_counts.token_counts(none, path, f"{tmp_path}/none").count() == 0
    long = "plain text with more words\n" * 6000
    docs = spark.createDataFrame([(1, long), (2, long + "awfulword awfulword awfulword"), (3, "x" * 200_000)], "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, known).collect()}
    assert found[1] == 0 and found[2] == 1
    assert {r.doc_id: r.n_lines for r in quality.quality(docs, marks).collect()}[1] >= 6000
    assert {r.doc_id: r.over_limit for r in token_counts.token_counts(docs, path, f"{tmp_path}/long").collect()} == {1: True, 2: True, 3: True}
