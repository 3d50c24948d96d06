"""Each stage against what its operator decides, on the smallest table."""

import collections

import corpus_pipeline
from revlake.llm import common, jaccard_join, mixing

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, before, DATA), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            parts = jaccard_join.jaccard_components(before)
            assert docs.count() == parts.select("component_id").distinct().count()
        if name == "mixing":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in before.collect())
    assert docs.where("length < 1 or length > 2048").count() == 0 and docs.count() > 0


def test_packed_sequences_follow_the_mixture(spark):
    # 4 to 1 by weight, 1 to 1 by documents; one document of many pieces
    sources = {i: ("src0", "x")[i % 2] for i in range(8000)}
    rows = [(i, f"short text {i}", s) for i, s in sources.items()] + [(8000, "long " * 9000, "src0"), (1, "short text 1", "x"), (None, None, None)]
    packed = corpus_pipeline.packing_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), DATA).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == collections.Counter(i for i, _, _ in rows)
    assert all(r.offset + r.length <= 2048 for r in packed)
    spans = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(a[0] < b[0] or a[1] + a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    groups = collections.defaultdict(collections.Counter)
    for r in packed:
        groups[r.sequence_id >> 32][sources.get(r.doc_id)] += 1
    assert sorted(groups) == list(range(-(-len(packed) // 1024)))
    for g in range(4):  # until the 4,000 documents of src0 are used up
        n = groups[g]["src0"] + groups[g]["x"]
        assert abs(groups[g]["src0"] - n * 0.8) <= 128


def test_packing_takes_its_order_from_the_mixing_stage(spark, monkeypatch):
    rows = [(i, f"short text {i}", ("src0", "x")[i % 2]) for i in range(5000)] + [(7, "short text 7", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda d, weights: order(d, {"x": 9}))  # another mixture than packing would make
    mixed = common.stored(corpus_pipeline.mixing_stage(spark, docs, DATA), "test-mixed")
    monkeypatch.setattr(mixing, "mix", order)
    got = corpus_pipeline.packing_stage(spark, mixed, DATA).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    first = collections.Counter(r.doc_id % 2 for r in got if r.sequence_id >> 32 == 0 and r.doc_id is not None)
    assert first[1] > 5 * first[0] > 0
    want = [r.doc_id for r in order(docs, {"x": 9}).orderBy("position").limit(1024).collect()]
    assert collections.Counter(r.doc_id for r in got if r.sequence_id >> 32 == 0) == collections.Counter(want)
    # a table that is in no such order, or a part of one, is mixed
    for other in (common.stored(docs, "test-unmixed"), mixed.where("doc_id is null or doc_id >= 0 or true").repartition(3)):
        first = collections.Counter(r.doc_id % 2 for r in corpus_pipeline.packing_stage(spark, other, DATA).collect() if r.sequence_id >> 32 == 0 and r.doc_id is not None)
        assert first[0] > 3 * first[1]
