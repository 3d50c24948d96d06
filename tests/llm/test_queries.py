"""Every registered query of the subpackage over whole tables: its SQL, the library, brute force or held-out accuracy."""

import collections
import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import public_tokenizers
from revlake.llm import queries

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, want = queries.QUERIES[name](spark, DATA), db.sql(queries.ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want.select(*columns).fetchall())


def test_op1(spark, documents):
    from tests.llm.test_texts import Parts, shingles

    sets = {i: shingles(t, 3) for i, t in documents.items()}
    p, ids = Parts(), sorted(sets)
    for k, i in enumerate(ids):
        p.root(i)
        for j in ids[:k]:
            x, y = sets[i], sets[j]
            if x and 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
                p.join(i, j)
    assert {tuple(r) for r in queries.op1_jaccard_join(spark, DATA).collect()} == {(i, len(s), p.root(i)) for i, s in sets.items()}


def test_op2(spark, documents):
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, DATA).collect()}
    assert set(got) == set(documents)
    for i, text in documents.items():
        assert got[i].n_lines == sum(bool(x.strip()) for x in text.split("\n"))
        if not got[i].n_removed:
            assert got[i].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op3(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in documents.items()}
    sequences, left = collections.defaultdict(list), {i: len(x) for i, x in ids.items()}
    for r in queries.op3_packing(spark, DATA).collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        left[r.doc_id] -= r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert not any(left.values())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, ids.values())) > 0.9 * 2048 * len(sequences)


def test_op4(spark, vectors):
    ids, v = vectors
    u = v / np.linalg.norm(v, axis=1)[:, None]
    found = collections.defaultdict(dict)
    for r in queries.op4_neighbours(spark, DATA).collect():
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = u @ u[k]
        s[k] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        got = found[int(ids[k])]
        assert sorted(got) == [1, 2, 3, 4, 5]
        hits, total = hits + len(best & {x for x, _ in got.values()}), total + 5
    assert hits >= 0.9 * total


def test_op5(spark, documents):
    bodies = {i: t.encode() for i, t in documents.items()}
    count = collections.Counter(b[k : k + 200] for b in bodies.values() for k in range(len(b) - 199))
    got = {r.doc_id: r for r in queries.op5_suffix_dedup(spark, DATA).collect()}
    for i, b in bodies.items():
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                mask[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op9(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.op9_token_counts(spark, DATA).collect():
        n = len(library.encode(documents[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[r.doc_id].encode()), n, n > 2048)


@pytest.mark.parametrize("name,label,rest,least", [("op7_quality", "quality", (4, 2), 0.95), ("op10_toxicity", "toxic", (3, 1), 0.9)])
def test_held_out_accuracy(spark, name, label, rest, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    hits, clean = [], []
    for r in rows:
        held_out = zlib.crc32(str(r.doc_id).encode()) % rest[0] == rest[1]
        assert r.held_out == held_out and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if held_out and labels.get(r.doc_id) in (0, 1):
            hits.append(r.predicted == labels[r.doc_id])
            if label == "toxic" and labels[r.doc_id] == 0:
                clean.append(r.predicted == 0)
    assert len(hits) > 50 and np.mean(hits) >= least and (not clean or np.mean(clean) >= 0.97)
