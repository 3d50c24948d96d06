import numpy as np

from revlake.llm import exact_topk, neighbours


def frame(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 16))
    v[100:130] = v[7]
    rows = [(i, x.tolist(), "e") for i, x in enumerate(v)]
    rows += [(1000, None, "e"), (1001, [0.0] * 16, "e"), (1002, [float("nan")] * 16, "e"), (1003, [float("inf")] + [0.0] * 15, "e"), (1004, [None] * 16, "e"), (1005, [1.0], "e"), (None, [1.0] * 16, "e")]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def test_exact_topk(spark):
    v, df = frame(spark)
    w = np.floor(v * 256).astype(np.int64)
    w = np.vstack([w, np.zeros((1, 16), np.int64)])
    ids = np.append(np.arange(900), 1001)
    got = {}
    for r in exact_topk.exact_topk(df, df.where("vec_id % 50 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 900, 50):
        s = w @ w[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert sorted(got[q]) == [(k + 1, ids[i], s[i]) for k, i in enumerate(order)]


def test_neighbours(spark):
    v, df = frame(spark)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[q] = -2
        true = np.lexsort((np.arange(900), -s))[:5]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5] and all(np.isclose(x, s[i]) for _, i, x in found)
        hit += len(set(true) & {i for _, i, _ in found})
    assert hit >= 0.9 * 5 * 18
    assert [i for _, i, _ in sorted(got[100])] == [7, 101, 102, 103, 104]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
