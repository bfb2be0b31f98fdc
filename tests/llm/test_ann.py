"""Nearest neighbours against brute force."""

import numpy as np

from landspark.llm import ann


def brute(rows, queries, k):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asks: dict = {}
    for i, v in rows:
        if i in queries and any(i == j and len(v or ()) == len(x) for j, x in good) and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            asks[i] = min(asks.get(i, list(v)), list(v))
    out = {}
    for i, q in asks.items():
        best: dict = {}
        for j, x in good:
            if j != i and len(x) == len(q):
                d = float(np.sqrt(((x - np.asarray(q, float)) ** 2).sum()))
                best[j] = min(best.get(j, d), d)
        out[i] = sorted((d, j) for j, d in best.items())[:k]
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = {i for i, _ in rows if i % 100 == 0}
    got: dict = {}
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, queries, 10)
    assert set(got) == set(want)
    hits = sum(len({j for _, j, _ in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for i, x in got.items():
        assert [r for r, _, _ in sorted(x)] == list(range(1, len(x) + 1))
        assert np.allclose(sorted(s for _, _, s in x), [d for d, _ in want[i]])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [0.9, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [5.0, 5.0])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, dim int").repartition(3)
    got: dict = {}
    for r in ann.nearest(df, df.filter("vec_id IN (0, 9, 1)"), k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 5)))
    assert {i: sorted(x) for i, x in got.items()} == {0: [(1, 7, 0.0), (2, 8, 0.0), (3, 10, 6.40312)]}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
