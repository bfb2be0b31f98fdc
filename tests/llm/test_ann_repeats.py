"""An id that is repeated more than k times near a query takes one place."""

import numpy as np

from landspark.llm import ann


def test_repeats_take_one_place(spark):
    rng = np.random.default_rng(2)
    asked = rng.normal(size=16)
    rows = [(1, asked + rng.normal(size=16) * 0.001) for _ in range(60)] + [(i, asked + rng.normal(size=16)) for i in range(2, 32)]
    schema = "vec_id long, embedding array<double>"
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in rows], schema)
    queries = spark.createDataFrame([(1000, asked.tolist())], schema)
    best = {}
    for i, v in rows:
        best[i] = min(best.get(i, np.inf), float(np.linalg.norm(v - asked)))
    want = sorted(best, key=best.get)[:10]
    assert [r.vec_id for r in ann.nearest(vectors, queries).orderBy("rank").collect()] == want
