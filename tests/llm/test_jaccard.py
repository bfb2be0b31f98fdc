"""Near duplicates against all pairs by brute force."""

import random

import numpy as np
import pytest

from landspark.llm import graph, jaccard
from landspark.llm.queries import op3_jaccard


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, x in sets.items() for s in x if s]
    where: dict = {}
    for k, (_, s) in enumerate(flat):
        for t in s:
            where.setdefault(t, []).append(k)
    for k, (i, s) in enumerate(flat):
        seen: dict = {}
        for t in s:
            for j in where[t]:
                if j > k:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= 75 * (len(s) + len(flat[j][1]) - both):
                a, b = sorted((find(i), find(flat[j][0])))
                parent[b] = a
    return sorted((i, len(shingles(t)), find(i)) for i, t in rows)


def family(seed, n, words, edits, vocabulary=5000):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(vocabulary)}"
    rows, i = [], 0
    boiler = [word() for _ in range(30)]
    while len(rows) < n:
        base = [word() for _ in range(rng.randrange(*words))] + (boiler if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, edits)):
                k = rng.randrange(len(text) + 1)
                text[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
            rows.append((i, " ".join(text)))
            i += rng.randrange(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,words,edits", [(1, (1, 12), 3), (2, (10, 90), 6), (3, (40, 400), 14), (4, (200, 900), 30)])
def test_against_all_pairs(spark, seed, words, edits):
    rows = family(seed, 300, words, edits) + [(100_000, None), (100_001, ""), (100_002, " \t")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key long, n int").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == brute(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3_jaccard(spark, sf).collect())
    assert got == brute(rows)


def test_edges(spark):
    rows = [(5, "a b c d e f g h"), (5, "A b c d e f g h"), (3, "a B c d e f g h"), (None, "a b c d e f g h"), (9, "x"), (8, "X"), (7, "w " * 100_000), (6, "w w w w w w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted([(0, 4, None), (3, 4, 3), (5, 4, 3), (5, 4, 3), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 8)], key=str)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard.keep_one(df).collect()) == [0, 3, 6, 8]


def test_ids_with_several_texts(spark):
    a, b, c = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z")
    rows = [(9, a), (4, a), (9, b), (7, b), (7, c), (8, c), (3, "lone text"), (9, "own text of nine is here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == sorted((i, len(shingles(t)), 3 if i == 3 else 4) for i, t in rows)


def test_blocks_outnumber_differences():
    rng = np.random.default_rng(0)
    for m in list(range(1, 600)) + [1023, 1024, 1025, 5000, 70_000]:
        bits, top = (x[0] for x in jaccard.band(np.array([m])))
        assert m <= top
        blocks = len(np.unique(rng.integers(0, 2**63, m).astype(np.uint64) >> np.uint64(63 - bits)))
        assert blocks > m // 3


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    parent: dict = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(parent)}
