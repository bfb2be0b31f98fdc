"""Substring dedup against brute force, with periodic, nested and overlapping repeats."""

import hashlib
import random
from collections import Counter

import pytest

from landspark.llm import substrings
from landspark.llm.queries import op1_substrings


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mine(df, window):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(df, window).collect()), key=str)


def corpus(seed, letters, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(letters)
    passages = [[word() for _ in range(rng.randrange(3, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        text: list = []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                text += rng.choice(passages)
            elif kind < 0.6:
                text += [word() for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 40)
            else:
                text += [word() for _ in range(rng.randrange(0, 80))]
        rows.append((i, " ".join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, rows[3][1]), (3, rows[3][1]), (4, "other text under a used id"), (None, rows[5][1]), (n + 3, "a\x1cb c \t\n\x0b d" * 20)]
    return rows


@pytest.mark.parametrize("seed,letters,window", [(1, "ab", 35), (2, [f"w{i}" for i in range(3000)], 35), (3, ["x", "é", "yy"], 5), (4, [f"w{i}" for i in range(40)], 8), (5, ["a"], 35)])
def test_against_brute_force(spark, seed, letters, window):
    rows = corpus(seed, letters)
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, name string").repartition(5)
    assert mine(df, window) == brute(rows, window)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op1_substrings(spark, sf).collect()), key=str)
    want = brute(rows, 35)
    assert got == want and sum(x[2] for x in want) > 1000


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
