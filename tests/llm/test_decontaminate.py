"""Decontamination against a plain search for every window, with one block of windows and with many."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from landspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, hits string, windows long, words string", "item_id long, text string, window long, words string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width):
    windows, out = {}, []
    for i, text in items:
        w = words(text)
        n = min(width, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add("" if i is None else str(i))
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (which := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= which
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), sorted(hit)))
    return sorted(out, key=str)


def spans(row):
    return [k for h in row.hits for k in range(h.begin, h.end)]


@pytest.mark.parametrize("letters,width,block", [(2, 10, 5), (3, 4, 1 << 20), (6, 5, 7), (3, 10, 1 << 20)])
def test_windows(spark, letters, width, block):
    rng = random.Random(letters * width)
    make = lambda n: "".join(rng.choice(["a", "B", "é", "Zz9", "0", "X"][:letters]) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    items = [(i, make(rng.randrange(0, 14))) for i in range(14)] + [(None, "q r s"), (3, "zz"), (50, None), (51, ""), (0, "q r s"), (0, "q r s")]
    docs = [(i, make(rng.randrange(0, 60))) for i in range(120)] + [(None, None), (5, ""), (5, "q R S q"), (5, "q R S q"), (None, "q R S q"), (7, "w" * 5000)] + [(200 + i, items[i % 14][1]) for i in range(28)]
    docs += [(300, make(4000))]
    d = spark.createDataFrame([(*x, "h", 1, "w") for x in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*x, 1, "w") for x in items], ITEMS)
    got = decontaminate.decontaminate(d, b, width=width, block=block).collect()
    wanted = brute(docs, items, width)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, spans(r)) for r in got), key=str) == wanted
    assert 0 < sum(x[5] for x in wanted) < len(wanted)


def test_items_that_share_a_window(spark):
    """A window of many items and of many documents: the items are listed once for all documents that hold it."""
    common = "answer the following question by choosing one of these four letters"
    items = [(i, f"{common} number{i} is it so or is it not so") for i in range(300)]
    docs = [(i, f"x{i} {common} y{i}") for i in range(200)] + [(1000, items[7][1])]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r.doc_id: r for r in found.collect()}
    assert all(rows[i].n_items == 300 and rows[i].n_hit == 11 for i in range(200)) and rows[1000].n_items == 300
    assert rows[0].items_sha256 == rows[1000].items_sha256 == hashlib.sha256(",".join(sorted(str(i) for i in range(300))).encode()).hexdigest()


def test_rarest_shingle():
    """A window is probed with the shingle that documents hold least often, and not at all if one is in no document."""
    import numpy as np

    held = decontaminate.Block(np.array([5, 6]), ["a b c d", "a b c e"])
    at, h = decontaminate.Words(np.frombuffer(b"a b c d", np.uint8), np.array([0, 7])).shingles(3)
    held.probe_with(dict(zip(h.view(np.int64).tolist(), (9, 2), strict=True)))
    probe, of, place = held.probe[0]
    assert at.tolist() == [0, 1] and (probe.tolist(), of.tolist(), place.tolist()) == ([int(h[1])], [0], [1])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c", "h", 1, "w"), (None, None, None, None, None)], DOCS)
    assert decontaminate.decontaminate(docs, items).count() == 0
    got = decontaminate.decontaminate(some, items).select("n_words", "n_hit", F.col("contaminated").cast("int")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0), (3, 0, 0)]
    assert decontaminate.decontaminate(docs, spark.createDataFrame([(1, "a b c", 1, "w")], ITEMS)).count() == 0
