"""The prefix trie against one built in plain Python, with one shard and with many; parentheses and sums by themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from landspark.llm import prefix_trie
from landspark.llm.prefix_trie import PRIME, Parentheses, less, times

SCHEMA = "conv_id long, turn long, role string, text string, conv long, n long, path string, depth long"


def brute(rows, whole):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = 0 if whole else zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes, children, leaves, saved, out = {}, {}, {}, {}, []
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in children.get(k, [])) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[c] for c in children.get(k, []))
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, whole):
    df = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], SCHEMA).repartition(5)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in prefix_trie.trie_nodes(df, whole).collect()), key=str)


def made(rng, ids, longest, letters):
    out = []
    for c in ids:
        for t in range(rng.randrange(0, longest + 1)):
            out.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["u", "a", None]) if letters > 2 else "u", rng.choice(["x", "yy", "", None, "zé"][:letters])))
    return out


RNG = random.Random(2)
CASES = {
    "few words": made(RNG, range(260), 6, 2),
    "deep": made(RNG, range(90), 40, 1) + made(RNG, [100, 101, 7, 7], 300, 2),
    "nulls and negative ids": made(RNG, range(-205, -90), 8, 5) + made(RNG, range(95, 330), 8, 5) + [(None, 1, "u", "q")] * 3,
    "one": [(5, 0, "u", "abc")],
    "copies": [(c, t, "u", "k" * t) for c in range(300, 420) for t in range(4)],
    "one very long": [(300, t, "u", str(t % 3)) for t in range(3000)] + [(c, t, "u", "k") for c in range(301, 330) for t in range(4)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("whole", [False, True])
def test_nodes(spark, name, whole):
    assert found(spark, CASES[name], whole) == brute(CASES[name], whole)


def test_pieces_of_ids(spark, monkeypatch):
    """Ids of a node leave a task in pieces when they are many; the digest is the same."""
    ends = spark.createDataFrame([(1, 2, k % 3, c) for c, k in enumerate([0, 0, 0, 0, 1, 2] * 200)], "depth long, k1 long, k2 long, conv_id long").repartition(6)
    wanted = {k: hashlib.sha256(",".join(str(c) for c, x in enumerate([0, 0, 0, 0, 1, 2] * 200) if x == k).encode()).hexdigest() for k in range(3)}
    assert {r.k2: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()} == wanted


def test_parentheses():
    rng = random.Random(4)
    for n in (1, 2, 5, 300, 5000):
        depth = [0]
        for _ in range(n - 1):
            depth.append(rng.choice([depth[-1] + 1, rng.randrange(0, depth[-1] + 2)]))
        trie = Parentheses(np.array(depth))
        places, stack, close, at = [], [], {}, 0
        for k, d in enumerate(depth):
            while len(stack) > d:
                close[stack.pop()] = at
                at += 1
            stack.append(k)
            places.append(at)
            at += 1
        while stack:
            close[stack.pop()] = at
            at += 1
        assert trie.open.tolist() == places and trie.close(trie.open).tolist() == [close[k] for k in range(n)]


def test_products_modulo_the_prime():
    rng = random.Random(5)
    a, b = ([rng.randrange(PRIME) for _ in range(500)] + x for x in ([PRIME - 1, 0, 1, PRIME - 1], [PRIME - 1, PRIME - 1, PRIME - 1, 1]))
    assert times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % PRIME for x, y in zip(a, b, strict=True)]
    assert less(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [(x - y) % PRIME for x, y in zip(a, b, strict=True)]


def test_empty_table(spark):
    assert prefix_trie.trie_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
