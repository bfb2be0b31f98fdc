"""Words made to collide under polynomial hashes modulo 2**64 are different words."""

import numpy as np
import pytest

from landspark.llm import common, jaccard, substrings


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits[:n]), "".join("ba"[x] for x in bits[:n])


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_hashes_differ(n):
    data = np.frombuffer(" ".join(thue_morse(n)).encode(), np.uint8)
    for seed in (0, 1):
        h = common.word_hashes(data, np.array([0, len(data)]), seed)[0]
        assert h[0] != h[1]


def test_hash_is_of_the_bytes_of_the_word_alone():
    words = [b"a", b"ab", b"a\0", b"\0", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"abcdefghabcdefgh", b"abcdefghabcdefg", b"bcdefgha" * 9]
    data = np.frombuffer(b" ".join(words * 2), np.uint8)
    h = common.word_hashes(data, np.array([0, len(data)]))[0].tolist()
    assert h[: len(words)] == h[len(words) :] and len(set(h)) == len(words)


def test_operators_tell_them_apart(spark):
    x, y = thue_morse(2048)
    rest = " ".join(f"w{i}" for i in range(40))
    rows = [(1, " ".join([x] * 40)), (2, " ".join([y] * 40)), (3, f"{x} {x} {x} {x} {x}"), (4, f"{y} {y} {y} {y} {y}"), (5, f"{rest} {x} k l m n o p"), (6, f"q {y} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()}
    assert removed == {1: 40, 2: 40, 3: 0, 4: 0, 5: 40, 6: 40}
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df.filter("doc_id < 5")).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
