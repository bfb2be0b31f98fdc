"""Scores against a plain convolution, and the same in any partitioning."""

import numpy as np
import pytest

from landspark.llm import quality


def plain(net, text):
    """The network by its definition: every filter at every step of every chunk, one text, no arrays of steps."""
    n, step, parts = quality.CHUNK, quality.STEP, quality.PARTS
    chunks = max(1, -(-len(text) // (n * step)))
    padded = text + b"\0" * (chunks * n * step - len(text))
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    tops = []
    for c in range(chunks):
        best = np.full(quality.FILTERS, -np.inf)
        for k in range(n):
            at = (c * n + k) * step
            if at + step * parts > len(padded):  # the filter would reach over the end
                continue
            response = w["bias"].copy()
            for p in range(parts):
                piece = padded[at + p * step : at + (p + 1) * step]
                response += np.concatenate([w["embed"][b] for b in piece]) @ w["filters"][p]
            best = np.maximum(best, response)
        tops.append(np.tanh(best))
    z = np.concatenate([np.mean(tops, 0), np.max(tops, 0)]) @ w["out"] + w["intercept"][0] + net.shift
    return 1 / (1 + np.exp(-z))


def test_against_plain_convolution():
    rng = np.random.default_rng(5)
    net = quality.Network(2)
    net.w["intercept"][:] = 0.3
    texts = [b"", b"a", b"abcdefgh", b"x" * 255, b"y" * 256, b"z" * 257, *(rng.integers(0, 256, n, np.uint8).tobytes() for n in (9, 500, 511, 512, 513, 3000))]
    got = net.scores(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert got == pytest.approx([plain(net, t) for t in texts], abs=1e-5)


def test_any_partitioning_gives_the_same_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = quality.Network(4)
    one, many = ({r.doc_id: r.score for r in quality.score_documents(docs.repartition(n), net).collect()} for n in (1, 200))
    assert one == many
