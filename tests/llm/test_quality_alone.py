"""A text's score does not depend on the text behind it."""

import numpy as np
import pytest

from landspark.llm import quality


def test_neighbours_do_not_matter():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 256, n, np.uint8).tobytes() for n in (1, 7, quality.CHUNK * quality.STEP, quality.CHUNK * quality.STEP * 2, 5000, quality.CHUNK * quality.STEP - 1)]
    net = quality.Network()
    score = lambda xs: net.scores(np.frombuffer(b"".join(xs), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in xs]))))
    want = [score([x])[0] for x in texts]
    assert score(texts) == pytest.approx(want, abs=1e-5)
    assert score(texts[::-1])[::-1] == pytest.approx(want, abs=1e-5)
