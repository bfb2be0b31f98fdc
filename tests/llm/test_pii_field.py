"""The skip chain: what it adds, that it is the skip weights that do it, and that labels cross any number of repeats."""

import numpy as np
import pytest

from landspark.llm import pii


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def added(text, field):
    base, _ = pii.base_spans(text)
    return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.further_spans([text], [base], field)[0]]


CASES = {
    "Call +48601234567 today or ring 48601234567 later": [("phone", "48601234567")],
    "Call +48 601 234 567 or 601 234 567 or 601234567": [("phone", "601 234 567"), ("phone", "601234567")],
    "Card 4111-1111-1111-1111, which is 4111/1111/1111/1111 here": [("card", "4111/1111/1111/1111")],
    "call +48601234567 or the next desk 48601234568 ok": [("phone", "48601234568")],
}


@pytest.mark.parametrize("text", CASES)
def test_repeats_take_the_label_over(field, text):
    assert added(text, field) == CASES[text]


@pytest.mark.parametrize("text", CASES)
def test_without_skip_weights_they_do_not(field, text):
    bare = pii.Field()
    bare.unary, bare.chain = field.unary, field.chain
    assert added(text, bare) == []


@pytest.mark.parametrize("text", ["ring 48601234567 later", "id 601234567 was sold", "4111/1111/1111/1111", "in 2020 and 2020 again", "order 48601234567, order 48601234567", "plain words"])
def test_numbers_that_repeat_nothing_stay(field, text):
    assert added(text, field) == []


def test_label_crosses_all_repeats(field):
    text = "Call +48601234567 now. " + "then 48601234567 again and 7 more, " * 300
    assert added(text, field) == [("phone", "48601234567")] * 300
    text = "first 48601234567 here " * 40 + "and at the end +48601234567"
    assert added(text, field) == [("phone", "48601234567")] * 40


def test_messages_stand_still(field):
    graph = pii.Graph()
    graph.add(0, "Call +48601234567 now, 10.0.0.1 " + "then 48601234567 and 601234567 or 4111/1111/1111/1111 " * 30)
    some, more = (field.marginals(graph, rounds=n) for n in (pii.ROUNDS, 5 * pii.ROUNDS))
    assert np.abs(some - more).max() < 1e-2


def test_edges_grow_with_the_tokens():
    for text in ("4860123456 " * 20_000, "1 2 3 4 5 6 7 8 " * 3000, "+48 601 234 567 " * 5000):
        graph = pii.Graph()
        graph.add(0, text)
        assert len(graph.skip) + len(graph.like) <= 20 * pii.TOKENS * len(graph.x)


def test_documents_do_not_touch(field):
    texts = ["Call +48601234567 today", "ring 48601234567 later"]
    bases = [pii.base_spans(t)[0] for t in texts]
    assert pii.further_spans(texts, bases, field) == [[], []]
    both = [*texts, "Call +48601234567 or 48601234567", "x"]
    alone = [pii.further_spans([t], [pii.base_spans(t)[0]], field)[0] for t in both]
    assert pii.further_spans(both, [pii.base_spans(t)[0] for t in both], field) == alone
