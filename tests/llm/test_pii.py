"""Personal data: the patterns against the plain regular expressions, and what the field adds."""

import hashlib
import random
import re

from landspark.llm import pii

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                kind == 1 and all(int(x) <= 255 for x in m[0].split(".")),
                16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                8 <= len(d) <= 15,
            )[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out)


def test_patterns_against_plain():
    rng = random.Random(4)
    for _ in range(6000):
        parts = ["a", "b.c", "@", "@", ".", "1", "25", "256", "4111111111111111", " ", "-", "+1", "(", ")", "é", "_", "+", "%", "10.0.0.1", "x@y.z"]
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text)[0] == plain(text), text


def test_long_runs_are_linear():
    for text in ("1" * 400_000, "1." * 300_000, "a.b" * 200_000 + "é@", "+1 " * 200_000, "@" * 400_000, "9 " * 300_000):
        pii.base_spans(text)
        pii.Graph().add(0, text)
    pii.Graph().add(0, "é" * 400_000 + " 1")


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = pii.digest(pii.find_personal_data(docs)).collect()
    assert len(got) == len(rows)
    total = 0
    for r in got:
        want = plain(rows[r.doc_id] or "")
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in range(4)]
        assert set(said) <= set(r.spans.split(","))
        total += len([s for s in r.spans.split(",") if s]) - len(said)
    assert total < 0.2 * sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)


def test_field_adds_what_patterns_drop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = pii.fit(docs)
    text = "Call +1 (269) 555-3296 4524132264652876 now. Then nothing 123 of 4 and 2020."
    base, _ = pii.base_spans(text)
    assert not [s for s in base if s[0] == 3]
    found = pii.further_spans([text], [base], field)[0]
    assert "+1 (269) 555-3296" in [text[a:b] for k, a, b in found if k == 3]
    # a bare repetition of a number that stands elsewhere as a phone takes its label over
    assert pii.further_spans(["plain words only"], [[]], field) == [[]]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cc " * 50_000), (3, "a@b.cc " * 50_000), (None, "10.0.0.1")]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, base string")
    got = pii.digest(pii.find_personal_data(df)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip) for r in got) == [(0, 0, 1), (1, 0, 0), (2, 0, 0), (3, 50_000, 0), (3, 50_000, 0)]
    assert pii.find_personal_data(df.limit(0)).count() == 0
