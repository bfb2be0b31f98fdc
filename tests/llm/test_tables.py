"""Exact dedup, mixing, packing and archives on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import gzip
import hashlib
import zlib

import numpy as np
import pytest

from landspark.llm import exact_dedup, mixing, packing, warc
from landspark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, _text string, target double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", 0.0) for i, t, s in rows], DOCS).repartition(3)


ROWS = [(1, "a b", "s"), (2, "a b", "t"), (2, "a b", "t"), (3, None, None), (4, "", "s"), (5, "a  b", "s"), (6, "é " * 4000, "t"), (7, "a b", None), (None, "z", "u")]


def test_exact_copies(spark):
    got = {(r.doc_id, r.kept): r for r in exact_dedup.exact_copies(docs(spark, ROWS)).collect()}
    assert len(got) == 8 and got[(2, False)].keep_id == 7 and got[(2, False)].group_size == 4
    assert got[(3, False)].keep_id == 4 and got[(4, True)].group_size == 2
    assert got[(5, True)].group_size == 1 and got[(5, True)].text_sha256 == hashlib.sha256(b"a  b").hexdigest()
    assert got[(None, True)].keep_id is None
    kept = exact_dedup.drop_copies(docs(spark, ROWS))
    assert kept.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]


def test_filters_merge_without_loss(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-(2**62), 2**62, 500).tolist()
    df = spark.createDataFrame([(v,) for i, v in enumerate(values) for _ in range(1 + i % 3)], "_fp long").repartition(5)
    got = {r._fp: r._n for r in exact_dedup.repeated_fingerprints(df, 7).collect()}
    assert got == {v: 1 + i % 3 for i, v in enumerate(values) if i % 3}


def test_empty_tables(spark):
    none = docs(spark, ROWS).limit(0)
    assert exact_dedup.exact_copies(none).count() == 0
    assert mixing.mix_rates(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    assert warc.archive_pages(spark, spark.createDataFrame([], "page_id long, html string")).count() == 0


def brute_targets(sizes, cycle=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, capped = {s: cycle[i % 3] for i, s in enumerate(names)}, dict.fromkeys(names, 0.0), set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over
        target |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 1}, {"a": 0, "b": 3}, {"a": 5, "b": 5, "c": 5, "d": 100000, "e": 1}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "_source string, source_size long")
    got = {r._source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes), rel=1e-9)


def test_mix(spark):
    df = docs(spark, ROWS)
    rows = mixing.mix_rates(df).collect()
    assert len(rows) == len(ROWS)
    copies = sum(r.copies for r in rows)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == copies
    assert all(0 <= r.copies <= 3 for r in rows)


def test_packing_is_lossless(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "Beta", "it's", "naïve", "<|endoftext|>", "x1y2", "İ", "…", "12,345"], int(n))) for n in rng.integers(0, 1500, 60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100, None, None), (101, "", None), (102, texts[3], None), (103, "w " * 9000, None), (3, texts[3], "s")]
    pieces = packing.pack_documents(docs(spark, rows), tokenizer_path(), shard=20).toPandas()
    plain = Tokenizer.from_file(tokenizer_path())
    for i, t, _ in rows:
        ids = np.asarray(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = pieces[pieces.doc_id == i].drop_duplicates("start").sort_values("start")
        assert mine["length"].sum() == len(ids) and (mine["doc_tokens"] == len(ids)).all()
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 2048 and (s["offset"].to_numpy() == np.concatenate(([0], np.cumsum(s["length"])[:-1]))).all()


def test_plan_fills_windows():
    lengths = np.random.default_rng(2).integers(1, 2048, 6000)
    sequence, offset, used = packing.plan(lengths)
    assert lengths.sum() / (used * 2048) > 0.99
    fill = np.bincount(sequence, weights=lengths)
    assert fill.max() <= 2048 and (sequence >= 0).all() and (offset + lengths <= 2048).all()


def test_archives(spark):
    body = "<p>" + "é" * 200
    rows = [(1, body), (2, "short"), (3, body), (4, None), (5, ""), (6, "short"), (7, "x" * 99), (8, "x" * 100), (9, "x" * 100), (10, "a\r\n\r\nWARC/1.1\r\n" * 40)]
    df = spark.createDataFrame([(i, "u", h, 3) for i, h in rows], "page_id long, url string, html string, payload_bytes long").repartition(3)
    got = {r.page_id: r for r in warc.archive_pages(spark, df).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 1, 9: 8}


def test_normaliser_members(spark, tmp_path):
    df = spark.createDataFrame([(i, "p" * 500 + str(i)) for i in range(40)], "page_id long, html string").coalesce(1)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    files = warc.write_archives(warc.record_types(df), one, roll=8000)
    assert files.count() > 1
    normal = warc.normalise(files, one, two, piece=97)
    back = warc.read_records(normal, two)
    assert {r.page_id: bytes(r.payload).decode() for r in back.collect()} == {i: "p" * 500 + str(i) for i in range(40)}
    for f in tmp_path.glob("two/*.gz"):
        assert gzip.decompress(f.read_bytes()) == gzip.decompress((tmp_path / "one" / f.name).read_bytes())
