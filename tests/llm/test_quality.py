"""The classifier: held-out accuracy, whole coverage of texts, and edges."""

import zlib

import numpy as np

from landspark.llm import quality
from landspark.llm.queries import op5_quality


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op5_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i], q) for i, q in labels.items() if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.97
    assert sum(r.predicted for r, q in held if q) / sum(q for _, q in held) > 0.985


def test_every_byte_counts():
    for n in (0, 1, 3, 4, 255, 256, 257, 1000, 5000):
        data = np.arange(1, n + 1).astype(np.uint8) | 1
        rows, first = quality.packed(data, np.array([0, n]))
        assert (rows.ravel()[:n] == data).all() and first[-1] == max(1, -(-n // 256))


def test_scores_do_not_depend_on_neighbours():
    net = quality.Network()
    texts = [b"", b"abc", b"x" * 10_000, bytes(range(256)) * 9]
    alone = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    together = net.scores(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    # a text's last chunk sees the zeros after it, never the next text, except for the filter's reach of eight bytes
    assert np.allclose(alone, together, atol=0.05)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (2, "", "s"), (None, "b", "s"), (5, "w " * 200_000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    got = quality.score_documents(docs, net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_documents(docs.limit(0), net).count() == 0
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


def test_batches_of_kept_documents_are_bounded(spark, tmp_path, monkeypatch):
    sizes = str(tmp_path / "sizes")

    def noting(task):
        def run(batches):
            def seen():
                for b in batches:
                    with open(sizes, "a") as f:
                        f.write(f"{b.nbytes}\n")
                    yield b

            return task(seen())

        return run

    monkeypatch.setattr(quality, "released", noting)
    monkeypatch.setattr(quality, "fit", lambda *_: quality.Network())
    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('abcd ', 10000) AS text")
    assert quality.keep_good(docs, None, 0.0).count() == 200
    got = [int(x) for x in open(sizes)]
    assert sum(got) > 10_000_000 and max(got) < 3_000_000
