"""The pipeline against a plain version of its stages."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from test_jaccard import brute as components
from test_tables import brute_targets

from landspark.llm import quality
from landspark.llm.queries import tokenizer_path

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.score_documents(docs, net).collect()}
    rows = [r for r in docs.collect() if score[r.doc_id] >= 0.3]
    last = {}
    for r in rows:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    rows = [r for r in rows if last[r.text] == r.doc_id]
    keep = {i for i, _, c in components([(r.doc_id, r.text) for r in rows]) if i == c}
    rows = [r for r in rows if r.doc_id in keep]
    sizes, words = Counter(), {}
    for r in rows:
        words[r.doc_id] = len((r.text or "").encode().split())
        sizes[r.source] += words[r.doc_id]
    targets, copies = brute_targets(sizes), {}
    for r in rows:
        rate = min(3.0, targets[r.source] / sizes[r.source]) if sizes[r.source] else 0.0
        draw = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        copies[r.doc_id] = int(rate) + (draw < rate - int(rate))
    from tokenizers import Tokenizer

    plain, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in rows:
        ids = np.asarray(plain.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 2048):
            want[(r.doc_id, k, zlib.crc32(ids[k : k + 2048].tobytes()), len(ids))] += copies[r.doc_id]
    out = pipeline.run(spark, sf)
    got = Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in out.collect())
    assert got == +want and len(keep) < docs.count()
    assert out.filter("offset + length > 2048").count() == 0
    assert out.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0


def test_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, "en", None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", None, "s", 3), (4, "a b", None, "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            assert stage(spark, table, sf).columns == docs.columns, name
            stage(spark, table, sf).count()
        pipeline.STAGES[-1][1](spark, table, sf).count()
