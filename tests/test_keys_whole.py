"""Folded keys of whole texts, against plain Python."""

import hashlib
import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ąćęłńóśźż", "acelnoszz")


def key(text):
    if text is None:
        return None
    return hashlib.md5(re.sub(r"[ \t\n\v\f\r\-]+", " ", text.lower().translate(FOLD)).strip(" ").encode()).hexdigest()


def test_whole_texts_of_every_document(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted((r.doc_id, r.k) for r in entry.queries()["h18_ascii_key"](spark, SF).collect())
    assert got == sorted((r.doc_id, key(r.text)) for r in docs)
    rows = [(1, "x" * 200 + "a", "de"), (2, "x" * 200 + "b", None), (3, "Łódź - Góra", "pl"), (4, None, "pl")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.k for r in entry.queries()["h18_ascii_key"](spark, str(tmp_path)).collect()} == {i: key(x) for i, x, _ in rows}
