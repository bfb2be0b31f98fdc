"""Exact deduplication with counting quotient filters.

Every input partition puts the 64-bit fingerprints of its texts into counting quotient filters: a fingerprint is split
into a quotient (the slot) and a remainder, a slot holds its remainders in order, each with a count.  Filters of the same
geometry merge without loss by merging the ordered remainders of equal slots and adding the counts, so slots are shuffled
by quotient and merged; a group of copies reaches a merge as one remainder for each filter, however many copies it has.
Fingerprints with a count above one route their documents to the verification, which compares whole texts as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.llm.common import materialise, small_keys

#: Fingerprints that share a slot, on average over a whole filter of this many documents.
SLOT = 2048
#: Groups of copies, of about a hundred bytes a row, that may be broadcast.
GROUPS = 200_000


def quotient_bits(n_documents: int) -> int:
    """Bits of the quotient, so that a merged slot holds about ``SLOT`` remainders at any size."""
    return min(40, max(6, (max(1, n_documents) // SLOT).bit_length()))


def _build(bits: int):
    """Arrow batches of fingerprints to filter slots: quotient, ordered remainders, counts."""
    shift = np.uint64(64 - bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def slots():
            prints, counts = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            weights = np.bincount(counts.ravel(), weights=np.concatenate([c for _, c in kept])).astype(np.int64)
            return prints, weights

        def out(prints, weights):
            quotient = prints >> shift
            cut = np.flatnonzero(np.diff(quotient)) + 1
            first = np.concatenate(([0], cut, [len(prints)])).astype(np.int32)
            remainder = (prints & np.uint64((1 << (64 - bits)) - 1)).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(quotient[first[:-1]].view(np.int64)), pa.ListArray.from_arrays(first, pa.array(remainder)), pa.ListArray.from_arrays(first, pa.array(weights))],
                names=["quotient", "remainders", "counts"],
            )

        for b in batches:
            if b.num_rows:
                kept.append((b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), np.ones(b.num_rows, np.int64)))
                held += b.num_rows
            if held >= 1 << 20:  # a full filter goes out; the merge takes any number of them
                yield out(*slots())
                kept, held = [], 0
        if kept:
            yield out(*slots())

    return build


def _merge(bits: int):
    """Filters' rows of one slot to its fingerprints with a count above one."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        remainders = np.concatenate([np.asarray(x, np.int64) for x in rows["remainders"]])
        counts = np.concatenate([np.asarray(x, np.int64) for x in rows["counts"]])
        order = np.argsort(remainders, kind="stable")
        remainders, counts = remainders[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], remainders[1:] != remainders[:-1])))
        totals = np.add.reduceat(counts, first)
        many = totals > 1
        fp = (np.uint64(key[0]) << np.uint64(64 - bits)) | remainders[first][many].view(np.uint64)
        return pd.DataFrame({"_fp": fp.view(np.int64), "_n": totals[many]})

    return merge


def repeated_fingerprints(prints: DataFrame, bits: int) -> DataFrame:
    """``prints`` has one long column ``_fp``; returns those that occur more than once, with their counts."""
    slots = prints.select("_fp").mapInArrow(_build(bits), "quotient long, remainders array<long>, counts array<long>")
    return slots.groupBy("quotient").applyInPandas(_merge(bits), "_fp long, _n long")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, and the empty texts are one group.  Of a group the row
    with the largest id stays.  Rows that repeat an id with an equal text all report that id (``kept`` is true for each of
    them); with ids that are null, null is the smallest.  An empty table gives no rows; other columns are not read.
    """
    bits = quotient_bits(docs.count()) if bits is None else bits
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    many = small_keys(materialise(repeated_fingerprints(base, bits).select("_fp"), "repeated-prints"))
    # bytes decide: grouping by the text itself; equal texts are combined before the shuffle
    equal = base.join(many, "_fp", "left_semi").groupBy("_text").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    equal = materialise(equal.filter("_size > 1").select(F.sha2("_text", 256).alias("text_sha256"), "_keep", "_size"), "equal-texts")
    light = base.select("doc_id", F.sha2("_text", 256).alias("text_sha256"))
    # a row for each group of copies: broadcast as long as they are few, so that no group's rows meet in one task
    return light.join(small_keys(equal, GROUPS), "text_sha256", "left").select(
        "doc_id",
        F.coalesce("_keep", "doc_id").alias("keep_id"),
        F.coalesce("_size", F.lit(1)).alias("group_size"),
        (F.coalesce("_keep", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have an equal text with a larger id; columns as they were.

    The rows to drop are the fewer ones: they are told by id and digest, and texts are not shuffled unless they are many.
    """
    drop = exact_copies(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_drop_id"), F.col("text_sha256").alias("_drop_sha")).distinct()
    same = docs[id_col].eqNullSafe(F.col("_drop_id")) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == F.col("_drop_sha"))
    return docs.join(small_keys(drop), same, "left_anti")
