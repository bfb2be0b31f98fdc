"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is the set of its windows: ``width`` consecutive words, or all of its words where it has fewer.  A window is
the set of its shingles (three words, or all of them in a shorter window).  All of a window's shingles must occur in a
document that contains it, so the prefix of a window, with its shingles ordered by rarity over all documents, need be one
shingle long: its rarest one.  Documents are probed with these shingles.  A match fixes where the window would begin; it
must begin and end inside the document (positional and length bounds), and there the words are compared as bytes.

The benchmark is the stated query set: its distinct windows are taken in blocks of bounded size, each of which reads all
documents twice, once to count shingles and once to find windows.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.llm.common import groups_of, hashes_between, materialise, mix, released, small_keys, text_buffer

WIDTH, SHINGLE = 10, 3
#: Distinct windows of a block; a task holds one block, about a hundred bytes a window.
BLOCK = 200_000
#: Candidates that are compared at a time, and distinct sets of found windows that may be broadcast with their items.
AT_ONCE, SETS = 1 << 18, 50_000
U = np.uint64


class Words:
    """The words of back-to-back texts, lower-cased: runs of a to z, 0 to 9 and everything beyond ASCII."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        text = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        inside = (text >= 128) | ((text >= 97) & (text <= 122)) | ((text >= 48) & (text <= 57))
        first, last = inside.copy(), inside.copy()
        if len(text):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            at = offsets[:-1][offsets[:-1] < len(text)]
            first[at] = inside[at]
            at = offsets[1:][offsets[1:] > 0] - 1
            last[at] = inside[at]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, s, side="right") - 1
        self.hashes = hashes_between(text, s, e)
        # words again, with one space after each: a window is one slice of these bytes
        size = e - s
        self.start = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64) if len(s) else np.zeros(0, np.int64)
        self.end = self.start + size
        plain = np.full(int(self.end[-1]) if len(s) else 0, 32, np.uint8)
        plain[np.repeat(self.start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))] = text[inside]
        self.plain = plain.tobytes()
        n = len(offsets) - 1
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # of each text, in words

    def shingles(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the runs of ``length`` words inside a text."""
        at = np.flatnonzero(self.doc[: len(self.doc) - length + 1] == self.doc[length - 1 :]) if len(self.doc) >= length else np.zeros(0, np.int64)
        h = mix(self.hashes[at] + U(length))
        for k in range(1, length):
            h = mix(h * U(0x9FB21C651E98DF25) + self.hashes[at + k])
        return at, h


class Block:
    """Windows of the benchmark, their shingles, and later the shingle by which each is probed."""

    def __init__(self, ids: np.ndarray, windows: list[str]):
        self.ids, self.windows = ids, [w.encode() for w in windows]
        data, offsets = text_buffer(pa.array(self.windows, pa.binary()))
        words = Words(data, offsets)
        self.size = words.count
        self.of, self.place, self.shingle = [], [], []
        self.lengths = sorted({int(x) for x in np.unique(np.minimum(self.size, SHINGLE))} - {0})
        for length in self.lengths:
            at, h = words.shingles(length)
            own = np.minimum(self.size, SHINGLE)[words.doc[at]] == length
            self.of.append(words.doc[at][own])
            self.place.append(at[own] - words.first[words.doc[at][own]])
            self.shingle.append(h[own])
        self.known = [np.unique(h) for h in self.shingle]

    def probe_with(self, counts: dict[int, int]) -> None:
        """Choose each window's rarest shingle; ties go to the smaller hash, then to the earlier place."""
        self.probe = []
        for of, place, h in zip(self.of, self.place, self.shingle, strict=True):
            found, back = np.unique(h, return_inverse=True)
            n = np.array([counts.get(x, 0) for x in found.view(np.int64).tolist()], np.int64)[back.ravel()]
            order = np.lexsort((place, h, n, of))
            keep = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))] if len(order) else order
            keep = keep[n[keep] > 0]  # a shingle that no document holds rules its window out
            keep = keep[np.argsort(h[keep], kind="stable")]
            self.probe.append((h[keep], of[keep], place[keep]))
        del self.of, self.place, self.shingle, self.known


def _counted(block: Block):
    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(k), np.int64) for k in block.known]
        for b in batches:
            data, offsets = text_buffer(b.column(0))
            for i, j in groups_of(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for known, total, length in zip(block.known, totals, block.lengths, strict=True):
                    h = words.shingles(length)[1]
                    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    np.add.at(total, place[known[place] == h], 1)
        for known, total in zip(block.known, totals, strict=True):
            have = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(known[have].view(np.int64)), pa.array(total[have])], names=["shingle", "n"])

    return count


FOUND = "doc_id long, x long, y long, n_words long, hits array<struct<begin: long, end: long>>, windows array<long>"


def _candidates(words: Words, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, window) where a window's rarest shingle stands such that the whole window fits into the text."""
    for length, (probe, of, place) in zip(block.lengths, block.probe, strict=True):
        at, h = words.shingles(length)
        low, high = np.searchsorted(probe, h, side="left"), np.searchsorted(probe, h, side="right")
        have = np.flatnonzero(high > low)
        cut = np.concatenate(([0], np.cumsum((high - low)[have])))
        i = 0
        while i < len(have):
            j = max(i + 1, int(np.searchsorted(cut, cut[i] + AT_ONCE, side="right")) - 1)
            part, n = have[i:j], (high - low)[have[i:j]]
            which = np.repeat(low[part] - (cut[i:j] - cut[i]), n) + np.arange(int(n.sum()))
            w, begin = of[which], np.repeat(at[part], n) - place[which]
            doc = words.doc[np.repeat(at[part], n)]
            fits = (begin >= words.first[doc]) & (begin + block.size[w] <= words.first[doc + 1])
            yield begin[fits], w[fits]
            i = j


def _found(block: Block, every: bool):
    """Rows of (doc_id, x, y, text) to rows of FOUND: all of them, or those with a hit."""
    names = [c.split()[0] for c in FOUND.split(", ")][:4] + ["hits", "windows"]

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column(3))
            for i, j in groups_of(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                edge = np.zeros(len(words.doc) + 1, np.int64)
                met = []
                for begin, w in _candidates(words, block):
                    a, z = words.start[begin], words.end[begin + block.size[w] - 1]
                    same = np.fromiter((words.plain[p:q] == block.windows[k] for p, q, k in zip(a.tolist(), z.tolist(), w.tolist(), strict=True)), bool, len(w))
                    begin, w = begin[same], w[same]
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + block.size[w], -1)
                    met.append(np.stack([words.doc[begin], block.ids[w]], axis=1))
                met = np.unique(np.concatenate(met), axis=0) if met else np.zeros((0, 2), np.int64)
                inside = np.cumsum(edge)[:-1] > 0
                if len(inside):
                    new = inside.copy()
                    new[1:] &= ~inside[:-1] | (words.doc[1:] != words.doc[:-1])
                    old = inside.copy()
                    old[:-1] &= ~inside[1:] | (words.doc[1:] != words.doc[:-1])
                    begins, ends = np.flatnonzero(new), np.flatnonzero(old) + 1
                else:
                    begins = ends = np.zeros(0, np.int64)
                of, n = words.doc[begins], j - i
                cuts = [np.concatenate(([0], np.cumsum(np.bincount(x, minlength=n)))).astype(np.int32) for x in (of, met[:, 0])]
                spans = pa.StructArray.from_arrays([pa.array(begins - words.first[of]), pa.array(ends - words.first[of])], names=["begin", "end"])
                out = pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, n) for c in range(3)), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(cuts[0], spans), pa.ListArray.from_arrays(cuts[1], pa.array(met[:, 1]))], names=names
                )
                yield out if every else out.filter(pa.array(np.diff(cuts[1]) > 0))

    return find


@released
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        width = int(b.column(2)[0].as_py()) if b.num_rows else 0
        data, offsets = text_buffer(b.column(1))
        for i, j in groups_of(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.minimum(words.count, width)
            n = np.where(size > 0, words.count - size + 1, 0)
            of = np.repeat(np.arange(j - i), n)
            begin = words.first[of] + np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            text = [words.plain[a:z] for a, z in zip(words.start[begin].tolist(), words.end[begin + size[of] - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(of)), pa.array(text, pa.binary()).cast(pa.string())], names=["item_id", "words"])


def item_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id as a string, words) of every window of every item; a null id is the empty string."""
    base = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).cast("binary").alias("_text"), F.lit(width).alias("_width"))
    return base.mapInArrow(_windows, "item_id string, words string")


def _joined_hits(a, b):
    """Two arrays of spans as one array of spans that neither overlap nor touch."""
    grown = F.aggregate(
        F.array_sort(F.concat(a, b)),
        F.array().cast("array<struct<begin: long, end: long>>"),
        lambda got, x: F.when((F.size(got) > 0) & (F.element_at(got, -1)["end"] >= x["begin"]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.element_at(got, -1)["begin"].alias("begin"), F.greatest(F.element_at(got, -1)["end"], x["end"]).alias("end"))))).otherwise(
            F.concat(got, F.array(x))
        ),
    )
    return grown


def find_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, hits (spans of words inside any window) and windows (ids, in order).

    ``windows`` (window, words) holds distinct windows.  It is read in blocks of about ``block`` rows; where there are
    several, what a block finds is joined to the rows by id and two hashes of the text, so equal rows share it.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("x"), F.xxhash64(F.lit(1), F.col(text_col)).alias("y"), F.col(text_col).cast("binary").alias("_text"))
    n_blocks = max(1, -(-windows.count() // block))
    parts = []
    for k in range(n_blocks):
        rows = windows.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == k).select("window", "words").toArrow()  # about ``block`` rows
        held = Block(rows.column(0).to_numpy().astype(np.int64), rows.column(1).to_pylist())
        counts = base.select("_text").mapInArrow(_counted(held), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()  # a row for each shingle of the block at most
        held.probe_with(dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True)))
        parts.append(base.mapInArrow(_found(held, k == 0), FOUND))
    first = parts[0]
    if n_blocks > 1:
        more = parts[1]
        for p in parts[2:]:
            more = more.unionByName(p)
        more = more.distinct().groupBy("doc_id", "x", "y").agg(F.flatten(F.collect_list("hits")).alias("_hits"), F.flatten(F.collect_list("windows")).alias("_windows"))
        more = materialise(more.withColumnsRenamed({"doc_id": "_doc", "x": "_x", "y": "_y"}), "found-in-blocks")
        none = F.array().cast("array<struct<begin: long, end: long>>")
        first = first.join(small_keys(more, SETS), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").select(
            "doc_id",
            "n_words",
            _joined_hits(F.col("hits"), F.coalesce("_hits", none)).alias("hits"),
            F.array_sort(F.concat("windows", F.coalesce("_windows", F.array().cast("array<long>")))).alias("windows"),
        )
    return first.select("doc_id", "n_words", "hits", "windows")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, hits (spans of words), n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a window of an item.  n_items counts the items with an occurring window;
    items_sha256 is the digest of their ids as strings, in order, joined by commas.  Null and empty texts have no words and
    hit nothing, on either side; a null item_id is the empty string, and rows that repeat an item_id are one item.  Rows that
    repeat a doc_id keep their own results.  Empty tables give no rows, or no hits; other columns are not read.

    Items are listed once for each distinct set of windows that was found, not once for each document.
    """
    all_windows = materialise(item_windows(items, width).distinct(), "item-windows")
    windows = materialise(all_windows.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"), "windows")
    of = materialise(all_windows.join(windows, "words").select("window", "item_id"), "windows-of-items")
    found = materialise(find_windows(docs, windows, id_col, text_col, block), "found")
    hit = found.filter(F.size("windows") > 0)
    sets = hit.select("windows").distinct()
    listed = sets.select("windows", F.explode("windows").alias("window")).join(small_keys(of), "window").groupBy("windows").agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
    listed = materialise(listed.select("windows", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256")), "listed")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    dirty = hit.join(small_keys(listed, SETS), "windows").select("doc_id", "n_words", n_hit.alias("n_hit"), "hits", "n_items", "items_sha256", F.lit(True).alias("contaminated"))
    clean = found.filter(F.size("windows") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), "hits", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    return clean.unionByName(dirty)
