"""Substring deduplication by recompression.

A text's words are symbols.  A first round names runs of equal symbols; every later round splits the symbols into left and
right ones by a bit of their name and names each adjacent pair (left, right).  Names are 64-bit hashes of what they stand
for, so every task, anywhere, gives equal strings equal names, and no round needs a shuffle.  Whether two neighbours are
joined depends on these two alone: inside equal substrings all rounds decide alike, and only symbols at the edges can
differ.  The part of a window that no edge can reach is followed through the rounds; the first symbol of that part, in the
last round in which there is one, is the window's anchor.  It is a function of the window's words and nothing else, so
equal windows have equal anchors: anchors that occur once in the corpus reveal all windows that can't repeat.

1. anchors of all documents, counted by name; names with a count above one are joined back to their documents;
2. in those documents, runs of neighbouring windows with one anchor become one row with a fingerprint of all their words;
   equal runs verify all their windows at once, in groups combined before the shuffle;
3. windows of runs that occur once are compared one by one with the other windows of their anchor.

Windows are taken as equal when anchor and window fingerprint are: 64 bits each, from two independent hashes of every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.llm.common import WORD_POWERS, discard, groups_of, hashes_between, materialise, mix, released, small_keys, text_buffer, word_hashes

WINDOW = 35
U = np.uint64


def rounds(names: np.ndarray, last: np.ndarray, window: int, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor name and anchor's first word of the windows that begin at the words ``begins``.

    ``names``: word hashes of documents back to back; ``last``: whether a word is its document's last.
    """
    n = len(names)
    anchor, place = names[begins].copy(), begins.astype(np.int32)
    # runs: what lies between a window's first and its last run is safe
    change = np.ones(n, bool)
    change[1:] = (names[1:] != names[:-1]) | last[:-1]
    run = np.cumsum(change, dtype=np.int32) - 1
    starts = np.flatnonzero(change).astype(np.int32)
    lengths = np.diff(np.append(starts, n)).astype(np.uint64)
    names, last = names[starts], last[np.append(starts[1:], n) - 1]
    names = np.where(lengths > U(1), mix(names ^ (lengths * U(0xC2B2AE3D27D4EB4F))), names)
    low, high, who = run[begins] + 1, run[begins + (window - 1)], np.arange(len(begins), dtype=np.int32)
    live = low < high
    low, high, who = low[live], high[live], who[live]
    step = 0
    while len(who):
        n, step = len(names), step + 1
        right = (mix(names + U(step * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U(63)).astype(bool)
        joined = np.zeros(n, bool)
        joined[:-1] = ~right[:-1] & right[1:] & ~last[:-1]
        kept = np.ones(n, bool)
        kept[1:] = ~joined[:-1]
        new = np.empty(n + 1, np.int32)
        np.cumsum(kept, out=new[:n], dtype=np.int32)
        new[n] = new[n - 1] + 1
        new -= 1
        # a first symbol that may join to its left is lost, and a last one that may join to its right
        low_map = new[np.arange(n + 1) + np.append(right, False)]
        high_map = new[np.arange(n + 1) - np.append([False], ~right)]
        next_low, next_high = low_map[low], high_map[high]
        live = next_low < next_high
        done = ~live
        anchor[who[done]], place[who[done]] = names[low[done]], starts[low[done]]
        low, high, who = next_low[live], next_high[live], who[live]
        first = np.flatnonzero(joined)
        fresh = names.copy()
        fresh[first] = mix((names[first] * U(0xFF51AFD7ED558CCD)) ^ (names[first + 1] + U(0xC4CEB9FE1A85EC53)))
        ends = last.copy()
        ends[first] = last[first + 1]
        names, starts, last = fresh[kept], starts[kept], ends[kept]
    return anchor, place


def window_starts(doc: np.ndarray, window: int) -> np.ndarray:
    if len(doc) < window:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])


def lasts(doc: np.ndarray) -> np.ndarray:
    out = np.ones(len(doc), bool)
    out[:-1] = doc[1:] != doc[:-1]
    return out


def _anchors(window: int):
    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(b.column(1))
            for i, j in groups_of(offsets):
                h, _, _, doc = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                begins = window_starts(doc, window)
                if not len(begins):
                    continue
                anchor, place = rounds(h, lasts(doc), window, begins)
                of = doc[begins]
                # an occurrence is a (place, name); it counts once in its document
                _, at = np.unique(anchor ^ mix(place.astype(np.uint64)), return_index=True)
                _, first, count = np.unique(anchor[at] ^ mix(of[at].astype(np.uint64) + U(1 << 40)), return_index=True, return_counts=True)
                at = at[first]
                order = np.argsort(of[at], kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][of[at][order]]), pa.array(anchor[at][order].view(np.int64)), pa.array(count[order].astype(np.int32))], names=["_k", "name", "n"])

    return find


RUNS = "_k long, s int, c int, name long, u long, windows array<long>"


def _runs(window: int):
    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(b.column(1))
            named = b.column(2)
            cuts, wanted = named.offsets.to_numpy(), named.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j in groups_of(offsets):
                part = data[offsets[i] : offsets[j]]
                h, at, end, doc = word_hashes(part, offsets[i : j + 1] - offsets[i])
                begins = window_starts(doc, window)
                if not len(begins):
                    continue
                anchor, place = rounds(h, lasts(doc), window, begins)
                of = doc[begins]
                tag = lambda name, d: name ^ mix(d.astype(np.uint64) + U(1 << 40))
                mine = tag(wanted[cuts[i] : cuts[j]], np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1])))
                hit = np.isin(tag(anchor, of), mine)
                begins, anchor, place, of = begins[hit], anchor[hit], place[hit], of[hit]
                if not len(begins):
                    continue
                WORD_POWERS.grow(len(h) + 1)
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(hashes_between(part, at, end, 1) * WORD_POWERS.up[: len(h)], out=total[1:])
                print_of = lambda a, z: mix((total[z] - total[a]) * WORD_POWERS.down[a])
                new = np.ones(len(begins), bool)
                new[1:] = (begins[1:] != begins[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]) | (of[1:] != of[:-1])
                first = np.flatnonzero(new)
                final = np.append(first[1:], len(begins)) - 1
                base = np.searchsorted(doc, np.arange(j - i))  # each document's first word
                windows = pa.ListArray.from_arrays(np.append(first, len(begins)).astype(np.int32), pa.array(print_of(begins, begins + window).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[i:j][of[first]]),
                        pa.array((begins[first] - base[of[first]]).astype(np.int32)),
                        pa.array((final - first + 1).astype(np.int32)),
                        pa.array(anchor[first].view(np.int64)),
                        pa.array(print_of(begins[first], begins[final] + window).view(np.int64)),
                        windows,
                    ],
                    names=["_k", "s", "c", "name", "u", "windows"],
                )

    return find


KEPT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"


@released
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            ids, texts, spans = (c.slice(at, 256) for c in b.columns)
            out: list[list] = [[], [], [], []]
            for text, covered in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                words = (text or b"").split()
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in covered or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, place = [], 0
                for s, e in merged:
                    kept += words[place:s]
                    place = e
                kept += words[place:]
                out[0].append(len(words))
                out[1].append(len(words) - len(kept))
                out[2].append(b" ".join(kept).decode("utf-8", "replace"))
                out[3].append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept", "removed"],
            )


def repeated_intervals(base: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_k, spans) of the documents in ``base`` (_k, _text as binary) that hold repeated windows; spans of words, not merged."""
    anchors = materialise(base.select("_k", "_text").mapInArrow(_anchors(window), "_k long, name long, n int"), "anchors")
    shared = anchors.groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1").select("name")
    hits = materialise(anchors.join(shared, "name").groupBy("_k").agg(F.collect_list("name").alias("names")), "hits")
    discard(anchors)
    del anchors, shared
    some = base.join(small_keys(hits.select("_k")), "_k", "left_semi")
    runs = materialise(some.join(hits, "_k").select("_k", "_text", "names").mapInArrow(_runs(window), RUNS), "runs")
    discard(hits)
    del hits, some
    groups = materialise(runs.groupBy("name", "u", "c").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("_k"), F.min("s").alias("s"), F.first("windows").alias("windows")), "groups")
    whole = runs.select("_k", "s", "c", "name", "u").join(groups.filter("n > 1").select("name", "u", "c"), ["name", "u", "c"])
    whole = materialise(whole.select("_k", F.struct("s", (F.col("s") + F.col("c") - 1 + window).alias("e")).alias("span")).groupBy("_k").agg(F.collect_list("span").alias("spans")), "whole")
    discard(runs)
    del runs
    # anchors with a run that occurs once: each distinct run gives its windows, with its number of occurrences
    open_names = groups.filter("n = 1").select("name").distinct()
    windows = groups.join(small_keys(open_names), "name", "left_semi").select("name", "n", "_k", "s", F.posexplode("windows").alias("at", "w"))
    windows = materialise(windows.select("name", "w", "n", "_k", (F.col("s") + F.col("at")).alias("s")), "windows")
    discard(groups)
    del groups, open_names
    again = windows.groupBy("name", "w").agg(F.sum("n").alias("t")).filter("t > 1").select("name", "w")
    single = windows.filter("n = 1").join(again, ["name", "w"]).select("_k", F.struct("s", (F.col("s") + window).alias("e")).alias("span"))
    single = single.groupBy("_k").agg(F.collect_list("span").alias("spans"))
    spans = materialise(whole.unionByName(single).groupBy("_k").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(whole, windows)
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``KEPT`` of each row of ``docs``: the words that no repeated window covers, joined by a space, and the spans removed.

    A window of ``window`` consecutive words is repeated if its words also start elsewhere, in any row of the table or in
    the same text; all copies are removed, judged on the input.  Null texts have no words.  A row that repeats another one's
    text repeats all its windows; rows that repeat an id with other texts are documents of their own.  An empty table gives
    no rows; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k"))
    spans = repeated_intervals(base, window)
    keys = spans.select("_k")
    checked = small_keys(keys)
    columns = ("doc_id", "_text", "spans")
    if checked is keys:  # too many to broadcast: every text goes to its spans
        joined = base.join(spans, "_k", "left").select(*columns)
    else:  # texts without repeats stay where they are
        free = base.join(checked, "_k", "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(*columns)
        joined = base.join(checked, "_k", "left_semi").join(spans, "_k").select(*columns).unionByName(free)
    return joined.mapInArrow(_cut, KEPT)
