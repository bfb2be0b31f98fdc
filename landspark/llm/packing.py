"""Packing token sequences into fixed windows by non-negative least squares.

Documents become token ids (and an end id).  Whole windows are cut off the front of each document; what is left, its
tail, is packed with others.  Tails are dealt by a hash of their id into shards of a bounded number of documents, more
shards for more documents, and each shard is packed on its own: shallow combinations of tail lengths that fill a window
exactly are enumerated, a non-negative least-squares fit of their repeat counts to the shard's histogram of lengths is
rounded down, and tails that no chosen combination takes are packed greedily, the longest first into the fullest window
that still holds them.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.llm.common import HELD, give_back, groups_of, materialise, text_buffer, trim

WINDOW = 2048
END_ID = 1
#: Documents that one packing task takes, about.
SHARD = 6144
#: Distinct lengths, the most frequent ones, whose combinations of three are enumerated (of two: all lengths).
TRIPLE_LENGTHS = 96
#: Words whose ids each of a worker's two tables remembers at most, and endings of punctuation.
WORDS_KEPT, TAILS_KEPT = 200_000, 10_000
#: Bytes of texts, about, that are encoded together.
TEXT = 1 << 20
#: What may follow a word's letters; with nothing else behind the letters it is one piece of its own for the tokenizer.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit words, with the ids of white-space separated words remembered.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its words in order; and
    letters followed by punctuation are pieces of their own.  Words that are not remembered are encoded many at a time: how
    many pieces each has is known, and the tokens that end a piece tell the words apart.  Words that occur twice in texts
    encoded together are remembered, in two tables, of which the older one goes when the other is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; a pool of threads would hold memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces = {"": 1}  # of a word of letters that ends in this punctuation
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        trim()  # reading the vocabulary takes more than keeping it

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def _together(self, words: list[str], counts: list[int]) -> list[bytes]:
        """Ids of words that have ``counts`` pieces each."""
        out: list[bytes] = []
        for at in range(0, len(words), 512):
            part, last = words[at : at + 512], np.cumsum(counts[at : at + 512])
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == last[-1] and cut[-1] == len(ids):
                cut, ids = (4 * cut[last - 1]).tolist(), ids.tobytes()
                out += [ids[a:z] for a, z in zip([0, *cut], cut)]  # noqa: B905  one longer
            else:  # a letter that lower case takes apart makes one word several pieces
                out += self._each(part)
        return out

    def _fresh(self, missing: list[bytes]) -> dict[bytes, bytes]:
        known, letters, counts, raw_letters, other, raw_other = self.pieces, [], [], [], [], []
        for raw, word in zip(missing, b" ".join(missing).decode("utf-8", "replace").split(" "), strict=True):
            core = word.rstrip(TAIL)
            if core.isalpha():
                tail = word[len(core) :]
                n = known.get(tail)
                if n is None:
                    n = 1 + int(self.ends[self.tokenizer.encode(tail, add_special_tokens=False).ids].sum())
                    if len(known) < TAILS_KEPT:
                        known[tail] = n
                letters.append(word)
                counts.append(n)
                raw_letters.append(raw)
            else:
                other.append(word)
                raw_other.append(raw)
        return dict(zip(raw_letters, self._together(letters, counts), strict=True)) | dict(zip(raw_other, self._each(other), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        found = [list(map(self.recent.get, words)) for words in split]
        times: Counter[bytes] = Counter()
        for words, ids in zip(split, found, strict=True):
            if None in ids:
                times.update([w for w, x in zip(words, ids, strict=True) if x is None])
        if times:
            fresh = {w: self.older[w] for w in times.keys() & self.older.keys()}
            fresh |= self._fresh([w for w in times if w not in fresh])
            for words, ids in zip(split, found, strict=True):
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    ids[at] = fresh[words[at]]
            if len(self.recent) > WORDS_KEPT:
                self.older, self.recent = self.recent, {}
            self.recent.update((w, fresh[w]) for w, n in times.items() if n > 1 or w in self.older)
        return list(map(b"".join, found))


_ENCODERS: dict[str, Encoder] = {}
HELD.append(_ENCODERS)  # another operator's task in the worker empties it


def encoder(path: str) -> Encoder:
    """The worker's encoder: what it remembers serves all of the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, window: int):
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at, to in groups_of(text_buffer(texts)[1], TEXT):
                part = [t or b"" for t in texts.slice(at, to - at).to_pylist()]
                doc, start, length, crc, total = [], [], [], [], []
                for i, found in zip(ids.slice(at, to - at).to_pylist(), words.encode(part), strict=True):
                    found += end
                    n = len(found) // 4
                    for k in range(0, n, window):
                        doc.append(i)
                        start.append(k)
                        length.append(min(window, n - k))
                        crc.append(zlib.crc32(found[4 * k : 4 * (k + window)]))
                        total.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Length pairs that fill the window, and triples of frequent lengths that do; lengths are distinct and ascending."""
    have = set(lengths.tolist())
    pairs = [(a, window - a) for a in lengths.tolist() if 2 * a <= window and window - a in have]
    often = np.sort(lengths[np.argsort(-counts, kind="stable")[:TRIPLE_LENGTHS]]).tolist()
    triples = [(a, b, window - a - b) for i, a in enumerate(often) for b in often[i:] if window - a - b >= b and window - a - b in have]
    return pairs + triples


def repeat_counts(lengths: np.ndarray, counts: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 200) -> np.ndarray:
    """Non-negative least squares of A x = counts, where A says how often a combination takes a length.

    Multiplicative steps x := x * (A' counts) / (A' A x) keep x non-negative and never raise the residual; A is sparse, at
    most three lengths to a combination, and is kept as their places.
    """
    place = {v: i for i, v in enumerate(lengths.tolist())}
    wide = max(map(len, combos))
    at = np.array([[place[v] for v in c] + [len(lengths)] * (wide - len(c)) for c in combos])
    target = np.append(counts.astype(float), 0.0)
    want = target[at].sum(1)
    x = target[at[:, :2]].min(1) / 8 + 1e-3
    for _ in range(rounds):
        made = np.bincount(at.ravel(), np.repeat(x, wide), len(lengths) + 1)
        made[-1] = 0
        x *= want / np.maximum(made[at].sum(1), 1e-12)
    return x


def plan(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each tail, in order: its sequence and its offset there; and the number of sequences."""
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    distinct, inverse, counts = np.unique(lengths, return_inverse=True, return_counts=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    queue = {int(v): part.tolist() for v, part in zip(distinct, np.split(order, np.cumsum(counts)[:-1]), strict=True)}
    used = 0
    combos = combinations(distinct, counts, window)
    solved = repeat_counts(distinct, counts, combos) if combos else np.zeros(0)
    for k in np.argsort(-solved, kind="stable").tolist():
        if solved[k] < 0.5:
            break
        combo = combos[k]
        need = {v: combo.count(v) for v in combo}
        times = min(int(np.floor(solved[k] + 0.5)), *(len(queue[v]) // c for v, c in need.items()))
        for _ in range(times):
            at = 0
            for v in combo:
                i = queue[v].pop()
                sequence[i], offset[i] = used, at
                at += v
            used += 1
    left = np.flatnonzero(sequence < 0)
    room: list[tuple[int, int]] = []  # (free, sequence), ascending
    fill: dict[int, int] = {}
    for i in left[np.argsort(-lengths[left], kind="stable")].tolist():
        v = int(lengths[i])
        at = bisect.bisect_left(room, (v, -1))
        if at < len(room):
            free, s = room.pop(at)
        else:
            free, s, used = window, used, used + 1
        sequence[i], offset[i] = s, window - free
        if free > v:
            bisect.insort(room, (free - v, s))
        fill[s] = window - free + v
    return sequence, offset, used


def _pack(window: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        give_back()  # all texts have been encoded by now
        rows = rows.sort_values(["doc_id", "start"], kind="stable", na_position="last").reset_index(drop=True)
        sequence, offset, _ = plan(rows["length"].to_numpy(np.int64), window)
        # the shard's number is the high part: sequences of all shards are distinct without any global count
        rows["sequence_id"], rows["offset"] = (int(key[0]) << 32) + sequence, offset
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty: their one id is the end id.  Rows that repeat an id are packed each on its own; they share
    doc_id and start and lie in different places.  An empty table gives no rows; other columns are not read.

    A sequence is padded to the window unless its length is a power of two.  A third of the documents may have one
    length: shards are dealt by a hash of the id and the ids' crc, never by length.
    """
    n = docs.count()
    shards = max(1, -(-n // shard))
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_pieces(tokenizer, window), PIECES)
    cut = cut.withColumn("_shard", F.when(F.col("length") == window, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(shards))).cast("long"))
    cut = materialise(cut, "pieces")
    # a whole window needs no partner: its sequence is named by its place in the table of pieces
    full = cut.filter("_shard = -1").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tails = cut.filter("_shard >= 0").groupBy("_shard").applyInPandas(_pack(window), PIECES + ", sequence_id long, offset long")
    return full.unionByName(tails)
