"""Fill-in-the-middle transformation over seekable compressed frames.

``store_frames`` keeps a text as zstandard frames that can be opened one by one, each with the number of bytes, code points
and finished units before it.  A unit is a word with the white space before it; white space at the end of a text is a unit
of its own.  ``infill`` draws two cuts from the hash of the document's id, opens the frames in which they fall and no other,
and puts the output together from frames: whole ones are taken over as they are.  So the output is seekable as well.
``digests`` streams frames in order, one at a time, and rebuilds the text from the output and its form alone.

A unit ends where white space follows a word, and at the end of the text.  The byte of that white space is counted in the
frame that holds it, so a word of any length may run through many frames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.llm.common import groups_of, released, text_buffer

#: Bytes of text in a frame at most; frames end between code points.
FRAME = 1 << 16
LEVEL = 1
#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of texts that are transformed, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80

STORED = "doc_id long, size long, chars long, n long, marked boolean, frames array<struct<at: long, chars: long, units: long, open: boolean, data: binary>>"
FORM = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
OUTPUT = FORM + ", frames array<struct<at: long, data: binary>>"
_STORED_FRAME = pa.struct([("at", pa.int64()), ("chars", pa.int64()), ("units", pa.int64()), ("open", pa.bool_()), ("data", pa.binary())])
_OUTPUT_FRAME = pa.struct([("at", pa.int64()), ("data", pa.binary())])


def _ends(text: np.ndarray, inside: bool) -> np.ndarray:
    """Where white space follows a word; ``inside`` says whether a word is open before the first byte."""
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    before = np.empty(len(text), bool)
    if len(text):
        before[0], before[1:] = inside, ~blank[:-1]
    return np.flatnonzero(blank & before)


def _chars(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def _table(columns: list, kind: str, frame: pa.StructType) -> pa.RecordBatch:
    """Rows as a record batch of the columns of ``kind``, whose last one holds lists of frames."""
    names = [c.split()[0] for c in kind.split(", ")][: len(columns)]
    return pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x) for x in columns[:-1]), pa.array(columns[-1], pa.list_(frame))], names=names)


def _framed(size: int):
    @released
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            for i, j in groups_of(offsets, 4 << 20):
                sizes, chars, units, marked, all_frames = [], [], [], [], []
                for k in range(i, j):
                    text = data[offsets[k] : offsets[k + 1]]
                    n, at, n_chars, n_units, inside, mark, frames = len(text), 0, 0, 0, False, False, []
                    while at < n:
                        end = min(at + size, n)
                        while end < n and end > at + 1 and (text[end] & 0xC0) == 0x80:
                            end -= 1
                        part = text[at:end]
                        raw = part.tobytes()
                        seen = text[max(0, at - 2) : at].tobytes() + raw if at else raw  # a sentinel may lie across frames
                        mark = mark or any(x in seen for x in (PREFIX, SUFFIX, MIDDLE))
                        frames.append({"at": at, "chars": n_chars, "units": n_units, "open": inside, "data": press.compress(raw)})
                        n_chars += _chars(part)
                        n_units += len(_ends(part, inside))
                        inside = not (part[-1] == 32 or 9 <= part[-1] <= 13)
                        at = end
                    sizes.append(n)
                    chars.append(n_chars)
                    units.append(n_units + (n > 0))
                    marked.append(mark)
                    all_frames.append(frames)
                yield _table([b.column(0).slice(i, j - i).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, chars, units)), marked, all_frames], STORED, _STORED_FRAME)

    return store


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME) -> DataFrame:
    """One row for each row of ``docs``: doc_id, its text's bytes, code points (chars) and units (n), whether it holds a
    sentinel (marked), and its frames with what is before each.

    A null text is empty and has no frames; a null id stays null.  Frames hold ``size`` bytes at most and, from a size of four
    on, end between code points, so a task opens bounded pieces of a text of any length.  An empty table gives no rows; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(_framed(size), STORED)


class _Frames:
    """A row's frames; the one that was opened last stays open."""

    def __init__(self, frames: list[dict], size: int):
        self.frames, self.size, self.unpress, self.which, self.text = frames, size, zstandard.ZstdDecompressor(), -1, b""
        self.at = [f["at"] for f in frames]

    def open(self, k: int) -> bytes:
        if k != self.which:
            self.which, self.text = k, self.unpress.decompress(self.frames[k]["data"])
        return self.text

    def holding(self, at: int) -> int:
        return int(np.searchsorted(self.at, at, side="right")) - 1

    def between(self, a: int, z: int) -> Iterator[tuple[int | None, bytes]]:
        """The bytes from a up to z: (number, compressed data) of whole frames, (None, bytes) of pieces of a frame."""
        while a < z:
            k = self.holding(a)
            begin, end = self.at[k], self.at[k + 1] if k + 1 < len(self.at) else self.size
            if a == begin and z >= end:
                yield k, self.frames[k]["data"]
            else:
                yield None, self.open(k)[a - begin : min(z, end) - begin]
            a = min(z, end)


def _cut(row: _Frames, units: list[int], k: int, n: int, chars: int) -> tuple[int, int]:
    """Bytes and code points before the end of unit ``k`` of ``n``; opens one frame at most."""
    if k == 0:
        return 0, 0
    if k == n:
        return row.size, chars
    f = int(np.searchsorted(units, k, side="left")) - 1
    part = np.frombuffer(row.open(f), np.uint8)
    end = int(_ends(part, row.frames[f]["open"])[k - 1 - units[f]])
    return row.frames[f]["at"] + end, row.frames[f]["chars"] + _chars(part[:end])


@released
def _infilled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    marks = {x: press.compress(x) for x in (PREFIX, SUFFIX, MIDDLE)}
    for b in batches:
        rows = [b.column(name).to_pylist() for name in ("size", "chars", "n", "form", "first", "second")]
        frames_of = b.column("frames")
        prefix, middle, out = [], [], []
        for i, (size, chars, n, form, first, second) in enumerate(zip(*rows, strict=True)):
            frames = frames_of[i].as_py()
            if form == "plain":
                prefix.append(None)
                middle.append(None)
                out.append([{"at": f["at"], "data": f["data"]} for f in frames])
                continue
            row, units = _Frames(frames, size), [f["units"] for f in frames]
            (p, p_chars), (m, m_chars) = (_cut(row, units, k, n, chars) for k in (first, second))
            prefix.append(p_chars)
            middle.append(m_chars - p_chars)
            pieces = {PREFIX: (0, p), SUFFIX: (m, size), MIDDLE: (p, m)}
            made, at = [], 0
            for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
                made.append({"at": at, "data": marks[mark]})
                at += len(mark)
                for whole, data in row.between(*pieces[mark]):
                    made.append({"at": at, "data": press.compress(data) if whole is None else data})
                    at += len(data) if whole is None else (row.at[whole + 1] if whole + 1 < len(row.at) else size) - row.at[whole]
            out.append(made)
        yield _table([b.column("doc_id"), b.column("n"), b.column("form"), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), out], OUTPUT, _OUTPUT_FRAME)


def infill(stored: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Rows of ``store_frames`` to outputs: doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and frames.

    Of the groups of eight digits of sha256(``seed``:doc_id), the first two choose the ends of prefix and middle among the
    n + 1 places between units, the third whether the text is transformed (``rate`` per cent are), the fourth whether the
    suffix comes first (``suffix_first`` per cent).  Empty texts and texts that hold a sentinel stay plain, with null
    lengths.  A null id counts as the empty one.  Rows that repeat an id have equal draws.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_sha", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    form = F.when((F.col("size") == 0) | F.col("marked") | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    drawn = stored.withColumn("_sha", digest).select("doc_id", "size", "chars", "n", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"), "frames")
    return drawn.mapInArrow(_infilled, OUTPUT)


def _stream(frames: list[dict]) -> Iterator[bytes]:
    unpress = zstandard.ZstdDecompressor()
    for f in frames:
        yield unpress.decompress(f["data"])


def _sentinels(frames: list[dict]) -> tuple[dict[bytes, int], int]:
    """Where the sentinels stand in an output, and its size; a sentinel may lie across frames."""
    found, size, tail = {}, 0, b""
    for text in _stream(frames):
        seen = tail + text
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in found and (k := seen.find(mark)) >= 0:
                found[mark] = size - len(tail) + k
        size += len(text)
        tail = seen[-2:]
    return found, size


def _restored(frames: list[dict], form: str) -> Iterator[bytes]:
    """The pieces of the text that an output of this form was made of, in order, a frame at a time."""
    if form == "plain":
        yield from _stream(frames)
        return
    places, size = _sentinels(frames)
    order = sorted(places.values())
    row = _Frames(frames, size)
    for mark in (PREFIX, MIDDLE, SUFFIX):
        begin = places[mark]
        end = next((x for x in order if x > begin), size)
        for whole, data in row.between(begin + len(mark), end):
            yield data if whole is None else row.open(whole)


@released
def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        form, frames_of, made, back = b.column("form").to_pylist(), b.column("frames"), [], []
        for i in range(b.num_rows):
            frames = frames_of[i].as_py()
            out, text = hashlib.sha256(), hashlib.sha256()
            for part in _stream(frames):
                out.update(part)
            for part in _restored(frames, form[i]):
                text.update(part)
            made.append(out.hexdigest())
            back.append(text.hexdigest())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(made, pa.string()), pa.array(back, pa.string())], names=[*b.schema.names[:5], "output_sha256", "restored_sha256"])


def digests(outputs: DataFrame) -> DataFrame:
    """Rows of ``infill`` without frames, with the SHA-256 of the output and of the text rebuilt from output and form."""
    return outputs.mapInArrow(_digested, FORM + ", output_sha256 string, restored_sha256 string")


@released
def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        form, frames_of = b.column("form").to_pylist(), b.column("frames")
        for i in range(b.num_rows):
            frames = frames_of[i].as_py()
            both = [pa.array([b"".join(x)], pa.binary()).cast(pa.string()) for x in (_stream(frames), _restored(frames, form[i]))]
            yield pa.RecordBatch.from_arrays([b.column(c).slice(i, 1) for c in range(5)] + both, names=[*b.schema.names[:5], "output", "restored"])


def texts(outputs: DataFrame) -> DataFrame:
    """Rows of ``infill`` with the whole output and the text rebuilt from it, instead of frames."""
    return outputs.mapInArrow(_written, FORM + ", output string, restored string")
