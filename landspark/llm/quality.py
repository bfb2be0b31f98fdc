"""A byte-level convolutional classifier of document quality, in numpy.

Bytes are embedded; filters of twelve bytes slide over the whole text in steps of four; their responses are max-pooled
within overlapping chunks, which cover every byte, and the pooled chunks are combined, by their mean and by their maximum,
into one logistic probability.  Everything is learned here, from a bounded and documented sample of labelled rows, on the
driver; scoring runs in Arrow batches on the executors with the few kilobytes of weights in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.llm.common import groups_of, materialise, released, text_buffer

DIM, FILTERS, STEP, PARTS = 8, 16, 4, 3
#: Steps (of four bytes) that a chunk advances; with the filter's reach, chunks overlap by eight bytes.
CHUNK = 64
#: Labelled rows of each class that a fit reads at most, and the longest text among them in bytes.
SAMPLE, LONGEST = 1500, 32_768
THRESHOLD = 0.3


def packed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out so that each begins a chunk: rows of four bytes (0 where there are none), and each text's first chunk.

    A text of n bytes takes ceil(n / (4 * CHUNK)) chunks, one at least, so no byte is left out.
    """
    sizes = np.diff(offsets)
    chunks = np.maximum(1, -(-sizes // (STEP * CHUNK)))
    first = np.concatenate(([0], np.cumsum(chunks)))
    out = np.zeros(first[-1] * STEP * CHUNK + STEP * (PARTS - 1), np.uint8)
    for i, at in enumerate(first[:-1] * (STEP * CHUNK)):
        out[at : at + sizes[i]] = data[offsets[i] : offsets[i + 1]]
    return out.reshape(-1, STEP), first


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.w = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(f32),
            "filters": rng.normal(0, (STEP * PARTS * DIM) ** -0.5, (PARTS, STEP * DIM, FILTERS)).astype(f32),
            "bias": np.zeros(FILTERS, f32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(f32),
            "intercept": np.zeros(1, f32),
        }
        self.shift = 0.0
        self.settle()

    def settle(self) -> None:
        """Put embeddings and filters on grids whose products add up exactly in single precision (below 2**10).

        A response is then the same number in whatever order a library adds its terms, and so is a text's score wherever
        and beside whatever other texts it is computed.
        """
        for name, grid in (("embed", 64), ("filters", 256)):
            self.w[name] = (np.round(self.w[name] * grid) / grid).astype(np.float32)

    def pooled(self, rows: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, FILTERS) largest responses, and where in the chunk each is.

        ``last``: the chunks that end a text; responses that would reach into the next text take no part.
        """
        n = len(rows) - (PARTS - 1)
        x = self.w["embed"][rows.ravel()].reshape(len(rows), STEP * DIM)
        y = x[:n] @ self.w["filters"][0]
        for k in range(1, PARTS):
            y += x[k : k + n] @ self.w["filters"][k]
        y = y.reshape(-1, CHUNK, FILTERS)
        y[last, CHUNK - (PARTS - 1) :] = -np.inf
        at = y.argmax(1)
        return np.take_along_axis(y, at[:, None, :], 1)[:, 0, :] + self.w["bias"], at

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        rows, first = packed(data, offsets)
        ends = first[1:] - 1
        top = np.concatenate([np.tanh(self.pooled(rows[a * CHUNK : b * CHUNK + PARTS - 1], ends[(ends >= a) & (ends < b)] - a)[0]) for a, b in blocks(first[-1])])
        mean = np.add.reduceat(top, first[:-1], 0) / np.diff(first)[:, None]
        most = np.maximum.reduceat(top, first[:-1], 0)
        # summed row by row, so that rounding doesn't depend on the rows beside a text's own
        z = (np.hstack([mean, most]).astype(np.float64) * self.w["out"].astype(np.float64)).sum(1) + float(self.w["intercept"][0]) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 3) -> Network:
        """Adam on the logistic loss; the gradient of a pooled response goes to the bytes that gave it."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in part])))
                rows, first = packed(np.frombuffer(b"".join(texts[i] for i in part), np.uint8), offsets)
                raw, at = self.pooled(rows, first[1:] - 1)
                top = np.tanh(raw)
                sizes = np.diff(first)
                mean = np.add.reduceat(top, first[:-1], 0) / sizes[:, None]
                most = np.maximum.reduceat(top, first[:-1], 0)
                features = np.hstack([mean, most])
                p = 1 / (1 + np.exp(-np.clip(features @ self.w["out"] + self.w["intercept"][0], -30, 30)))
                dz = ((p - labels[part]) / len(part)).astype(np.float32)
                df = dz[:, None] * self.w["out"]
                doc = np.repeat(np.arange(len(part)), sizes)
                dtop = (df[:, :FILTERS] / sizes[:, None])[doc]
                dtop += df[doc, FILTERS:] * (top == most[doc])
                draw = dtop * (1 - top * top)
                grads = {"out": features.T @ dz, "intercept": dz.sum(keepdims=True), "bias": draw.sum(0)}
                place = at + (np.arange(len(at)) * CHUNK)[:, None]  # row of four bytes at which the response begins
                window = rows[(place[..., None] + np.arange(PARTS))]  # chunks, filters, parts, four bytes
                x = self.w["embed"][window].reshape(len(at), FILTERS, PARTS, STEP * DIM)
                grads["filters"] = np.einsum("cf,cfpd->pdf", draw, x, optimize=True)
                back = (draw[:, :, None, None] * self.w["filters"].transpose(2, 0, 1)[None]).reshape(-1, DIM)
                flat = window.ravel()
                grads["embed"] = np.stack([np.bincount(flat, back[:, d], 256) for d in range(DIM)], 1)
                t += 1
                step = rate * min(1.0, 2.0 * (1 - epoch / epochs))
                for k, g in grads.items():
                    g = g.astype(np.float32) + (1e-4 * self.w[k] if k in ("out", "filters") else 0)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.w[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        self.settle()
        return self


def blocks(n: int, size: int = 2048):
    """Ranges of chunks for which numpy's temporaries stay in cache."""
    return [(a, min(n, a + size)) for a in range(0, int(n), size)]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """The bounded sample: of each quality the ``sample`` documents with the smallest hash of their id, never held-out ones.

    Ids are chosen first, so the texts that reach the driver are at most 2 * ``sample`` of at most ``longest`` bytes.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    usable = docs.filter(F.octet_length("text") <= longest).select("doc_id").join(known, "doc_id").distinct()
    chosen = None
    for q in (0, 1):
        part = usable.filter(F.col("_quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.collect()  # at most 2 * sample pairs of numbers
    if not ids:
        return []
    small = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r._quality) for r in ids], "doc_id long, _quality int"))
    rows = docs.filter(F.octet_length("text") <= longest).select("doc_id", F.col("text").cast("binary").alias("_bytes")).join(small, "doc_id").groupBy("doc_id", "_quality").agg(F.max("_bytes").alias("_bytes")).collect()
    return [(bytes(r._bytes), r._quality) for r in sorted(rows, key=lambda r: r.doc_id)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Network:
    """A network fitted on the bounded sample, its intercept moved to the classes' true shares among the labels."""
    rows = training_rows(docs, labels, sample, longest)
    net = Network()
    y = np.array([q for _, q in rows], np.float32)
    shares = {r.quality: r["count"] for r in labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).filter("quality IN (0, 1)").groupBy("quality").count().collect()}
    bad, good = shares.get(0, 0), shares.get(1, 0)
    if len(rows) < 10 or not 0 < y.sum() < len(y):  # nothing to learn from: the labels' share, the same for every text
        net.w["out"][:] = 0
        net.w["intercept"][:] = np.log((good + 0.5) / (bad + 0.5))
        return net
    net.fit([t for t, _ in rows], y)
    net.shift = float(np.log(good / bad) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of each row of ``docs``: the probability that quality is 1, from every byte of the text.

    Null texts are empty, and empty texts get the score of a chunk of zeros.  Rows that repeat an id are scored each on
    its own; an empty table gives no rows; no other column is read.
    """

    @released
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            out = [net.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in groups_of(offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``; columns as they were, without a shuffle.

    They are written as a table at once, so that Python gets batches of bounded bytes, however long the texts.
    Null and empty texts are scored as empty; rows that repeat an id are judged each by its own text; an empty table gives
    no rows; without labels of both classes every text gets the labels' share, so all rows stay or all go.
    """
    net, names = fit(docs, labels), docs.columns

    @released
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column(names.index("text")))
            out = [net.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in groups_of(offsets)]
            yield b.filter(pa.array(np.concatenate(out) >= threshold if out else np.zeros(0, bool)))

    return materialise(docs.mapInArrow(keep, docs.schema), "kept")
