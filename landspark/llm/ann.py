"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are centred, normalised and turned by one random rotation; the signs of the coordinates, packed to bits, are the
code, and two scalars (the distance to the centre and the code's inner product with its own vector) correct the estimate.
The estimated inner product with a rotated query is unbiased, and its error is bounded with high probability by a multiple
of sqrt((1 - a * a) / (a * a * (dimension - 1))), where a is the second scalar.  The bounds choose which vectors are
compared with the query exactly: those whose lower bound is not above the k-th smallest upper bound, or the k-th distance
found so far.  Every row is indexed; the centre is the mean of all rows.

The index is a table of blocks.  Queries are blocks too, and meet the index in waves that are small enough to broadcast; a
task keeps the k best of each query over all blocks it reads.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landspark.llm.common import materialise

#: Rows of a block, of the index and of queries, and query blocks in a wave (1024 queries of 1000 doubles are 8 MB).
BLOCK, QUERIES, WAVE = 4096, 1024, 8
#: Width of the error bound, in the standard deviations of the estimate's random part.
WIDTH = 4.0
CODES = "dim int, ids binary, bits binary, far binary, own binary, vectors binary"


@functools.lru_cache(maxsize=4)  # of the last few dimensions, in each worker
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(_id, _v as array<double>) of the rows whose vector is neither null, empty nor zero and has only finite components."""
    v = F.col(col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("_id"), v.alias("_v")).filter(F.col("_id").isNotNull() & F.col("_v").isNotNull() & good)


def _matrices(batch: pa.RecordBatch):
    """(ids, matrix) for each dimension in a batch of (_id, _v)."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes, ids = np.diff(offsets), batch.column(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, ids[at], values[offsets[:-1][at][:, None] + np.arange(dim)].astype(np.float64)


def centres(usable: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension: partial sums in the tasks, one row for each coordinate to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, ids, x in _matrices(b):
                total[dim] = total.get(dim, np.zeros(dim + 1)) + np.append(x.sum(0), len(ids))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(map(list, total.values()), pa.list_(pa.float64()))], names=["dim", "sums"])

    rows = usable.mapInArrow(sums, "dim int, sums array<double>").select("dim", F.posexplode("sums")).groupBy("dim", "pos").agg(F.sum("col").alias("total")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.dim, np.zeros(r.dim + 1))[r.pos] = r.total
    return {dim: x[:-1] / x[-1] for dim, x in out.items()}


def encode(usable: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """The index: ``CODES``, one row for each block of up to ``BLOCK`` vectors of one dimension."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                for dim, ids, x in _matrices(_compact(b.slice(start, BLOCK))):
                    turned = (x - centre[dim]) @ rotation(dim)
                    far = np.sqrt((turned * turned).sum(1))
                    unit = turned / np.where(far > 0, far, 1)[:, None]
                    own = np.abs(unit).sum(1) / np.sqrt(dim)
                    parts = [ids.astype(np.int64), np.packbits(turned > 0, axis=1), far, np.where(far > 0, own, 1.0), x]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=[c.split()[0] for c in CODES.split(", ")])

    return usable.mapInArrow(code, CODES)


def _compact(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pa.array(np.arange(batch.num_rows)))


def _query_blocks(usable: DataFrame, blocks: int) -> DataFrame:
    """Queries dealt by a hash of their id to blocks of about ``QUERIES``; of rows that repeat an id, the smallest vector asks."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id")
        size = rows["_v"].map(len)
        return pd.DataFrame([{"dim": d, "_qb": int(key[0]), "_qids": part["_id"].to_numpy(np.int64).tobytes(), "_qv": np.stack(part["_v"].to_numpy()).astype(np.float64).tobytes()} for d, part in rows.groupby(size)])

    one = usable.groupBy("_id").agg(F.min("_v").alias("_v")).withColumn("_qb", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    return one.groupBy("_qb").applyInPandas(pack, "dim int, _qb int, _qids binary, _qv binary")


def _best(k: int, centre: dict[int, np.ndarray], width: float):
    def merge(state, q, d, ids):
        """State (queries, k) of distances and ids with more (query, distance, id) rows; an id counts once, ties to the smaller id."""
        n = len(state[0])
        q = np.concatenate([np.repeat(np.arange(n), k), q])
        d, ids = np.concatenate([state[0].ravel(), d]), np.concatenate([state[1].ravel(), ids])
        order = np.lexsort((d, ids, q))
        again = np.zeros(len(q), bool)
        again[1:] = (q[order][1:] == q[order][:-1]) & (ids[order][1:] == ids[order][:-1]) & (d[order][1:] < np.inf)
        order = order[~again]
        order = order[np.lexsort((ids[order], d[order], q[order]))]
        q, first = q[order], np.searchsorted(q[order], np.arange(n))
        order = order[np.arange(len(order)) - first[q] < k]
        return d[order].reshape(n, k), ids[order].reshape(n, k)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                dim, key = r["dim"], (r["dim"], r["_qb"])
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, dim)
                far, own = np.frombuffer(r["far"]), np.frombuffer(r["own"])
                n = len(ids)
                bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8).reshape(n, -1), axis=1, count=dim)
                signs = bits.astype(np.float32) * 2 - 1
                qids, q = np.frombuffer(r["_qids"], np.int64), np.frombuffer(r["_qv"]).reshape(-1, dim)
                turned = (q - centre[dim]) @ rotation(dim)
                qfar = np.sqrt((turned * turned).sum(1))
                unit = (turned / np.where(qfar > 0, qfar, 1)[:, None]).astype(np.float32)
                if key not in states:
                    states[key] = [(np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)), qids]
                by_id = np.argsort(ids, kind="stable")
                starts = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id][:1] - 1)) if n else by_id
                error = width * np.sqrt(np.maximum(0, 1 - own * own) / (own * own * max(1, dim - 1))) + 1e-5
                for a in range(0, len(q), 256):
                    rows = slice(a, a + 256)
                    inner = (unit[rows] @ signs.T) / np.float32(np.sqrt(dim)) / own.astype(np.float32)
                    scale = 2 * far[None, :] * qfar[rows, None]
                    middle = far[None, :] ** 2 + qfar[rows, None] ** 2 - scale * inner
                    middle[qids[rows, None] == ids[None, :]] = np.inf
                    slack = scale * error[None, :]
                    state = tuple(s[rows] for s in states[key][0])
                    limit = state[0][:, -1] ** 2
                    if len(starts) >= k:
                        upper = middle + slack
                        if len(starts) < n:  # of rows that repeat an id the nearest counts, once
                            upper = np.minimum.reduceat(upper[:, by_id], starts, axis=1)
                        limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
                    qi, ci = np.nonzero((middle - slack <= limit[:, None] * (1 + 1e-9)) & (middle < np.inf))
                    exact = np.empty(len(qi))
                    for c in range(0, len(qi), 1 << 15):
                        gap = x[ci[c : c + (1 << 15)]] - q[rows][qi[c : c + (1 << 15)]]
                        exact[c : c + (1 << 15)] = np.sqrt((gap * gap).sum(1))
                    for whole, part in zip(states[key][0], merge(state, qi, exact, ids[ci]), strict=True):
                        whole[rows] = part
        for (_, _), ((d, found), qids) in states.items():
            q = np.repeat(qids, k)
            real = d.ravel() < np.inf
            yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(found.ravel()[real]), pa.array(d.ravel()[real])], names=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, width: float = WIDTH, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest rows of ``vectors`` but its own id: query_id, rank, vec_id, score (Euclidean, in doubles).

    ``queries`` has the same columns as ``vectors``.  Vectors that are null, empty or zero, or hold null or non-finite
    components, take no part, nor do rows without an id; vectors of another dimension are no candidates of a query.  Equal
    distances go to the smaller id; of rows that repeat an id the nearest counts, once.  Empty tables give no rows.
    """
    usable = usable_vectors(vectors, id_col, col)
    asking = usable_vectors(queries, id_col, col)
    centre = centres(usable)
    index = materialise(encode(usable, centre), "codes")
    blocks = max(1, -(-asking.count() // QUERIES))
    asked = materialise(_query_blocks(asking, blocks), "queries")
    found = None
    for at in range(0, blocks, WAVE):  # a wave's queries are bounded, so it may be broadcast; waves are independent
        wave = F.broadcast(asked.filter(F.col("_qb").between(at, at + WAVE - 1)))
        part = index.join(wave, "dim").mapInArrow(_best(k, centre, width), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
