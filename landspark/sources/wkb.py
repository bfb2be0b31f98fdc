"""Geometry columns in hex WKB or EWKB: parsed in Arrow batches, ring by ring, into flat coordinates and offsets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from landspark.functions import geometry as g

GEOM = ArrayType(ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))))
POLYGON, MULTI, COLLECTION = 3, 6, 7
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000


def _read(data: bytes, at: int, polygons: list[list[np.ndarray]]) -> int:
    """Append the polygons of the geometry at ``at``; return where it ends."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 9 if code & HAS_SRID else 5
    dims = 2 + bool(code & HAS_Z) + bool(code & HAS_M)
    kind = code & 0xFFFF
    dims, kind = dims + (0, 1, 1, 2)[kind // 1000 % 4], kind % 1000
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind in (MULTI, COLLECTION):
        for _ in range(n):
            at = _read(data, at, polygons)
        return at
    if kind != POLYGON:
        raise ValueError(f"geometry of type {kind}")
    rings = []
    for _ in range(n):
        (m,) = struct.unpack_from(order + "I", data, at)
        xy = np.frombuffer(data, order + "f8", m * dims, at + 4).reshape(m, dims)[:, :2]
        at += 4 + m * dims * 8
        rings.append(xy[:-1] if m > 1 and (xy[0] == xy[-1]).all() else xy)
    polygons.append(rings)
    return at


def _decoded(batches: Iterator[pa.RecordBatch], column: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, rings, ends, points, valid, errors = [0], [0], [0], [np.empty((0, 2))], [], []
        for text in batch.column(column).to_pylist():
            polygons, reason = [], None
            try:
                _read(bytes.fromhex((text or "").strip()), 0, polygons)
                reason = None if polygons else "no polygon"
            except (ValueError, struct.error, IndexError) as error:
                polygons, reason = [], f"wkb: {error}"
            for polygon in polygons:
                for ring in polygon:
                    points.append(ring)
                    ends.append(ends[-1] + len(ring))
                rings.append(rings[-1] + len(polygon))
            parts.append(parts[-1] + len(polygons))
            valid.append(reason is None)
            errors.append(reason)
        flat = np.concatenate(points).astype("f8")
        vertices = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)], ["x", "y"])
        nest = lambda offsets, values, mask=None: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)
        geom = nest(parts, nest(rings, nest(ends, vertices)), pa.array([not v for v in valid], pa.bool_()) if valid else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, geom.cast(schema.field("geom").type), pa.array(errors, pa.string())], schema=schema)


def decode_wkb(df: DataFrame, column: str = "geom_wkb") -> DataFrame:
    """``df`` with ``geom`` and ``geom_error`` of its hex WKB or EWKB column.

    Polygons, multipolygons and the polygons of collections, of any byte order, with or without SRID, Z and M; rings are not
    closed and turn as the other operators want them.  Anything else, null and empty texts too, has no geometry and a reason.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([*df.schema.fields, StructField("geom", GEOM), StructField("geom_error", StringType())])
    schema = to_arrow_schema(out)
    rows = df.mapInArrow(lambda batches: _decoded(batches, column, schema), out)
    return rows.withColumn("geom", g.normalise_rings(rows["geom"]))
