"""Scan messages in the FlatBuffers wire form: five fields in one table, read and written with struct and numpy.

Layout (public FlatBuffers encoding, little endian): a 4-byte offset to the table; the table begins with a signed offset back
to its vtable; the vtable holds its size, the table's size and a 2-byte offset for each field (0: absent, so the default 0).
Field order is that of the message: first_sample_unix_ns, sample_interval_ns, actual_scan_rate_hz, sequence, values.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "first_sample_unix_ns bigint, sample_interval_ns bigint, actual_scan_rate_hz double, sequence bigint, values array<double>"
_ARROW = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
_NAMES = ["first_sample_unix_ns", "sample_interval_ns", "actual_scan_rate_hz", "sequence", "values"]


def decode(data: bytes | None) -> tuple | None:
    """The five fields, or None if the bytes are no such message or a time passes the greatest BIGINT. An absent vector is None."""
    found = _fields(data)
    return found and (*found[:4], None if found[4] is None else found[4].tolist())


def _fields(data: bytes | None) -> tuple | None:
    """As decode, with the values as a numpy view of the bytes."""
    if not data:
        return None
    try:
        table = struct.unpack_from("<I", data, 0)[0]
        vtable = table - struct.unpack_from("<i", data, table)[0]
        size = struct.unpack_from("<H", data, vtable)[0]
        if vtable < 0 or size < 4 or size % 2:
            return None

        def at(field: int) -> int:
            slot = 4 + 2 * field
            offset = struct.unpack_from("<H", data, vtable + slot)[0] if slot < size else 0
            return table + offset if offset else 0

        def number(field: int, kind: str):
            return struct.unpack_from(kind, data, at(field))[0] if at(field) else 0

        first, interval, rate, sequence = number(0, "<Q"), number(1, "<Q"), float(number(2, "<d")), number(3, "<Q")
        if max(first, interval, sequence) >= 1 << 63:
            return None
        values = None
        if p := at(4):
            start = p + struct.unpack_from("<I", data, p)[0]
            n = struct.unpack_from("<I", data, start)[0]
            if start + 4 + 8 * n > len(data):
                return None
            values = np.frombuffer(data, "<f8", n, start + 4)
        return first, interval, rate, sequence, values
    except struct.error:
        return None


def _lists(arrays: list) -> pa.ListArray:
    """A list column over one buffer of all values; None gives null."""
    ends = np.cumsum([0, *[0 if a is None else len(a) for a in arrays]])
    offsets = pa.array([None if k < len(arrays) and arrays[k] is None else int(e) for k, e in enumerate(ends)], pa.int32())
    own = [a for a in arrays if a is not None]
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own) if own else np.empty(0), pa.float64()))


def encode(first: int, interval: int, rate: float, sequence: int, values) -> bytes:
    """A message with all five fields."""
    v = np.asarray(values, "<f8")
    vtable = struct.pack("<7H", 14, 44, 8, 16, 24, 32, 40)
    # 4: root offset; 2: padding; 14: vtable at 6; table at 20: soffset, padding, 4 numbers, vector offset; the vector's length lies 4 bytes before its 8-byte elements
    table = struct.pack("<i4xQQdQI", 14, first, interval, rate, sequence, 4)
    return struct.pack("<I2x", 20) + vtable + table + struct.pack("<I", len(v)) + v.tobytes()


def decode_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the fields of each payload in Arrow batches; rows whose payload is no message are dropped. Filters on other columns belong before this."""
    keep = [c for c in df.columns if c != payload]
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in keep] + list(T.StructType.fromDDL(SCHEMA).fields))

    def run(batches):
        for b in batches:
            found = [_fields(x) for x in b.column(payload).to_pylist()]
            ok = pa.array([f is not None for f in found])
            rows = [f for f in found if f is not None]
            fields = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(_ARROW[:4])] + [_lists([r[4] for r in rows])]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in keep] + fields, names=keep + _NAMES)

    return df.mapInArrow(run, schema)


def accepted(df: DataFrame) -> DataFrame:
    """Messages with a vector that isn't empty, all of it finite: others are rejected whole."""
    return df.where((F.size("values") > 0) & F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
