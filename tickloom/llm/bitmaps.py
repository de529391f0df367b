"""A set of keys as a bitmap of fixed size, to thin out rows before a shuffle.

The size is a parameter and never grows with the data; a full bitmap lets every row through, so it
changes what is moved and never what comes out. Exact joins follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**BITS bits: 4 MiB.
BITS = 25
_CHUNK = 1 << 19


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap (uint8) of a one-column frame of longs, built by chunk on the executors."""
    name = keys.columns[0]

    def places(batches):
        for batch in batches:
            at = np.unique(_place(batch.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.record_batch({"chunk": pa.array((at // _CHUNK).astype(np.int32)), "bit": pa.array((at % _CHUNK).astype(np.int32))})

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(_CHUNK, bool)
        own[table.column("bit").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    rows = (keys.filter(F.col(name).isNotNull()).mapInArrow(places, "chunk int, bit int").distinct()
            .groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").collect())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r["chunk"] * _CHUNK // 8:(r["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _place(keys, len(bitmap).bit_length() + 2).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
