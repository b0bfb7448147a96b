"""Arrow batches as one compressed value: what a task sends to a bucket is a row, not a row an entry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import ipc

OPTIONS = ipc.IpcWriteOptions(compression="zstd")


def packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with ipc.new_stream(out, batch.schema, options=OPTIONS) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    with ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def by_key(batch: pa.RecordBatch, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(keys, their number of rows, packed rows) of a batch whose keys are in order, a row a key."""
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff([*heads, len(keys)])
    return keys[heads], sizes, [packed(batch.slice(int(i), int(n))) for i, n in zip(heads, sizes, strict=True)]
