"""Many values as one compressed binary, so that a shuffle moves few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TERM_END = "\n"  # in no token


def small(values: np.ndarray) -> pa.Array:
    """Whole numbers in the narrowest type that holds them."""
    low, high = values.min(initial=0), values.max(initial=0)
    fits = (t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return pa.array(values.astype(next(fits, np.int64)))


def listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def block(columns: dict[str, pa.Array]) -> bytes:
    """One row of ``columns``; a column of many values is ``listed``."""
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def columns(data: pa.Buffer) -> dict[str, pa.Array]:
    """The values of each column of a block."""
    with pa.ipc.open_stream(data) as reader:
        read = reader.read_next_batch()
    return {name: read[name].flatten() for name in read.schema.names}


def joined(terms: pa.Array) -> pa.Array:
    """Terms as one string."""
    return pc.binary_join(listed(terms), TERM_END)


def parted(text: pa.Array, count: int) -> pa.Array:
    """The ``count`` terms of one string."""
    return pc.split_pattern(text, TERM_END).flatten() if count else pa.array([], pa.string())
