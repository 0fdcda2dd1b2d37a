"""What the operators on embeddings share: usable rows, whole-number components and packed matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this, once scaled, count as this: sums of their products must fit a long.
LARGEST = 1 << 25


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds neither null nor a number that is not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return rows.where(F.col(vector).isNotNull() & ~F.exists(vector, odd))


def whole(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of every component, a row a vector; components that a shorter vector lacks are zero."""
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    flat = np.clip(np.floor(scale * np.asarray(vectors.flatten(), np.float64)), -LARGEST, LARGEST)
    if (sizes == width).all():
        return flat.astype(np.int32).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact_in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums over a row of products of these whole numbers are exact in doubles."""
    top = lambda x: int(np.abs(x).max(initial=0))
    return top(a) * top(b) * a.shape[-1] < 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, exact."""
    if exact_in_doubles(a, b):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def pack(rows: np.ndarray) -> pa.Array:
    """A binary a row."""
    rows = np.ascontiguousarray(rows)
    step = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def unpack(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The rows of ``pack``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)
