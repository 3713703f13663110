"""Vectors as rows of integer components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components saturate here, so that squared distances and inner products stay within 64 bits.
LIMIT = 1 << 24


def whole(vector: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only; an empty vector is whole."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of each component as an int64 row; shorter vectors end in zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(np.int64)
    return out
