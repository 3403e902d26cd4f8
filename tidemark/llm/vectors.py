"""What the operators on embeddings share: which vectors take part, and their exact integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 2.0**-24  # rounding unit of float32


def whole(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, none of them null, NaN or infinite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & sound, F.lit(False))


def integers(column: pa.Array, dim: int, factor: int, bits: int) -> np.ndarray:
    """floor(factor * x) of whole vectors as rows of 64-bit integers, x as double; a value of 2**bits or more is an error, since products would leave 64 bits."""
    values = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * float(factor))
    if len(values) and np.abs(values).max() >= 2.0**bits:
        raise ArithmeticError(f"a component is 2**{bits} / {factor} or more: its products don't fit 64 bits")
    return values.astype(np.int64).reshape(-1, dim)


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms of integer rows, never below the true ones."""
    f = x.astype(np.float64)
    return np.sqrt((f * f).sum(1)) * (1 + 1e-12)
