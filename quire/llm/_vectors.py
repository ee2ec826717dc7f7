"""Vector columns as exact integers: which rows are whole, how components become integers, and their Arrow blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components stay under this, so that squared distances of up to 1,024 components fit in a long exactly.
LIMIT = 1 << 25
#: Rows of a block: distances to all entries of all parts are held for so many vectors at once.
BLOCK = 2048


def whole(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components; an empty one is whole."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def in_range(vector: Column, scale: int) -> Column:
    """Whether all integers floor(scale * x) of a whole vector are of a size whose distances are exact."""
    return F.forall(vector, lambda x: F.abs(x.cast("double")) < LIMIT / scale)


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; scale is a power of two, so the product is exact."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column, null ones left out, as an int64 matrix; every list has ``width`` components."""
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part, ties to the lower index.

    x is parts x rows x width, entries parts x entries x width, both int64. |x - c|^2 = |x|^2 - 2 x.c + |c|^2, with the
    products as one integer matrix product for each part.
    """
    d = np.matmul(x, entries.transpose(0, 2, 1))
    d *= -2
    d += np.einsum("pij,pij->pi", entries, entries)[:, None, :]
    index = d.argmin(axis=2)
    least = np.take_along_axis(d, index[:, :, None], axis=2)[:, :, 0] + np.einsum("pij,pij->pi", x, x)
    return index, least
