"""Vectors as Arrow lists: which rows count, and rows of equal length as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector is there, has entries, and all of them are finite numbers."""
    number = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    return F.coalesce(F.forall(vector, number) & (F.size(vector) > 0), F.lit(False))


def floored(vector: Column, scale: int, shift: int = 0, limit: int = 1 << 40) -> Column:
    """``floor(scale * entry) + shift`` as longs. Products beyond ``limit`` become the limit, so that
    no entry leaves the range that later sums are exact in."""

    def entry(x: Column) -> Column:
        product = F.least(F.greatest(x.cast("double") * scale, F.lit(-float(limit))), F.lit(float(limit)))
        return F.floor(product) + F.lit(shift).cast("long")

    return F.transform(vector, entry)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column without nulls, all of ``width`` entries, as rows."""
    return np.asarray(column.flatten()).reshape(-1, width)
