"""Column expressions over embedding vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COSINE_EPS
from .let import let


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def divided(vector: Column, by: Column) -> Column:
    """Every element divided by one number per row."""
    return let(by, lambda d: F.transform(vector, lambda x: x / d))


def l2_normalize(vector: Column, eps: float = COSINE_EPS) -> Column:
    """``x / max(|x|, eps)``."""
    return divided(vector, F.greatest(norm(vector), F.lit(eps)))


def unit(vector: Column, eps: float = COSINE_EPS) -> Column:
    """``x / (|x| + eps)``."""
    return divided(vector, norm(vector) + eps)


def cosine(left: Column, right: Column, normalize: bool = True, eps: float = COSINE_EPS) -> Column:
    """Cosine of two vectors, or their dot product with ``normalize=False``."""
    product = dot(left, right)
    if not normalize:
        return product
    return product / ((norm(left) + eps) * (norm(right) + eps))


def mean_vector(vectors: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""

    def mean(rows: Column) -> Column:
        rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        sums = F.aggregate(
            rest, F.get(rows, F.lit(0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)
        )
        return F.transform(sums, lambda x: x / F.size(rows))

    return let(vectors, mean)


def pool_mean(hidden: Column, mask: Column) -> Column:
    """Mean over the last ``sum(mask)`` token positions; an all-zero mask averages all of them."""
    length = F.aggregate(mask, F.lit(0), lambda acc, m: acc + m.cast("int"))
    count = F.when(length > 0, F.least(length, F.size(hidden))).otherwise(F.size(hidden))
    return mean_vector(F.slice(hidden, F.size(hidden) - count + 1, count))


def pool_cls(hidden: Column, mask: Column | None = None, first_unmasked: bool = False) -> Column:
    """The first token position, or with ``first_unmasked`` the first one that is not padding."""
    if not first_unmasked:
        return F.get(hidden, F.lit(0))
    start = F.array_position(F.transform(mask, lambda m: m.cast("int")), 1)
    return F.get(hidden, F.greatest(start - 1, F.lit(0)).cast("int"))


def hidden_state(states: Column, layer: Column) -> Column:
    """States of a layer: position 0 holds the input embedding, so layer ``l`` is at ``l + 1``."""
    inside = (layer >= 0) & (layer + 1 < F.size(states))
    message = F.concat(F.lit("layer out of range: "), layer.cast("string"))
    return F.when(inside, F.get(states, layer + 1)).otherwise(F.raise_error(message))
