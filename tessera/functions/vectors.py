"""Vector functions over array<float> or array<double> columns; sums are in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """VEC-2."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """VEC-1: 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def clip(a: Column, bound: float) -> Column:
    """VEC-4: scaled down to a norm of bound at most."""
    by = F.least(F.lit(1.0), F.lit(bound) / F.greatest(norm(a), F.lit(1e-6)))
    return F.transform(a, lambda x: x.cast("double") * by)


def noise_std(bound: float, epsilon: float, delta: Column) -> Column:
    """VEC-6, and 0 for an infinite epsilon (VEC-7: clipping alone)."""
    return F.lit(0.0) if math.isinf(epsilon) else 2 * bound / epsilon * F.sqrt(2 * F.log(1.25 / delta))


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 32 bits of a digest of the key; the same in any engine and on any layout."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def gaussian(key: Column) -> Column:
    """Box-Muller over two uniforms of the key."""
    return F.sqrt(-2 * F.log(uniform(F.concat(key, F.lit(":a"))))) * F.cos(2 * math.pi * uniform(F.concat(key, F.lit(":b"))))


def noisy(a: Column, id_: Column, std: float, seed: int) -> Column:
    """VEC-5: Gaussian noise of a standard deviation, drawn by (seed, id, place)."""
    key = F.concat(F.lit(f"{seed}:"), id_.cast("string"), F.lit(":"))
    return F.transform(a, lambda x, i: x.cast("double") + std * gaussian(F.concat(key, i.cast("string"))))


def selectively_noisy(vectors: Column, mask: Column, id_: Column, limit: float, std: float, seed: int) -> Column:
    """VEC-4, VEC-5 where the mask holds: of an array of vectors, one for each token, those are clipped and noised, the others stay as they are."""

    def of(v: Column, i: Column) -> Column:
        key = F.concat_ws(":", id_.cast("string"), i.cast("string"))
        return F.when(F.get(mask, i), noisy(clip(v, limit), key, std, seed)).otherwise(F.transform(v, lambda x: x.cast("double")))

    return F.transform(vectors, of)


def round_even(c: Column, places: int = 4) -> Column:
    """VEC-9: half to even."""
    return F.bround(c, places)


def steps(rows: Column, world: int, batch: int, accumulate: int, epochs: int) -> Column:
    """MTH-1."""
    return F.ceil(rows / (world * batch * accumulate)) * epochs
