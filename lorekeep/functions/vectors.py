"""Vector columns: array<float|double> expressions computed in double."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length, null where one is null."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).when(size == 0, F.lit(0.0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row; inside a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def truncate_norm(a: Column, dim: int) -> Column:
    """The first ``dim`` components at length one; a vector without length stays as it is."""
    scaled = lambda h, size: F.transform(h, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))
    return once(F.slice(a, 1, dim), lambda h: once(norm(h), lambda size: scaled(h, size)))


def stub_embed(text: Column, dim: int) -> Column:
    """A deterministic unit vector of a text: bytes of its SHA-256, repeated, as (b - 128) / 128."""
    byte = lambda digest, i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    raw = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (byte(digest, i) - 128.0) / 128.0)
    return truncate_norm(once(F.sha2(text, 256), raw), dim)


def stub_digest(text: Column) -> Column:
    """What ``stub_embed`` makes its vector of, as bytes."""
    return F.unhex(F.sha2(text, 256))


def stub_rows(dim: int) -> Callable[[pd.Series], np.ndarray]:
    """Reads a column of ``stub_digest`` as the vectors of ``stub_embed``, but for their length."""
    return lambda digests: (np.frombuffer(b"".join(digests), "u1").reshape(-1, 32)[:, np.arange(dim) % 32] - 128.0) / 128.0


def or_zeros(a: Column, dim: int) -> Column:
    """Zeros in place of an embedding that failed."""
    return F.coalesce(a, F.array_repeat(F.lit(0.0).cast("float"), dim))
