"""What the two vector searches share: which vectors take part, and packing them into frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null and whose components are all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vector array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))


def balanced(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component lies in [0.5, 1): cosines stay the same to the
    last bit, and neither squares that underflow nor ones that overflow spoil them."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0.0))[1][:, None])


def as_bytes(m: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(m)]


def from_bytes(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def stacked(vectors) -> np.ndarray:
    """A column of equally long vectors as one float64 matrix."""
    return np.array(list(vectors), dtype=np.float64).reshape(len(vectors), -1)
