"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .coerce import _col


def l2_distance(a, b) -> Column:
    """Euclidean distance of two equally long arrays, summed in double."""
    squares = F.zip_with(
        _col(a), _col(b),
        lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def vector_literal(values) -> Column:
    """A query vector as a constant of the plan."""
    return F.array(*[F.lit(float(v)) for v in values])
