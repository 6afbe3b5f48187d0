"""Vector maths as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit_vector(col: Column) -> Column:
    """``col`` divided by its L2 norm; null for a zero, null or non-finite vector."""
    squares = F.aggregate(col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # The one-element array binds the norm, so it is computed once per row
    # and not once per component.
    scaled = F.transform(
        F.array(F.sqrt(squares)),
        lambda n: F.when(
            (n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(col, lambda x: x.cast("double") / n)
        ),
    )
    return scaled[0]


def quantize(unit: Column) -> Column:
    """8-bit form of a unit vector."""
    return F.transform(unit, lambda x: F.round(x * 127).cast("tinyint"))


def neighbour_score(similarity: Column) -> Column:
    """Map a dot product of unit vectors from [-1, 1] to [0, 1]."""
    return F.round((1 + similarity) / 2, 6)
