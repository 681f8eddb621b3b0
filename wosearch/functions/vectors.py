"""Arithmetic on array<float> columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )


def norm(v) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def normalised(v) -> Column:
    """Unit vector in double precision; a zero vector stays zero."""
    length = norm(v)
    return F.transform(
        v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0))
    )


def checked_dim(v, dim: int) -> Column:
    """The vector itself; the job fails when its size is not ``dim``."""
    actual = F.coalesce(F.size(v).cast("string"), F.lit("null"))
    return F.when(F.size(v) == dim, v).otherwise(
        F.raise_error(F.concat(F.lit(f"vector size is not {dim}: "), actual))
    )


def is_finite(x) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def is_valid(v, dim: int) -> Column:
    """Right size, no null, NaN or infinite element."""
    return F.coalesce(
        (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(is_finite(x), F.lit(False))),
        F.lit(False),
    )
