"""Column expressions on embedding arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesearch.functions.text import once


def as_float(vector: Column) -> Column:
    return vector.cast("array<float>")


def inner_product(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in array order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def unit(vector: Column) -> Column:
    """L2-normalised float vector, so that inner product equals cosine. Zero stays zero."""

    def scale(v: Column) -> Column:
        return once(
            norm(v),
            lambda length: F.transform(
                v,
                lambda x: F.when(length > 0, x.cast("double") / length)
                .otherwise(F.lit(0.0))
                .cast("float"),
            ),
        )

    return once(vector, scale)


def finite(vector: Column) -> Column:
    """True if every entry is a number; NaN, infinity and NULL are not."""
    bound = F.lit(float("inf"))
    return F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < bound, F.lit(False)))


def checked_dim(vector: Column, dim: int) -> Column:
    """The vector itself; the job fails on a row of another dimension or with a value that is
    not finite. One such value would outrank, or hide, all others."""
    message = F.concat(
        F.lit(f"vector dimension mismatch: expected {dim}, got "), F.size(vector).cast("string")
    )
    guard = F.assert_true(F.coalesce(F.size(vector) == dim, F.lit(False)), message)
    numbers = F.assert_true(
        F.coalesce(finite(vector), F.lit(False)), F.lit("embedding has a value that is not finite")
    )
    return F.when(guard.isNull() & numbers.isNull(), vector)
