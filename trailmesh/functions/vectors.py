"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column | str) -> Column:
    """Unit vector; raises for a norm below 1e-12."""
    a = F.col(a) if isinstance(a, str) else a
    n = norm(a)
    return F.when(n < 1e-12, F.raise_error(F.lit("zero vector"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))
