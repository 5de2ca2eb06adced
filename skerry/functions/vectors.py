"""Products, norms and cosines of arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.text import _c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """``v`` scaled to length 1; a zero vector stays as it is."""
    # As the only element of an array the norm is taken once, not for each number.
    n = F.array(F.nullif(norm(v), F.lit(0.0)))
    scaled = F.transform(n, lambda m: F.transform(_c(v), lambda x: x.cast("double") / F.coalesce(m, F.lit(1.0))))
    return F.when(_c(v).isNotNull(), F.get(scaled, F.lit(0)))
