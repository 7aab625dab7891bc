"""Vector expressions over array columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where the sizes differ or a norm is below 1e-8."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (norm(a) < 1e-8) | (norm(b) < 1e-8), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / n)))


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``: lambdas would otherwise compute a column expression again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
