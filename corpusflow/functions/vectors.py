"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import _col

NORM_FLOOR = 1e-12


def norm(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(c: Column | str) -> Column:
    """NUM-3: unit vector; the norm is floored so a zero vector stays zero."""
    n = F.greatest(norm(c), F.lit(NORM_FLOOR))
    return F.transform(_col(c), lambda x: x.cast("double") / n)


def dot(a: Column | str, b: Column | str) -> Column:
    prod = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """NUM-4 for a pair in one row; many-to-many search belongs to operators.knn."""
    lengths = F.greatest(norm(a) * norm(b), F.lit(NORM_FLOOR))
    return F.lit(1.0) - dot(a, b) / lengths


def similarity(distance: Column | str) -> Column:
    """REL-18: 1 - distance, a missing distance counts as 1."""
    return F.lit(1.0) - F.coalesce(_col(distance), F.lit(1.0))
