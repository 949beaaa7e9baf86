"""Arrays to rows, and expressions evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, array: Column | str, pos: str, value: str, *keep) -> DataFrame:
    """One row per array element: (keep…, pos, value).

    The optimizer guards an inner explode with a filter on the array's size and pushes that
    filter, with the whole expression behind the array, below every projection and join; the
    array would be computed three times.  The outer form has no such filter.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
