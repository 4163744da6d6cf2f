"""A value that a row's lambdas share, computed once for all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once a row, however often ``f`` names it, also inside its lambdas.

    A column named in a lambda is put there as its whole expression by the optimizer, and computed for each element.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
