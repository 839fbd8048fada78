"""A value that an expression names several times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), where the value is computed once for a row however often fn names it. (Columns are expressions, and a Column that is named twice is
    computed twice unless the optimiser sees it; within higher-order functions it does not.)"""
    return F.transform(F.array(value), fn)[0]
