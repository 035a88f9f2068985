"""Names for intermediate values inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a Column that is used twice would be written out, and planned, twice."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
