"""Row-level helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(*columns: Column) -> Column:
    """Costly named columns as a one-row generator, for use in ``select``.

    The optimizer moves a later filter on a projected column below the projection
    and computes the column a second time there; it cannot move it below a generator.
    """
    return F.inline_outer(F.array(F.struct(*columns)))
