"""Vector columns: norm and cosine similarity of two array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are compared at this many decimals, so that a ranking does not depend
# on how the points happened to be partitioned; ties go to the smaller id.
SCORE_DIGITS = 6


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity for row-wise use; null for zero vectors and unequal lengths."""
    return dot(left, right) / F.nullif(norm(left) * norm(right), F.lit(0.0))
