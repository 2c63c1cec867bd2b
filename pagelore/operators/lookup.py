"""Inner join of a huge table with the few rows that are wanted from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.session import use_checkpoints

# Up to this many wanted rows (narrow ones) are broadcast.
MAX_BROADCAST_ROWS = 200_000

_SLOTS = 1 << 28


def lookup(
    table: DataFrame,
    wanted: DataFrame,
    key: str,
    max_wanted: int | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``table.join(wanted, key)`` that never shuffles the whole ``table``.

    ``wanted`` is narrow and touches few of the table's rows. If it is small (proven by
    ``max_wanted``, or else counted) it is broadcast; if not, the table's other rows
    are filtered out before the join shuffles what is left.
    """
    # One type on both sides, for one hash; a key that does not fit it matches nothing.
    key_type = table.schema[key].dataType
    if wanted.schema[key].dataType != key_type:
        wanted = wanted.withColumn(key, F.col(key).try_cast(key_type))
    if max_wanted is None or max_wanted > max_broadcast_rows:
        # Written once: it is counted, filtered with and joined.
        use_checkpoints(wanted.sparkSession)
        wanted = wanted.checkpoint()
        max_wanted = wanted.count()
    if max_wanted <= max_broadcast_rows:
        return table.join(F.broadcast(wanted), key)
    return _only_wanted(table, wanted, key).join(wanted, key)


def _only_wanted(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Drop most rows whose key is not wanted.

    The wanted keys are hashed into a bitmap of fixed size (at most 32 MB, so it can be
    broadcast whatever their number); rows whose bit is not set go. False positives
    are left to the join.
    """

    def slot() -> Column:
        return F.pmod(F.xxhash64(key), F.lit(_SLOTS))

    bitmap = (
        wanted.select(slot().alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )
    located = table.withColumn("_slot", slot()).withColumns(
        {"_bucket": F.bitmap_bucket_number("_slot"), "_bit": F.bitmap_bit_position("_slot")}
    )
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.bit_get(byte, (F.col("_bit") % 8).cast("int")) == 1
    return located.join(F.broadcast(bitmap), "_bucket").where(is_set).select(table.columns)
