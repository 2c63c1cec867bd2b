"""Records of CSV files with line breaks inside their fields, read in parallel.

Whether a line break ends a record depends on all quotes before it, so Spark reads such a
file in one task. Here each split of a file is scanned as if it began outside a field and as
if it began inside a quoted one. The two outcomes of every split are chained over the file,
which tells how each really begins, and a second scan then cuts its records. What of a record
lies in several splits is kept by the first scan and put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.session import scratch_path

# To the end of a quoted field, whose start is behind: a backslash takes the next character with it.
_CLOSE = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_START = re.compile(r"[ \t\r\f\v]*")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, which began inside one or at a record's start."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            at = _START.match(line, at).end()
            if at < len(line) and line[at] == '"':
                inside, at = True, at + 1
        if inside:
            closed = _CLOSE.match(line, at)
            if closed is None:
                return True
            inside, at = False, closed.end()
        # Whatever follows a closed quote, or stands in an unquoted field, ends at the separator.
        at = line.find(",", at) + 1
        if not at:
            return False


class _Cutter:
    """Records of the lines of one split, for one way it may begin."""

    def __init__(self, inside: bool):
        self.begins = self.inside = inside
        # What is open at the start belongs to an earlier split: it is the head.
        self.in_head = inside
        self.head: list[str] = []
        self.open: list[str] = []

    def add(self, line: str) -> str | None:
        """The record that ends with this line, if one does that began in this split."""
        self.inside = ends_inside(line, self.inside)
        if self.in_head:
            self.head.append(line)
            self.in_head = self.inside
            return None
        if self.inside:
            self.open.append(line)
            return None
        if not self.open:
            return line
        self.open.append(line)
        record, self.open = "\n".join(self.open), []
        return record


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``record``, the text of each record of the CSV files at ``path``, without those of headers.

    Fields are quoted by ``"`` and escaped by a backslash; lines end with a line feed. A file
    that ends inside a quoted field ends its last record. Empty lines go. The files are read
    twice. The driver learns one place for each split that begins inside a field.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )
    scanned = scratch_path(spark, "blocks")
    lines.mapInArrow(_scan, _SCANNED).write.parquet(scanned)
    blocks = _begun(spark.read.schema(_SCANNED).parquet(scanned))
    inside = {(r["file"], r["block"]) for r in blocks.where("begins").select("file", "block").collect()}
    shared = spark.sparkContext.broadcast(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cutter, first = None, None, False
        for batch in batches:
            records = []
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (file, block):
                    place = (file, block)
                    cutter, first = _Cutter(place in shared.value), header and block == 0
                record = cutter.add(value)
                if record is None:
                    continue
                if not first and record.strip():
                    records.append(record)
                first = first and not record.strip()
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["record"])

    return lines.mapInArrow(cut, "record string").union(_across(blocks, header))


_SCANNED = (
    "file string, block long, end_outside boolean, end_inside boolean, "
    "tail_outside string, head_inside string, tail_inside string"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of ``_SCANNED`` for each split: how it ends, and what it holds of records that lie in others too."""
    place, ways = None, ()
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("end_outside", pa.bool_()), ("end_inside", pa.bool_())]
        + [(c, pa.string()) for c in ("tail_outside", "head_inside", "tail_inside")]
    )

    def told() -> pa.RecordBatch:
        outside, inside = ways
        tails = ["\n".join(w.open) if w.open else None for w in ways]
        row = (*place, outside.inside, inside.inside, tails[0], "\n".join(inside.head), tails[1])
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != (file, block):
                if place is not None:
                    yield told()
                place, ways = (file, block), (_Cutter(False), _Cutter(True))
            for way in ways:
                way.add(value)
    if place is not None:
        yield told()


def _begun(scanned: DataFrame) -> DataFrame:
    """The splits with ``begins``: whether each begins inside a quoted field.

    A split either ends alike however it begins, or keeps or turns what it begins with. So it
    begins as the last one of the first kind before it ended, turned as often as since then.
    """
    fixed = F.col("end_outside") == F.col("end_inside")
    turns = F.when(~fixed & F.col("end_outside"), 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = scanned.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    sure = F.when(fixed, F.struct("end_outside", F.col("turned").alias("turned")))
    last = F.last(sure, ignorenulls=True).over(before)
    since = F.col("turned") - F.coalesce(last["turned"], F.lit(0))
    return counted.withColumn("begins", F.coalesce(last["end_outside"], F.lit(False)) != (since % 2 == 1)).drop("turned")


def _across(blocks: DataFrame, header: bool) -> DataFrame:
    """``record`` of those that lie in several splits, or end with their file."""
    head = F.when(F.col("begins"), F.struct(F.lit(False).alias("opens"), F.col("head_inside").alias("part")))
    tail = F.when(F.col("begins"), F.col("tail_inside")).otherwise(F.col("tail_outside"))
    tail = F.when(tail.isNotNull(), F.struct(F.lit(True).alias("opens"), tail.alias("part")))
    parts = blocks.select("file", "block", F.explode(F.array_compact(F.array(head, tail))).alias("p")).select(
        "file", "block", "p.opens", "p.part"
    )
    so_far = Window.partitionBy("file").orderBy("block", "opens").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("record_no", F.sum(F.col("opens").cast("int")).over(so_far))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "opens", "part"))), _part), "\n")
    joined = numbered.groupBy("file", "record_no").agg(whole.alias("record"), F.min(F.struct("block", "opens")).alias("at"))
    if header:
        # A header that is itself cut would be the first thing in its file; it holds no line break.
        joined = joined.where(~((F.col("at.block") == 0) & ~F.col("at.opens")))
    return joined.select("record")


def _part(piece: Column) -> Column:
    return piece["part"]
