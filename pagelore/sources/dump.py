"""Page dumps as dated CSV directories."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.rows import computed_once
from pagelore.session import names_below, spread
from pagelore.sources.csv_blocks import read_records

# The dump dialect. Null is written as a backslash and N.
_DIALECT = {
    "header": True,
    "sep": ",",
    "quote": '"',
    "escape": "\\",
    "encoding": "UTF-8",
    "nullValue": "\\N",
}
_SCHEMA = "page_title string, content string"
_READING = {
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "mode": "PERMISSIVE",
    "maxCharsPerColumn": "-1",
}

# A file of more bytes is read in blocks.
LARGE_FILE = 256 << 20


def write_dump(
    pages: DataFrame, path: str, date: str, max_rows_per_file: int = 100_000, compression: str = "none"
) -> None:
    """Write ``page_title, content`` below ``path/date=...`` as many files.

    A CSV file with line breaks inside its fields is read by one task, so the
    rows per file are bounded. Such files lose nothing by ``compression`` (``gzip``, say), but
    large ones are only read in blocks without. A second run for a date replaces that date only.
    """
    (
        pages.select("page_title", "content")
        .write.mode("overwrite")
        .options(**_DIALECT)
        .option("quoteAll", True)
        .option("compression", compression)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", max_rows_per_file)
        .csv(f"{path.rstrip('/')}/date={date}")
    )


def read_dump(
    spark: SparkSession, path: str, date: str | None = None, all_dates: bool = False, in_blocks: bool | None = None
) -> DataFrame:
    """``page_id, title, content`` of a dump file or directory.

    Of a directory of dated dumps (``date=2024-01-31``) the newest is read, or that of ``date``; with
    ``all_dates`` every page comes once for each date. Page ids are the hash of title
    and content, so they do not depend on how files are read. Bad lines and missing fields are tolerated and become nulls. A backslash
    before a line break is the dump's escape for it and goes.

    A file is read by one task, so few files are dealt out after, unless one is larger than
    ``LARGE_FILE`` or ``in_blocks`` says so: then each is read by a task for each split, twice
    (see ``csv_blocks``), with the same result.
    """
    if not all_dates:
        path = _dated(spark, path, date)
    if in_blocks is None:
        in_blocks = _largest(spark, path) > LARGE_FILE
    if in_blocks:
        one = {k: str(v) for k, v in _DIALECT.items() if k != "header"} | _READING
        parsed = read_records(spark, path).select(computed_once(F.from_csv("record", _SCHEMA, one).alias("page")))
        rows = parsed.select("page.page_title", "page.content")
    else:
        rows = spark.read.schema(_SCHEMA).options(**_DIALECT).options(**_READING).option("multiLine", True).csv(path)
    content = F.replace("content", F.lit("\\\n"), F.lit("\n"))
    title = F.replace("page_title", F.lit("\\\n"), F.lit("\n"))
    found = rows.select(
        F.xxhash64(title, content).alias("page_id"), title.alias("title"), content.alias("content")
    )
    return found if in_blocks else spread(found)


def _largest(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file at ``path``, in it, or in its folders."""
    parent, name = posixpath.split(path.rstrip("/"))
    places = ((parent or ".", name), (path, "*"), (path, "*/*"))
    return max((n for folder, pattern in places for _, n in names_below(spark, folder, pattern)), default=0)


def _dated(spark: SparkSession, path: str, date: str | None) -> str:
    """The directory of one date below ``path``; ``path`` itself if it holds none."""
    found = [name for name, _ in names_below(spark, path, f"date={date or '*'}")]
    if date and not found:
        raise ValueError(f"no dump of {date} below {path}")
    return f"{path.rstrip('/')}/{found[-1]}" if found else path
