"""WARC archives: written, and read back with a verified chain of record boundaries (operator 4).

Both ways are plain text files to Spark: a record is a text, the archive a file of them.
Reading cuts a file at every occurrence of the magic ``WARC/1.``, wherever it stands. Each
cut is a candidate: the offset of its magic, and, by the header behind it, the offset of
its successor. Only candidates that are reached from the start of the file are records;
a magic within a payload, even one that begins a well-formed record, is not reached, and
its bytes are part of the record that spans it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.llm.common import stored

MAGIC = "WARC/1."
_BREAK = "\r\n"
_EMPTY_LINE = "\r\n\r\n"  # with the end of the line before it

# Base 32: the digits that conv() writes, and the alphabet of the format.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a string or binary column."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _ALPHABET)


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int = 0) -> DataFrame:
    """Rows ``page_id, url, payload, payload_bytes, payload_digest, refers_to``.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
    largest id is the response; the others refer to it. A page without an id, and a
    repeated row of the response, is a response itself. Payloads are aggregated by
    digest before they meet; a payload of very many pages is a skewed join.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    given = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    ).withColumn("payload_digest", sha1_base32(F.col("payload")))
    groups = (
        given.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("payload_digest", "response")
    )
    groups = stored(groups, "payloads")
    refers = F.when(F.col("page_id") < F.col("response"), F.col("response"))
    return given.join(groups, "payload_digest", "left").withColumn("refers_to", refers).drop("response")


def write_archives(pages: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """One record for each row of ``with_revisits``, in compressed archives below ``path``.

    A url that a header cannot hold (one with a control character, a space or a magic, or an
    empty one) is written percent-encoded, and a field of the header says so.
    """
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    is_response = F.col("refers_to").isNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(is_response, F.col("payload")).otherwise(""))
    record = F.concat(
        F.lit(MAGIC + "1\r\nWARC-Type: "),
        F.when(is_response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("page_id")),
        F.when(F.col("url").isNull(), "")
        .when(_needs_quoting(), F.concat(F.lit(f"\r\n{_QUOTED}: percent\r\nWARC-Target-URI: "), _quoted()))
        .otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url"))),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(is_response, "").otherwise(
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.lit("\r\nWARC-Refers-To: "),
                urn(F.col("refers_to")),
            )
        ),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n"),
    )
    pages.select(record.alias("value")).write.option("lineSep", _BREAK).option(
        "maxRecordsPerFile", records_per_file
    ).option("compression", "gzip").text(path)


# A field of the header of a record whose url is percent-encoded.
_QUOTED = "X-Target-URI-Encoding"


def _needs_quoting() -> Column:
    return (F.col("url") == "") | F.col("url").rlike(r"[\x00-\x20\x7f]") | F.col("url").contains(MAGIC)


def _quoted() -> Column:
    """The url with percent signs, control characters, spaces and the slash of a magic by their numbers."""
    quoted = F.replace("url", F.lit("%"), F.lit("%25"))
    for code in (*range(0x21), 0x7F):
        quoted = F.replace(quoted, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.replace(quoted, F.lit(MAGIC), F.lit(MAGIC.replace("/", "%2F")))


def _unquoted(url: Column) -> Column:
    return F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``page_id, record_type, url, payload_bytes, payload_digest, refers_to`` of all records below ``path``.

    Urls come back as they were, those of other writers as they stand in their header.
    ``payload_bytes`` is that of the whole payload (a revisit's HTTP header states it);
    ``payload_digest`` is computed from a response's payload and a revisit's own word.
    A file whose chain breaks off gives the records up to the break; of a record that the
    file's end cuts short the digest is null. A magic within a header hides that header.
    """
    # Read once: a second read could number the cuts in another way.
    cuts = stored(_measured(_cuts(spark, path)), "cuts")
    candidates = stored(_offsets(cuts.drop("value")), "candidates")
    owned = stored(_owned(candidates, _reached(candidates)), "owned")
    records = owned.where(F.col("owner") == F.col("offset")).select("file", "owner", *_FIELDS, "payload_digest")
    # Records that a magic within their payload cuts in two or more: their parts are put together.
    torn = owned.groupBy("file", "owner").count().where(F.col("count") > 1).select("file", "owner")
    torn = stored(owned.join(torn, ["file", "owner"], "left_semi"), "torn")
    if torn.isEmpty():
        return records.select(*_FIELDS, "payload_digest")
    parts = torn.select("file", "block", "seq", "owner", "offset").join(cuts.select("file", "block", "seq", "value"), ["file", "block", "seq"])
    whole = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
    mended = (
        torn.where(F.col("owner") == F.col("offset"))
        .join(whole.select("file", "owner", joined.alias("value")), ["file", "owner"])
        .select("file", "owner", _digest().alias("mended"))
    )
    return records.join(mended, ["file", "owner"], "left").select(
        *_FIELDS, F.coalesce("mended", "payload_digest").alias("payload_digest")
    )


_FIELDS = ("page_id", "record_type", "url", "payload_bytes", "refers_to")


def _digest() -> Column:
    """Digest of the record whose bytes behind its magic are ``value``; null if they are not all there."""
    whole = F.octet_length("value") + len(MAGIC) >= F.col("record_bytes")
    payload = F.expr("substring(cast(value as binary), head + 1, cast(block_bytes - http_bytes as int))")
    return F.when(whole, F.coalesce("said_digest", sha1_base32(payload)))


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, in order within each block of each file."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            "value",
        )
    )


def _measured(cuts: DataFrame) -> DataFrame:
    """Each cut with its length, its header's fields, and its payload's digest if it holds all of it; its value stays."""
    # A header ends at the first empty line, however far that is; its fields begin their lines.
    end = F.when(F.substring("value", 1, 3).rlike(r"\A[0-9]\r\n"), F.locate(_EMPTY_LINE, F.col("value"))).otherwise(0)
    warc = F.when(F.col("end") > 0, F.substring(F.col("value"), F.lit(1), F.col("end") + 1)).otherwise("")
    cut = cuts.withColumn("length", F.octet_length("value").cast("long")).withColumn("end", end).withColumn("warc", warc)
    line = lambda name: F.regexp_extract("warc", rf"(?i)\n{name}:[ \t]*+([^\r\n]*+)\r", 1)
    field = lambda name: F.rtrim(line(name), F.lit(" \t"))
    filled = lambda c: F.when(c != "", c)
    page = lambda name: filled(F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1)).cast("long")
    # The HTTP header stands behind the empty line and ends at its own.
    start = F.length("warc") + 3
    http_end = F.when(F.substring(F.col("value"), start, F.lit(5)) == "HTTP/", F.call_function("locate", F.lit(_EMPTY_LINE), F.col("value"), start))
    cut = cut.withColumn("start", start).withColumn("http_end", F.coalesce(http_end, F.lit(0)))
    http = F.substring(F.col("value"), F.col("start"), F.col("http_end") + len(_EMPTY_LINE) - F.col("start"))
    cut = cut.select(
        "file",
        "block",
        "seq",
        "length",
        "value",
        F.octet_length("warc").alias("warc_bytes"),
        filled(field("Content-Length")).try_cast("long").alias("block_bytes"),
        filled(field("WARC-Type")).alias("record_type"),
        page("WARC-Record-ID").alias("page_id"),
        page("WARC-Refers-To").alias("refers_to"),
        F.when(field(_QUOTED) == "percent", _unquoted(field("WARC-Target-URI")))
        .otherwise(filled(field("WARC-Target-URI")))
        .alias("url"),
        filled(F.regexp_extract(field("WARC-Payload-Digest"), "sha1:([A-Z2-7]{32})", 1)).alias("header_digest"),
        F.when(F.col("http_end") > 0, http).otherwise("").alias("http"),
    )
    said = F.regexp_extract("http", r"(?i)\nContent-Length:[ \t]*(\d+)[ \t]*\r", 1)
    cut = cut.withColumns(
        {
            "http_bytes": F.octet_length("http"),
            "payload_bytes": filled(said).try_cast("long"),
            "said_digest": F.when(F.col("record_type") == "revisit", F.col("header_digest")),
            # Of the magic, the header, its empty line, the block and the two line breaks behind it.
            "record_bytes": len(MAGIC) + F.col("warc_bytes") + 2 + F.col("block_bytes") + 4,
            "head": F.col("warc_bytes") + 2 + F.octet_length("http"),
        }
    )
    cut = cut.withColumn(
        "payload_bytes",
        F.when(F.col("record_type") == "revisit", F.coalesce("payload_bytes", F.lit(0))).otherwise(
            F.col("block_bytes") - F.col("http_bytes")
        ),
    )
    return cut.withColumn("payload_digest", _digest()).drop("http", "header_digest")


def _offsets(cuts: DataFrame) -> DataFrame:
    """Candidates with the ``offset`` of their magic and of their successor (``next``).

    Lengths are added up within each block, and the blocks of a file are added up:
    neither is more than a block's or a file's worth of numbers.
    """
    m = len(MAGIC)
    in_block = Window.partitionBy("file", "block").orderBy("seq")
    before = F.sum(F.col("length") + m).over(in_block) - F.col("length") - m
    placed = cuts.withColumn("before", before)
    blocks = cuts.groupBy("file", "block").agg(F.sum(F.col("length") + m).alias("bytes"))
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("base", F.sum("bytes").over(in_file) - F.col("bytes")).drop("bytes")
    # What precedes the first magic is no candidate; a magic stands just before its cut.
    offset = F.col("base") + F.col("before") - m
    return (
        placed.join(blocks, ["file", "block"])
        .withColumn("offset", offset)
        .withColumn("next", F.col("offset") + F.col("record_bytes"))
    )


def _reached(cuts: DataFrame) -> DataFrame:
    """``file, offset`` of the candidates that the chain from offset 0 of their file reaches.

    Within a block, candidates whose successor is the very next one form a run: whoever
    enters it passes through to its end (a block without a magic in payloads is one run).
    So a run has one successor, the run that its last candidate points into. Over the
    runs of a file pointers are jumped, twice as far each time, until nothing more is
    reached from the run at offset 0.
    """
    candidates = cuts.where(F.col("offset") >= 0).select("file", "block", "offset", "next")
    in_block = Window.partitionBy("file", "block").orderBy("offset")
    begins = F.coalesce(F.lag("next").over(in_block) != F.col("offset"), F.lit(True))
    run = F.max(F.when(F.col("begins"), F.col("offset"))).over(in_block)
    runs = stored(candidates.withColumn("begins", begins).withColumn("run", run).drop("begins"), "runs")
    ends = runs.groupBy("file", "run").agg(F.max_by("next", "offset").alias("entry"))
    target = runs.select("file", F.col("offset").alias("entry"), F.col("run").alias("to"))
    pointers = stored(ends.join(target, ["file", "entry"]), "pointers")
    far = pointers.select("file", "run", "to")
    marked = stored(runs.where(F.col("offset") == 0).select("file", "run"), "marked")
    n_marked = marked.count()
    while not far.isEmpty():
        ahead = marked.join(far, ["file", "run"]).select("file", F.col("to").alias("run"))
        marked = stored(marked.union(ahead).distinct(), "marked")
        before, n_marked = n_marked, marked.count()
        if n_marked == before:
            break
        further = far.select("file", F.col("run").alias("to"), F.col("to").alias("further"))
        far = stored(far.join(further, ["file", "to"]).select("file", "run", F.col("further").alias("to")), "pointers")
    entered = marked.join(pointers, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
    first = marked.where(F.col("run") == 0).withColumn("entry", F.lit(0).cast("long"))
    return (
        runs.join(first.unionByName(entered), ["file", "run"])
        .where(F.col("offset") >= F.col("entry"))
        .select("file", "offset")
    )


def _owned(cuts: DataFrame, reached: DataFrame) -> DataFrame:
    """Each cut with the offset of the record it is part of (``owner``)."""
    marked = cuts.where(F.col("offset") >= 0).join(reached.withColumn("owner", F.col("offset")), ["file", "offset"], "left")
    in_file = Window.partitionBy("file").orderBy("offset")
    owned = marked.withColumn("owner", F.last("owner", ignorenulls=True).over(in_file))
    # Behind a break of the chain nothing belongs to the last record but what it spans.
    spans = F.max(F.when(F.col("owner") == F.col("offset"), F.col("next"))).over(in_file)
    return owned.withColumn("spans", spans).where(F.col("offset") < F.col("spans")).drop("spans")
