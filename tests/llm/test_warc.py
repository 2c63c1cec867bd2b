"""Archives round trip, with magic and whole records inside payloads."""

import base64
import hashlib

from pyspark.sql import functions as F

from pagelore.llm import warc
from pagelore.llm.warc import read_archives, sha1_base32, with_revisits, write_archives


def record(body, kind="response"):
    return (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {len(body.encode())}\r\n\r\n"
        f"{body}\r\n\r\n"
    )


INNER = record("HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")
PAGES = [
    (1, "http://a/", "plain"),
    (2, "http://b/ \r\nWARC/1.1", "héllo 字\n\r\n"),
    (3, None, None),
    (4, "u", ""),
    (5, "u", "WARC/1.1\r\n"),
    (6, "u", "before " + INNER + " between " + INNER + INNER),
    (7, "u", INNER),
    (8, "u", "plain"),
    (8, "u", "plain"),
    (9, "u", "WARC/1."),
    (10, "u", "x" * 300_000),
    (11, "u", "WARC/1.0\r\nContent-Length: 999999999999999999999999\r\n\r\n"),
    (None, "u", "no id"),
    (None, "u", "plain"),
    (12, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\n"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages, least_bytes=0):
    latest = {}
    for i, _, html in pages:
        if i is not None:
            latest[html or ""] = max(i, latest.get(html or "", i))
    rows = []
    for i, _, html in pages:
        size = len((html or "").encode())
        to = latest.get(html or "")
        revisit = i is not None and to != i and size >= least_bytes
        rows.append((i, size, digest(html), "revisit" if revisit else "response", to if revisit else None))
    return sorted(rows, key=str)


def round_trip(spark, folder, pages, parts=1, least_bytes=0):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    frame = frame.withColumn("payload", F.lit("clash")).coalesce(parts)
    path = f"{folder}/archives"
    write_archives(with_revisits(frame, "page_id", "url", "html", least_bytes), path, records_per_file=10)
    rows = read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, rows.collect()), key=str)


def test_round_trip(spark, tmp_path):
    assert round_trip(spark, tmp_path, PAGES) == expected(PAGES)


def test_urls_come_back_as_they_were(spark, tmp_path):
    urls = [u for _, u, _ in PAGES] + ["", " ", "http://a/WARC/15x", "a%20b", "a%2fb c", "+ +", "é\u2028\t", "%", "WARC/1.WARC/1. %", "\x00\x7f", "x\r\nContent-Length: 1"]
    pages = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    assert round_trip(spark, tmp_path, pages) == expected(pages)
    rows = read_archives(spark, f"{tmp_path}/archives").collect()
    assert {r.page_id: r.url for r in rows} == dict(enumerate(urls))
    foreign = record("HTTP/1.1 200 OK\r\n\r\nx").replace("\r\nContent", "\r\nWARC-Target-URI: http://a/%20+b\r\nContent", 1)
    (tmp_path / "f.warc").write_bytes(foreign.encode())
    assert read_archives(spark, str(tmp_path / "f.warc")).first().url == "http://a/%20+b"


def test_small_payloads_are_always_responses(spark, tmp_path):
    assert round_trip(spark, tmp_path, PAGES, least_bytes=6) == expected(PAGES, 6)


def test_headers_of_any_length(spark, tmp_path):
    long = [(i, f"http://{i}/" + "a b" * 7000, f"page {i}") if i % 3 == 0 else (i, "u", f"page {i}") for i in range(9)]
    assert round_trip(spark, tmp_path, long) == expected(long)
    rows = read_archives(spark, f"{tmp_path}/archives").collect()
    assert {r.page_id: r.url for r in rows} == {i: u for i, u, _ in long}
    http = f"HTTP/1.1 200 OK\r\nX-Long: {'x' * 20_000}\r\n\r\n"
    (tmp_path / "one.warc").write_bytes((record(http + "one") + record(http + "two")).encode())
    rows = read_archives(spark, str(tmp_path / "one.warc")).collect()
    assert sorted((r.payload_bytes, r.payload_digest) for r in rows) == sorted((3, digest(t)) for t in ("one", "two"))


def test_archives_are_read_once(spark, tmp_path, monkeypatch):
    bodies = [f"HTTP/1.1 200 OK\r\n\r\nWARC/1.1{'y' * i}" for i in range(40)]
    for name in ("one", "two", "three"):
        (tmp_path / f"{name}.warc").write_bytes("".join(map(record, bodies)).encode())
    reached = warc._reached

    def then_split_anew(candidates):  # as when executors join or are lost
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return reached(candidates)

    monkeypatch.setattr(warc, "_reached", then_split_anew)
    try:
        rows = read_archives(spark, str(tmp_path / "*.warc")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.payload_digest for r in rows) == sorted(digest(b.split("\r\n\r\n", 1)[1]) for b in bodies * 3)


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, tmp_path, []) == []


def test_uncompressed_archive_in_small_blocks(spark, tmp_path):
    # A foreign archive, uncompressed, which Spark splits anywhere, within magics too.
    bodies = [f"HTTP/1.1 200 OK\r\n\r\n{'WARC/1.1' * (i % 4)}{INNER * (i % 3)}{'y' * i}" for i in range(60)]
    (tmp_path / "one.warc").write_bytes("".join(map(record, bodies)).encode())
    (tmp_path / "two.warc").write_bytes((record(bodies[0]) + "garbage" + record(bodies[1])).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_archives(spark, str(tmp_path / "*.warc")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [digest(b.split("\r\n\r\n", 1)[1]) for b in [*bodies, bodies[0]]]
    assert sorted(r.payload_digest for r in rows) == sorted(want)


def test_base32(spark):
    frame = spark.createDataFrame([(t,) for t in ("", "a", "ß" * 100)], "t string")
    for text, got in frame.select("t", sha1_base32(F.col("t"))).collect():
        assert got == digest(text)
