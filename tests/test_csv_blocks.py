"""A CSV file read in blocks equals the same file read by one task."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.sources.csv_blocks import ends_inside, read_records
from pagelore.sources.dump import read_dump, write_dump

PIECES = ["word", " ", ",", '"', "\\", "\n", "\r\n", "é漢", '\\"', "\\\n", "\\N", '",\n"', "  "]


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that every kind of record lies across their edges."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield use
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


def texts(rng, n):
    out = [(f"T{i}", "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return out + [("long", "line of a page\n" * 200), ("quotes", '"' * 301), ("none", None), ("empty", "")]


@pytest.mark.parametrize("size", [90, 1000])
def test_equals_one_task(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    frame = spark.createDataFrame(texts(rng, 60), "page_title string, content string").coalesce(1)
    path = str(tmp_path / "dump")
    write_dump(frame, path, "2024-01-01", max_rows_per_file=40)
    want = rows_of(read_dump(spark, path, in_blocks=False))
    small_splits(size)
    found = read_dump(spark, path, in_blocks=True)
    assert rows_of(found) == want and len(want) == 64
    if size == 90:
        assert read_records(spark, f"{path}/date=2024-01-01").rdd.getNumPartitions() > 30


def test_files_of_other_writers(spark, tmp_path, small_splits):
    """Unquoted fields, spaces around quotes, empty lines, missing fields, no line break at the end."""
    text = 'page_title,content\nplain, with space \n\n"q" , "a\nb,\n\nc"\none\nx,"open ""\nmid"dle,"y"\n"u","' + "z\n" * 60 + '"\nlast,"no end\nof it'
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("page_title,content\n")
    (tmp_path / "c.csv").write_text("")
    want = rows_of(read_dump(spark, str(tmp_path), in_blocks=False))
    for size in (20, 1000):
        small_splits(size)
        assert rows_of(read_dump(spark, str(tmp_path), in_blocks=True)) == want


def test_large_files_are_read_in_blocks(spark, tmp_path, monkeypatch):
    from pagelore.sources import dump

    frame = spark.createDataFrame([("A", "one\ntwo"), ("B", "three")], "page_title string, content string")
    write_dump(frame, str(tmp_path / "d"), "2024-01-01")
    want = rows_of(read_dump(spark, str(tmp_path / "d")))
    called = []
    monkeypatch.setattr(dump, "read_records", lambda *a: called.append(a) or read_records(*a))
    monkeypatch.setattr(dump, "LARGE_FILE", 10)
    assert rows_of(read_dump(spark, str(tmp_path / "d"))) == want and len(called) == 1
    assert rows_of(read_dump(spark, str(tmp_path / "d"), all_dates=True)) == want and len(called) == 2


def plain(text, inside):
    """Quote state after each line, character by character."""
    start, i, states = not inside, 0, []
    while i < len(text):
        c = text[i]
        if c == "\n":
            states.append(inside)
            if not inside:
                start = True
        elif inside:
            if c == "\\" and i + 1 < len(text) and text[i + 1] != "\n":
                i += 1
            elif c == '"':
                inside, start = False, False
        elif c == ",":
            start = True
        elif start and c == '"':
            inside = True
        elif not c.isspace():
            start = False
        i += 1
    return states


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", '"', "\\", ",", "\n", " ", '","', '"\n"']), max_size=40), st.booleans())
def test_state_of_each_line(parts, inside):
    text = "".join(parts) + "\n"
    found, state = [], inside
    for line in text[:-1].split("\n"):
        state = ends_inside(line, state)
        found.append(state)
    assert found == plain(text, inside)


def test_large_dump_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """The query's dump is as many files as its input allows, not one that a single task writes."""
    from pagelore.showcase import queries

    rows = [(i, f"text {i}\nmore", "en", "s") for i in range(36)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    documents.repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "scratch_path", lambda _, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = queries.dump_in_blocks(spark, str(tmp_path))
        assert found.count() == found.distinct().count() == 36
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list((tmp_path / "dump" / "date=2024-01-01").glob("*.csv"))) == 3
