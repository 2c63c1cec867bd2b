import pytest
from pagelore.sources.dump import read_dump, write_dump
from pagelore.sources.wiki import current_text


def test_current_text(spark):
    page = [
        ("Main", 10, 0, 0), ("Project", 20, 4, 0), ("Talk", 30, 1, 0), ("Redirect", 40, 0, 1),
        ("No_slot", 99, 0, 0), ("Elsewhere", 50, 0, 0), ("Odd", 60, 0, 0), ("Same", 70, 0, 0),
    ]
    slots = [(r, role, r * 10 + role) for r in (10, 20, 30, 40, 50, 60, 70) for role in (1, 2)]
    content = [(r * 10 + 1, f"tt:{r}") for r in (10, 20, 30, 40)] + [(r * 10 + 2, "tt:1") for r in (10, 20)]
    content += [(501, "es:50"), (601, "tt:x"), (701, "tt:10")]
    text = [(r, f"text {r}") for r in (1, 10, 20, 30, 40, 50, 60)]
    tables = (
        spark.createDataFrame(page, "page_title string, page_latest bigint, page_namespace int, page_is_redirect int"),
        spark.createDataFrame(slots, "slot_revision_id bigint, slot_role_id int, slot_content_id bigint"),
        spark.createDataFrame([(1, "main"), (2, "aux")], "role_id int, role_name string"),
        spark.createDataFrame(content, "content_id bigint, content_address string"),
        spark.createDataFrame(text, "old_id bigint, old_text string"),
    )
    # Broadcast of the wanted rows, and the bitmap with a join.
    for limit in (100, 0):
        got = current_text(*tables, max_broadcast_rows=limit)
        assert sorted(map(tuple, got.collect())) == [("Main", "text 10"), ("Project", "text 20"), ("Same", "text 10")]


ROWS = [
    ("plain", "text"),
    ("quote", 'say "hi", he said'),
    ("lines", "one\ntwo\r\nthree\n"),
    ("backslash", "C:\\dir\\ end\\"),
    ("spaces", "  kept  "),
    ("null", None),
    ("unicode", "ä\u3000\U0001f600"),
]


def test_dump_round_trip(spark, tmp_path):
    path = str(tmp_path / "dump")
    frame = spark.createDataFrame(ROWS, "page_title string, content string")
    write_dump(frame, path, "2024-01-01", max_rows_per_file=2)
    write_dump(frame.limit(1), path, "2024-01-02")
    assert {(r.title, r.content) for r in read_dump(spark, f"{path}/date=2024-01-01").collect()} == set(ROWS)
    assert read_dump(spark, path).count() == 1  # the newest
    both = read_dump(spark, path, all_dates=True)
    assert both.count() == len(ROWS) + 1 and both.select("page_id").distinct().count() == len(ROWS)
    write_dump(frame.limit(2), path, "2024-01-01")
    assert read_dump(spark, path, date="2024-01-01").count() == 2
    assert read_dump(spark, path, all_dates=True).count() == 3
    with pytest.raises(ValueError, match="2023"):
        read_dump(spark, path, date="2023-01-01")


def test_foreign_dump(spark, tmp_path):
    """As a database writes it: escaped quotes and line ends, bare nulls, stray blanks."""
    file = tmp_path / "dump.csv"
    file.write_text(
        "page_title,content\n"
        '"A","line one\\\nline two"\n'
        '"B","say \\"hi\\""\n'
        '"C",\\N\n'
        "D , bare text \n"
        "E\n"
        '"F","a","too many"\n'
    )
    got = {r.title: r.content for r in read_dump(spark, str(file)).collect()}
    assert got == {
        "A": "line one\nline two", "B": 'say "hi"', "C": None, "D": "bare text", "E": None, "F": "a"
    }
