import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelore.operators.embed import HashedWords
from pagelore.operators.retrieve import top_k
from pagelore.plans.dataset import build_points
from pagelore.sources.points import bucket_of, buckets_of, read_points, rebuild, snapshots

POINT = "page_id int, chunk_no int, title string, content string, tokens int, embedding array<float>"


def points(spark, title="A", width=2):
    rows = [(i, 0, f"{title}{i}", "text", 1, [float(i)] * width) for i in range(1, 4)]
    return spark.createDataFrame(rows, POINT)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "points")
    assert snapshots(spark, path).count() == 0
    with pytest.raises(LookupError):
        read_points(spark, path)
    assert rebuild(points(spark), path, 2) == 1
    old = read_points(spark, path)
    assert rebuild(points(spark, "B"), path, 2) == 2
    assert {r.title for r in read_points(spark, path).collect()} == {"B1", "B2", "B3"}
    assert {r.title for r in read_points(spark, path, 1).collect()} == {"A1", "A2", "A3"}
    # A reader that started before the rebuild goes on with what it saw.
    assert {r.title for r in old.collect()} == {"A1", "A2", "A3"}
    assert [r.version for r in snapshots(spark, path).orderBy("version").collect()] == [1, 2]
    assert read_points(spark, path, vectors=False).columns == ["id", "title", "content", "tokens"]
    with pytest.raises(LookupError):
        read_points(spark, path, 7)


def test_failed_rebuild_leaves_the_table_alone(spark, tmp_path):
    path = str(tmp_path / "points")
    rebuild(points(spark), path, 2)
    with pytest.raises(Exception, match="expected 2 values, found 3"):
        rebuild(points(spark, "B", 3), path, 2)
    with pytest.raises(Exception, match="expected 2 values, found -1"):
        rebuild(points(spark).withColumn("embedding", F.lit(None).cast("array<float>")), path, 2)
    assert {r.title for r in read_points(spark, path).collect()} == {"A1", "A2", "A3"}
    assert rebuild(points(spark, "C"), path, 2) == 2


def test_ids(spark, tmp_path):
    path = str(tmp_path / "points")
    seen = []
    for random_ids in (False, False, True):
        rebuild(points(spark), path, 2, random_ids=random_ids)
        seen.append({r.id for r in read_points(spark, path).collect()})
    assert seen[0] == seen[1] != seen[2]
    assert all(len(ids) == 3 and all(len(i) == 36 for i in ids) for ids in seen)


def test_build_and_dry_run(spark, tmp_path):
    path = str(tmp_path / "points")
    pages = spark.createDataFrame([("A_b", "[[x|one]] two  three"), ("C", "<!-- -->")], "title string, content string")
    planned = build_points(pages, path, HashedWords(4), 4, max_tokens=2, dry_run=True)
    assert snapshots(spark, path).count() == 0
    assert build_points(pages, path, HashedWords(4), 4, max_tokens=2) == 1
    got = read_points(spark, path).select("title", "content", "tokens").orderBy("title").collect()
    assert [tuple(r) for r in got] == [("A b (1)", "one two", 2), ("A b (2)", " three", 1)]
    assert planned.count() == 2


def test_two_rebuilds_at_once_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    from pagelore.sources import points as module

    path = str(tmp_path / "points")
    nothing = spark.createDataFrame([], module._COMMITS)
    with monkeypatch.context() as m:
        m.setattr(module, "snapshots", lambda *_: nothing)  # neither sees the other
        assert [rebuild(points(spark, name), path, 2) for name in "ABC"] == [1, 2, 3]
    for version, name in enumerate("ABC", 1):
        assert {r.title for r in read_points(spark, path, version).collect()} == {f"{name}{i}" for i in (1, 2, 3)}
    place = snapshots(spark, path).where("version = 2").first().location
    assert {r.title[0] for r in read_points(spark, path, location=place).collect()} == {"B"}


def test_numbers_are_taken_by_one_of_many(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from pagelore.session import create_exclusively

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: create_exclusively(spark, str(tmp_path / f"v/{i % 4}")), range(32)))
    assert sum(got) == 4


def test_a_number_is_taken_once_however_close_the_callers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from pagelore.session import create_exclusively

    (tmp_path / "v").mkdir()
    together = Barrier(8)

    def take(n):
        together.wait()
        return create_exclusively(spark, str(tmp_path / f"v/{n}"))

    with ThreadPoolExecutor(8) as pool:
        for n in range(60):
            assert sum(pool.map(take, [n] * 8)) == 1


def test_repeated_pages_are_points_of_their_own(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [(1, 0, "A", "text", 1, [1.0, 0.0])] * 3 + [(1, 0, "B", "other", 1, [0.0, 1.0]), (2, 0, "C", "c", 1, [1.0, 1.0])]
    rebuild(spark.createDataFrame(rows, POINT), path, 2, buckets=8)
    found = read_points(spark, path)
    got = found.collect()
    assert len({r.id for r in got}) == 5 and all(len(r.id) == 36 for r in got)
    # The first is named as if it were alone, so ids stay when a copy goes.
    alone = str(tmp_path / "alone")
    rebuild(spark.createDataFrame([rows[0], rows[4]], POINT), alone, 2, buckets=3)
    assert {r.id for r in read_points(spark, alone).collect()} < {r.id for r in got}
    hits = top_k(found, [1.0, 0.0], 3).collect()
    assert [(r["rank"], r.title, r.content) for r in hits] == [(i, "A", "text") for i in (1, 2, 3)]
    assert [r.title for r in top_k(found, [1.0, 0.0], 9).collect()] == ["A", "A", "A", "C", "B"]


def test_norms_are_stored(spark, tmp_path):
    path = str(tmp_path / "points")
    rebuild(points(spark), path, 2)
    got = {r.title: r.norm for r in read_points(spark, path).collect()}
    assert got == {f"A{i}": pytest.approx(i * 2**0.5) for i in (1, 2, 3)}
    # A scan takes them as they are.
    wrong = read_points(spark, path).withColumn("norm", F.when(F.col("title") == "A2", 1.0).otherwise(F.col("norm")))
    assert [r.title for r in top_k(wrong, [1.0, 1.0], 1).collect()] == ["A2"]


def test_only_buckets_of_hits_are_read(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [(i, 0, f"T{i}", f"text {i}", 1, [float(i % 7), float(i)]) for i in range(200)]
    rebuild(spark.createDataFrame(rows, POINT), path, 2, buckets=16)
    found = read_points(spark, path)
    assert buckets_of(found) == buckets_of(found.where("tokens = 1")) == 16
    assert found.where(F.col("bucket") != bucket_of(F.col("id"), 16)).count() == 0
    assert found.select("bucket").distinct().count() == 16
    hits = top_k(found, [1.0, 0.0], 2)
    wanted = {r.bucket for r in hits.select(bucket_of(F.col("id"), 16).alias("bucket")).collect()}
    plan = hits._jdf.queryExecution().optimizedPlan().toString() + hits._jdf.queryExecution().sparkPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert pruned and set(map(int, re.findall(r"\b\d+\b(?!#)", re.sub(r"#\d+", "", pruned[-1])))) == wanted
    # Only those: the others can be gone.
    place = snapshots(spark, path).first().location
    for bucket in set(range(16)) - wanted:
        for file in Path(place, f"bucket={bucket}").glob("*"):
            file.write_bytes(b"") if file.suffix == ".parquet" else None
    assert {(r.title, r.content) for r in hits.collect()} == {(r.title, f"text {r.title[1:]}") for r in hits.collect()}
    assert len(hits.collect()) == 2


def test_every_task_writes_as_many_buckets(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [(i, 0, f"A{i}", "text", 1, [float(i), 1.0]) for i in range(400)]
    rebuild(spark.createDataFrame(rows, POINT), path, 2, buckets=8)
    # The number of the task is in the name of a file.
    files = [(f.parent.name, f.name.split("-")[1]) for f in Path(path).glob("data/*/bucket=*/*.parquet")]
    buckets = {task: [b for b, t in files if t == task] for _, task in files}
    assert sorted(map(len, buckets.values())) == [2, 2, 2, 2]
    assert read_points(spark, path).where(bucket_of(F.col("id"), 8) != F.col("bucket")).count() == 0
