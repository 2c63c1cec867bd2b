"""Every registered query against its SQL counterpart, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from pagelore.showcase.oracles import ORACLES
from pagelore.showcase.queries import QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_its_counterpart():
    assert QUERIES.keys() == ORACLES.keys()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", driver.oracle_sql())
def test_query(spark, database, name):
    frame = driver.queries()[name](spark, str(SF))
    result = database.execute(driver.oracle_sql()[name])
    want = normal([d[0] for d in result.description], result.fetchall())
    assert normal(frame.columns, frame.collect()) == want
    # At this scale every document has a stored vector.
    assert want[1] or name == "batch_missing"


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["question_id", "context"]
    assert frame.count() == 40


def test_contents_of_two_dates_move_once(spark):
    """Of the points only digests and ids are dealt out whole, and the dumps are compressed."""
    import re

    from pagelore.showcase import queries

    frame = queries.build_dataset_dates(spark, str(SF))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not any("content#" in k for k in keys)


def test_compressed_dump(spark, tmp_path):
    from pagelore.sources.dump import read_dump, write_dump

    rows = [("A", 'one\n"two", three\\'), ("B", None), ("C", "x" * 50_000)]
    pages = spark.createDataFrame(rows, "page_title string, content string")
    write_dump(pages, str(tmp_path), "2024-01-01", compression="gzip")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.csv.gz")) < 10_000
    for in_blocks in (False, True):
        got = read_dump(spark, str(tmp_path), in_blocks=in_blocks)
        assert {(r.title, r.content) for r in got.collect()} == set(rows)
