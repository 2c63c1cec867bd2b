import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.functions.tokens import CallableTokenizer, SpaceTokenizer
from pagelore.operators.chunk import chunk_pages, duplicate_keys, require_unique_keys

PAGE = "page_id int, title string, content string"


def test_limit_is_inclusive(spark):
    rows = [(1, "A", "a b c d"), (2, "B", "a b c d e"), (3, "C", "a b c d e f g h i")]
    chunks = chunk_pages(spark.createDataFrame(rows, PAGE), 4).orderBy("page_id", "chunk_no").collect()
    assert [(c.title, c.content, c.tokens, c.n_chunks) for c in chunks] == [
        ("A", "a b c d", 4, 1),
        ("B (1)", "a b c d", 4, 2),
        ("B (2)", " e", 1, 2),
        ("C (1)", "a b c d", 4, 3),
        ("C (2)", " e f g h", 4, 3),
        ("C (3)", " i", 1, 3),
    ]


def test_empty_page_has_no_chunks(spark):
    assert chunk_pages(spark.createDataFrame([(1, "A", "")], PAGE), 4).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \né\U0001f600", max_size=60), min_size=1, max_size=20), st.integers(1, 7))
def test_chunks_rejoin_and_respect_the_limit(spark, texts, limit):
    pages = spark.createDataFrame([(i, "T", t) for i, t in enumerate(texts)], PAGE)
    found = {}
    for c in chunk_pages(pages, limit).orderBy("page_id", "chunk_no").collect():
        assert c.chunk_no == len(found.setdefault(c.page_id, []))
        assert c.tokens == len(re.findall(r" ?[^ ]+| ", c.content)) <= limit
        found[c.page_id].append(c.content)
    for i, text in enumerate(texts):
        pieces = found.get(i, [])
        assert "".join(pieces) == text
        assert len(pieces) == -(-len(re.findall(r" ?[^ ]+| ", text)) // limit)


def test_long_page_needs_no_deep_stack(spark):
    text = " ".join(["w"] * 200_000)
    chunks = chunk_pages(spark.createDataFrame([(1, "A", text)], PAGE))
    assert chunks.agg(F.sum("tokens"), F.max("tokens"), F.count("*")).first()[:] == (200_000, 8192, 25)


def test_callers_tokenizer(spark):
    # One token per two characters.
    tokenizer = CallableTokenizer(lambda texts: [range(2, len(t), 2) for t in texts])
    pages = spark.createDataFrame([(1, "A", "abcdefg"), (2, "B", None), (3, "C", "")], PAGE)
    chunks = chunk_pages(pages, 2, tokenizer).orderBy("chunk_no")
    assert [(c.content, c.tokens) for c in chunks.collect()] == [("abcd", 2), ("efg", 2)]


def test_tokenizer_out_of_order_fails(spark):
    tokenizer = CallableTokenizer(lambda texts: [[2, 1] for _ in texts])
    with pytest.raises(Exception, match="ascend"):
        chunk_pages(spark.createDataFrame([(1, "A", "abc")], PAGE), 2, tokenizer).collect()


def test_limit_must_be_positive():
    with pytest.raises(ValueError):
        SpaceTokenizer().split(None, 0)


def test_duplicate_titles(spark):
    rows = spark.createDataFrame([("A",), ("A",), ("B",)], "title string")
    assert [tuple(r) for r in duplicate_keys(rows).collect()] == [("A", 2)]
    with pytest.raises(ValueError, match="'A' occurs 2 times"):
        require_unique_keys(rows)
    require_unique_keys(rows.distinct())


def test_batches_for_a_tokenizer_are_bounded_in_bytes(spark):
    """A batch of 10,000 long texts would be 200 MB."""

    def ends(texts):
        assert sum(map(len, texts)) < 6 << 20
        return [[len(t) // 2] for t in texts]

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    pages = spark.range(0, 1000, 1, 1).select(
        F.col("id").alias("page_id"), F.lit("T").alias("title"), F.repeat(F.lit("ab "), 7000).alias("content")
    )
    assert chunk_pages(pages, 1, CallableTokenizer(ends)).count() == 2000
