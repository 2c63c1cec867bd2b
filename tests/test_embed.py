import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pagelore.operators.embed import HashedWords, embed, embedding


def by_hand(text, dim):
    counts = [0] * dim
    for word in text.split(" "):
        if word:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dim] += 1
    norm = math.sqrt(sum(c * c for c in counts)) or 1
    return [c / norm for c in counts]


def test_hashed_words(spark):
    texts = ["one two  two", "", "ein ä \U0001f600", "one"] * 200
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = {r.i: r.embedding for r in embed(rows, HashedWords(8), 8).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(by_hand(text, 8), abs=1e-6)


def test_null_text_is_not_sent(spark):
    def picky(texts):
        assert texts.notna().all()
        return [[1.0, 2.0] for _ in texts]

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, content string").coalesce(1)
    got = embed(rows, picky, 2).orderBy("i").collect()
    assert [r.embedding for r in got] == [[1.0, 2.0], None, [1.0, 2.0]]


@pytest.mark.parametrize("fn", [lambda ts: [[1.0]] * len(ts), lambda ts: []])
def test_wrong_width_or_number_fails(spark, fn):
    rows = spark.createDataFrame([(1, "a")], "i int, content string")
    with pytest.raises(Exception, match="vector"):
        embed(rows, fn, 2).collect()


def test_model_is_called_once_per_row_that_is_kept(spark, tmp_path):
    log = str(tmp_path / "calls")

    def logging(texts):
        with open(log, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return [[1.0, 0.0] for _ in texts]

    rows = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "t string, ok boolean")
    kept = rows.where("ok").select("t", embedding(F.col("t"), logging, 2).alias("e"))
    assert kept.where("e is not null").count() == 2
    assert sorted(open(log).read().split()) == ["a", "c"]


def test_parallelism(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(20)], "i int, content string")
    assert embed(rows, HashedWords(4), 4, parallelism=3).rdd.getNumPartitions() == 3
