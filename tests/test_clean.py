import random
import time

import pytest
from pyspark.sql import functions as F

from pagelore.functions.text import MARKUP_STEPS, clean_content, clean_title, is_blank, strip_markup, trim
from pagelore.operators.clean import clean_pages, drop_empty

CASES = [
    ("a <gallery mode=x>\nA.png|one\nB.png</gallery> b", "a b"),
    ("x|image = <gallery>A.png</gallery>\\\ny", "x y"),
    ("a [[File:x.png|thumb]] b", "a b"),
    ("a [[File:x.png|see [[cap]]]] b", "a ]] b"),
    ("__NOTOC__ a __TOC__ b", "a b"),
    ("a __unpaired b", "a __unpaired b"),
    ("a <!-- one\ntwo --> b", "a b"),
    ('a <span style="x">kept</span><br/>b', "a keptb"),
    ('<div class="c">kept</div>', "kept"),
    ("'''bold''' and ''italic''", "bold and ''italic''"),
    ("'''''both'''''", "both"),
    ("[[Target|label]] and [[Plain]]", "label and Plain"),
    ("[[a\u2028b]]", "a b"),
    ("'''a\rb'''", "a b"),
    ("a\u00a0\u00a0b\u0085c\r\n\td\u2028e", "a b c d e"),
    ("\u3000 a \u00a0", "a"),
    ("plain text", "plain text"),
]


def test_content_steps(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", clean_content(F.col("t")).alias("c")).collect()}
    for i, (raw, want) in enumerate(CASES):
        assert got[i] == want, raw


@pytest.mark.parametrize(("raw", "want"), [("_A_b_", "A b"), ("\u00a0A\u2003", "A"), ("__", "")])
def test_title(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "t string")
    assert frame.select(clean_title(F.col("t"))).first()[0] == want


def test_trim_and_blank(spark):
    frame = spark.createDataFrame([(" \u00a0\u2028\n",), (None,), ("",), (" x\t",)], "t string")
    rows = frame.select(is_blank(F.col("t")), trim(F.col("t"))).collect()
    assert [r[0] for r in rows] == [True, True, True, False]
    assert rows[3][1] == "x"


def test_pages_without_title_or_text_go(spark):
    rows = [(1, "A", "text"), (2, "", "text"), (3, None, "text"), (4, "B", ""), (5, "C", None),
            (6, "D", "<!-- only a comment -->"), (7, "_", "text")]
    pages = spark.createDataFrame(rows, "page_id int, title string, content string")
    assert [r.page_id for r in drop_empty(pages).orderBy("page_id").collect()] == [1, 6, 7]
    assert [tuple(r) for r in clean_pages(pages).collect()] == [(1, "A", "text")]


def test_each_text_is_cleaned_once(spark):
    pages = spark.createDataFrame([(1, "A", "text")], "page_id int, title string, content string")
    plan = clean_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("</gallery>") == 1, plan


PIECES = ["<gallery", "<gallery>", "</gallery>", "|image = ", "[[File:", "[[", "]]", "]", "|", "__", "<!--", "-->", "<span", "</span>",
          "<br", "<div", "</div>", ">", "'''", "''''", "\\", "\n", "a", "é", "\U0001f600", " "]


def test_steps_equal_the_patterns_alone(spark):
    """Not to look behind the last closer changes no text."""
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 40))) for _ in range(4000)]
    plain = F.replace(F.col("t"), F.lit("\n"), F.lit(" "))
    for _, pattern, replacement in MARKUP_STEPS:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(replacement))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select("t", strip_markup(F.col("t")).alias("got"), plain.alias("want"))
    assert both.where("got <> want").collect() == []
    assert both.where("got <> replace(t, '\n', ' ')").count() > 1000


@pytest.mark.parametrize("opener", ["<gallery ", "[[File:", "<!-- ", "<span ", "<br ", "<div ", "[[", "__ ", "'''' "])
def test_openers_without_closer_take_linear_time(spark, opener):
    n = 10_000_000 // len(opener)
    frame = spark.range(1).select(F.repeat(F.lit(opener), F.lit(n) + F.col("id").cast("int")).alias("t"))
    start = time.monotonic()
    length = frame.select(F.length(strip_markup(F.col("t")))).first()[0]
    assert time.monotonic() - start < 30
    assert length == n * len(opener) if opener not in ("__ ", "'''' ") else length < n * len(opener)
