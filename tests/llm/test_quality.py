"""Quality rules against a plain implementation."""

import re

from pagelore.llm.quality import clean, quality

SENTENCE = "This is a line of fair words that ends well. "
PROSE = " ".join(f"word{i} of{i % 7}" for i in range(40)) + "."
TEXTS = [
    None,
    "",
    " \n\t\n ",
    "one two three",
    SENTENCE * 10,
    "\n".join(f"Line {i} of ten has its own words, all told ten." for i in range(10)),
    "a b c a b c a b c " * 30,
    "Home | About | Contact | Login\n" + PROSE + "\nHome\nAll rights reserved 2020\n\n",
    "w#$ x%% y&& z** " * 20,
    "same line here.\nsame line here.\n\n\nother line here.\n" * 5 + PROSE,
    "x\x0by\x0cz\r\n  é 字 " * 30,
    " ".join(f"w{i % 700}" for i in range(20_000)) + ".",
    " ".join(f"word{i}" for i in range(51)),
]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else None
    if count is None:
        from collections import Counter

        count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


def frame(spark, texts):
    rows = [(i, t, 5, "clash", "clash", "dot") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string, _quality_words string, `a.b` string")


def test_base_counts(spark):
    got = {r.doc_id: r for r in quality(frame(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        assert tuple(got[i])[1:7] == plain(text), i
        assert not (got[i].base_failed and got[i].kept)


def test_lines_are_judged_first(spark):
    found = {r.doc_id: r for r in clean(frame(spark, TEXTS)).collect()}
    assert found.keys() == {7, 9, 12}
    assert found[7].text == PROSE + "\n\n"
    assert found[7].n_chars == len(found[7].text)
    assert found[9].text == TEXTS[9]


def test_too_much_lost(spark):
    menu = "\n".join(f"item{i} | thing{i} | entry{i}" for i in range(60))
    kept = {r.doc_id: r.kept for r in quality(frame(spark, [PROSE + "\n" + menu[:300], PROSE + "\n" + menu])).collect()}
    assert kept == {0: True, 1: False}


def test_no_rows(spark):
    assert quality(frame(spark, TEXTS).limit(0)).collect() == []
    assert clean(frame(spark, TEXTS).limit(0)).columns == ["doc_id", "text", "n_chars", "kept", "_quality_words", "a.b"]
