"""Budgets and prefixes against a plain implementation."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pagelore.llm.common import free_prefix
from pagelore.llm.mixing import byte_tokens, mix


def fill(budget, children):
    """Shares of children (name, weight, room): the exhausted are taken out one round after another."""
    out, open_ = {}, {n: (w, r) for n, w, r in children}
    for n in [n for n, (w, _) in open_.items() if w == 0]:
        out[n] = 0
        del open_[n]
    while True:
        total = sum(w for w, _ in open_.values())
        gone = [n for n, (w, r) in open_.items() if r * total <= w * budget]
        if not gone:
            break
        for n in gone:
            out[n] = open_.pop(n)[1]
            budget -= out[n]
    at = 0
    for n in sorted(open_):
        w = open_[n][0]
        out[n] = budget * (at + w) // total - budget * at // total
        at += w
    return out


def plain(rows, weights, percent, epochs, seed):
    size = lambda t: math.ceil(len((t or "").encode()) / 4)
    leaves = {}
    for i, text, a, b in rows:
        leaves.setdefault((a or "", b or ""), []).append((i, size(text)))
    room = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}
    budget = sum(size(r[1]) for r in rows) * percent // 100
    tops = sorted({a for a, _ in leaves})
    above = {
        a: sum(room[k] if weights["b"].get(k[1], 1) else 0 for k in leaves if k[0] == a) for a in tops
    }
    first = fill(budget, [(a, weights["a"].get(a, 1), above[a]) for a in tops])
    out = []
    for a in tops:
        own = [k for k in leaves if k[0] == a]
        for b, given in fill(first[a], [(k[1], weights["b"].get(k[1], 1), room[k]) for k in own]).items():
            docs = leaves[(a, b)]
            tokens = sum(n for _, n in docs)
            if not given:
                continue
            full, rest = divmod(given, tokens)
            order = sorted((hashlib.md5(f"{seed}:{full}:{'' if i is None else i}".encode()).hexdigest(), n, i) for i, n in docs)
            till, last = 0, ""
            for place, n, _ in order:
                till += n
                if rest and (till <= rest or (till - n < rest and till - rest < rest - till + n)):
                    last = place
            for place, _, i in order:
                out += [(i, e) for e in range(full + (place <= last))]
    return sorted(out, key=str)


@pytest.mark.parametrize(("percent", "epochs"), [(50, 1), (80, 1), (100, 1), (150, 1), (90, 4), (0, 2)])
def test_equal_to_plain(spark, percent, epochs):
    rng = random.Random(percent)
    rows = [
        (i, "x" * rng.choice([0, 3, 40, 400, 4000]), rng.choice(["p", "p", "p", "q", None]), rng.choice(["u", "v", "w", "z", None]))
        for i in range(400)
    ]
    rows += [(5, "y" * 400, "p", "u"), (None, "n" * 30, "q", "u"), (1000, None, "r", "u")]
    weights = {"a": {"p": 1, "q": 5}, "b": {"u": 3, "z": 0}}
    clash = "doc_id long, text string, a string, b string, tokens string, full string, cut string, _epoch string"
    frame = spark.createDataFrame([(*r, "t", "f", "c", "e") for r in rows], clash)
    prefix = free_prefix(frame, "_")
    mixed = mix(frame, {"a": F.col("a"), "b": F.col("b")}, weights, percent, epochs, seed=11, prefix=prefix)
    rows_without_twins = [r for r in rows if r[0] != 5] if percent == 0 else rows
    got = sorted(((r.doc_id, r[f"{prefix}epoch"]) for r in mixed.collect()), key=str)
    assert got == plain(rows_without_twins, weights, percent, epochs, 11)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, a string")
    assert mix(frame, {"a": F.col("a")}, {}, 50).collect() == []


def test_byte_tokens(spark):
    frame = spark.createDataFrame([("",), (None,), ("abc",), ("abcd",), ("éé1",)], "t string")
    assert [r[0] for r in frame.select(byte_tokens(F.col("t"))).collect()] == [0, 0, 1, 1, 2]
