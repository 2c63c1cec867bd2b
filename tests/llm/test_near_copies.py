"""Near-copies against all pairs, with hot groups larger than blocks and regions."""

import random

import pytest
from pyspark.sql import functions as F

from pagelore.llm.components import components
from pagelore.llm import near_copies as module
from pagelore.llm.near_copies import Forest, keep_one, near_copies


def plain(rows, width, percent):
    def shingles(text):
        words = [w.lower() if w.isascii() else w for w in (text or "").split()]
        if not words:
            return set()
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(0, 120)]
    hub = [word() for _ in range(150)]
    for i in range(200, 290):  # a star: satellites near the hub, not near each other
        edited = list(hub)
        for _ in range(rng.randrange(1, 7)):
            edited[rng.randrange(len(edited))] = word()
        rows.append((i, " ".join(edited)))
    rows += [(300 + i, rows[5][1].upper()) for i in range(40)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "One"), (404, "one"), (405, "one two three"), (406, "ONE TWO three")]
    rows += [(407, "x y z " * 5000), (408, "x y z " * 5001)]
    passage = " ".join(hub[:60])
    rows += [(500 + i, passage + " " + " ".join(word() for _ in range(100))) for i in range(20)]
    return rows


@pytest.mark.parametrize("forest", [Forest(), Forest(block=16, region=8)])
def test_equal_to_all_pairs(spark, forest):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component string, kept int")
    got = near_copies(frame, forest=forest).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 80)


def test_crowded_regions_lose_no_pair(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(120):  # a chain: each text is linked to the next ones only
        words[rng.randrange(160)] = f"n{i}"
        words[rng.randrange(160)] = f"m{i}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, 4, 80)
    assert len({c for _, _, c, _ in want}) < 60
    # Crowds that are deeper ones', and crowds to the last label, which meet in blocks.
    for forest in (Forest(region=4), Forest(region=4, depth=4), Forest(region=6, depth=5, more_trees=30)):
        assert sorted(map(tuple, near_copies(frame, forest=forest).collect())) == want


def templates(n, seed=6):
    """Pages of one template, which is much of each text; every tenth has a near-copy."""
    rng = random.Random(seed)
    template = " ".join(f"t{i}" for i in range(60))
    rows = []
    for i in range(n):
        own = [f"x{rng.randrange(10**6)}" for _ in range(70)]
        if i % 10 == 9:
            own = rows[-1][1].split()[60:]
            own[rng.randrange(70)] = "changed"
        rows.append((i, template + " " + " ".join(own)))
    return rows


def test_a_crowd_of_one_template_takes_linear_work(spark, monkeypatch):
    compared = []
    agreeing = module._agreeing

    def counted(rows, percent, forest):
        sizes = rows.groupBy("crowd", "i", "j").count()
        compared.append(sizes.agg(F.sum("count"), F.max("count")).first())
        return agreeing(rows, percent, forest)

    monkeypatch.setattr(module, "_agreeing", counted)
    forest = Forest(region=300)
    for n in (1500, 3000):
        compared.clear()
        frame = spark.createDataFrame(templates(n), "doc_id long, text string")
        found = {r.doc_id: r.component_id for r in near_copies(frame, forest=forest).collect()}
        # Every planted pair is found, and nothing else is linked.
        assert found == {i: i - 1 if i % 10 == 9 else i for i in range(n)}
        # A text once in each tree, and at most once in each of the deeper ones; regions are bounded.
        assert len(compared) == 2 and compared[0][0] == 24 * n and compared[1][0] <= 72 * n
        assert all(c[1] <= 300 for c in compared)


def test_blocks_are_bounded_in_bytes(spark):
    rows = corpus(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies(frame, forest=Forest(block_bytes=4000, region=30)).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 80)


def test_meetings(spark):
    # 400 of one component in one crowd, 60 others; another crowd is one component.
    rows = spark.range(500).select(
        F.when(F.col("id") < 460, 1).otherwise(2).cast("long").alias("crowd"), F.col("id").alias("node"), F.lit(1 / 20).alias("weight")
    )
    placed = spark.range(500).where("id < 400 or id >= 460").select(
        F.col("id").alias("node"), F.when(F.col("id") < 400, 0).otherwise(460).cast("long").alias("component")
    )
    told = module._meetings(rows, placed, "node")
    met = {}
    for r in told.select("crowd", "node", F.explode(module._met()).alias("at")).collect():
        met.setdefault((r.crowd, r["at"].i, r["at"].j), set()).add(r.node)
    assert {crowd for crowd, _, _ in met} == {1}
    together = {(a, b) for m in met.values() for a in m for b in m}
    assert all((a, b) in together for a in range(460) for b in range(400, 460))
    assert max(map(len, met.values())) <= 2 * 20 * 2
    assert sum(map(len, met.values())) < 460 * 4 + 60 * 24 + 1
    assert module._meetings(rows.where("crowd = 2"), placed, "node") is None


def test_odd_rows(spark):
    text = "some words that are long enough to count here"
    rows = [(7, text), (7, text), (3, text), (None, text), (None, None), (9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_copies(frame).collect()), key=str)
    assert got == sorted(
        [(7, 6, 3, False), (7, 6, 3, False), (3, 6, 3, True), (None, 6, None, True), (None, 0, None, True), (9, 0, 9, True)],
        key=str,
    )
    assert near_copies(frame.limit(0)).collect() == []


def test_keep_one(spark):
    text = "some words that are long enough to count here"
    rows = [(7, text), (3, text), (3, text), (5, "others"), (5, "others"), (None, text), (8, None)]
    frame = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, other long")
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(3, text, 3), (5, "others", 5), (None, text, None), (8, None, 8)], key=str
    )


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)]  # a path
    edges += [(1000, 1000 + i) for i in range(1, 200)]  # a star
    edges += [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    edges += [(5000, 5000)]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(got.collect()) == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert got.select(F.count("*") == F.countDistinct("node")).first()[0]
