import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.functions.vectors import cosine
from pagelore.operators import retrieve as operator
from pagelore.operators import topk_kernel
from pagelore.operators.retrieve import _passes, build_context, retrieve, top_k, top_k_batch
from pagelore.sources.points import read_points, rebuild

POINT = "id string, title string, content string, embedding array<float>"
QUESTION = "question_id int, embedding array<float>, k bigint"
PLANS = {
    "one pass": {},
    "passes": {"pass_bytes": 100},
}


def make_points(spark, vectors, ids=None):
    ids = ids or [f"p{i:04d}" for i in range(len(vectors))]
    rows = [(i, f"t{i}", f"c{i}", [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, POINT).repartition(5)


def make_questions(spark, vectors, ks):
    rows = [(i, None if v is None else [float(x) for x in v], k) for i, (v, k) in enumerate(zip(vectors, ks))]
    return spark.createDataFrame(rows, QUESTION)


def brute(points, ids, questions, ks):
    want = set()
    points = np.asarray(points, np.float32).astype(float)
    for q, (vector, k) in enumerate(zip(questions, ks)):
        if vector is None:
            continue
        v = np.asarray(vector, np.float32).astype(float)
        k = 5 if k is None else k
        scored = []
        for i, p in zip(ids, points):
            size = np.sqrt(p @ p) * np.sqrt(v @ v)
            if size > 0:
                scored.append((-(round(float(p @ v) / size, 6) + 0.0), i))
        want |= {(q, rank + 1, -s, i) for rank, (s, i) in enumerate(sorted(scored)[:k])}
    return {(q, r, round(s, 6), i) for q, r, s, i in want}


def rows(frame):
    return {(r.question_id, r["rank"], round(r.score, 6), r.id) for r in frame.collect()}


@pytest.mark.parametrize("plan", PLANS)
def test_equals_brute_force(spark, plan):
    rng = np.random.default_rng(3)
    # Small integers: very many exact ties, also across partitions and blocks.
    points = rng.integers(-1, 2, (300, 4))
    questions = [*rng.integers(-1, 2, (40, 4)).tolist(), [0, 0, 0, 0], None]
    ks = [int(k) for k in rng.integers(0, 12, 38)] + [None, 1000, 3, 3]
    ids = [f"p{i:04d}" for i in range(300)]
    got = top_k_batch(make_points(spark, points), make_questions(spark, questions, ks), **PLANS[plan])
    assert rows(got) == brute(points, ids, questions, ks)


@pytest.mark.parametrize("plan", PLANS)
def test_payload_joins_alike(spark, plan):
    rng = np.random.default_rng(4)
    points = make_points(spark, rng.normal(size=(200, 8)))
    questions = make_questions(spark, rng.normal(size=(30, 8)).tolist(), [4] * 30)
    small = retrieve(points, questions, **PLANS[plan])
    large = retrieve(points, questions, **PLANS[plan], max_broadcast_hits=5)
    assert set(small.collect()) == set(large.collect())
    assert small.count() == 120
    assert all(r.title == f"t{r.id}" and r.content == f"c{r.id}" for r in small.collect())


@pytest.mark.parametrize("plan", PLANS)
def test_points_of_one_id_are_hits_of_their_own(spark, plan):
    points = make_points(spark, [[1, 0], [1, 0], [0, 1], [1, 1]], ["same", "same", "same", "other"])
    questions = make_questions(spark, [[1, 0], [1, 0]], [2, 9])
    for most in (5, 200_000):
        got = retrieve(points, questions, **PLANS[plan], max_broadcast_hits=most).collect()
        assert sorted((r.question_id, r["rank"]) for r in got) == [(0, 1), (0, 2)] + [(1, i) for i in range(1, 5)]
        assert sorted(r.id for r in got if r.question_id) == ["other", "same", "same", "same"]


@pytest.mark.parametrize("plan", PLANS)
def test_one_point_near_every_question(spark, plan):
    """A point in every result: the hot key of the payload join."""
    rng = np.random.default_rng(5)
    vectors = np.vstack([[10.0, 0, 0], rng.normal(size=(99, 3)) - [5, 0, 0]])
    questions = [[1.0, x, 0] for x in np.linspace(-0.1, 0.1, 60)]
    hits = retrieve(
        make_points(spark, vectors), make_questions(spark, questions, [1] * 60), **PLANS[plan], max_broadcast_hits=5
    )
    assert {(r.question_id, r.id) for r in hits.collect()} == {(i, "p0000") for i in range(60)}


@pytest.mark.parametrize("plan", PLANS)
def test_bad_vectors(spark, plan):
    points = make_points(spark, [[1, 0], [0, 0], [float("nan"), 1], [float("inf"), 1]])
    points = points.union(spark.createDataFrame([("null", "t", "c", None)], POINT))
    got = top_k_batch(points, make_questions(spark, [[1, 1]], [9]), **PLANS[plan])
    assert [r.id for r in got.collect()] == ["p0000"]
    with pytest.raises(Exception, match="values"):
        top_k_batch(points, make_questions(spark, [[1, 1, 1]], [9]), **PLANS[plan]).collect()


@pytest.mark.parametrize("plan", PLANS)
def test_nothing_to_find(spark, plan):
    none = spark.createDataFrame([], POINT)
    questions = make_questions(spark, [[1, 1]], [3])
    assert retrieve(none, questions, **PLANS[plan]).count() == 0
    points = make_points(spark, [[1, 0]])
    assert retrieve(points, questions.limit(0), **PLANS[plan]).count() == 0


@pytest.mark.parametrize("plan", PLANS)
def test_one_question_for_everything(spark, plan):
    """A question that wants more than there is, next to modest ones."""
    rng = np.random.default_rng(6)
    points = make_points(spark, rng.normal(size=(3000, 3)))
    questions = make_questions(spark, rng.normal(size=(3, 3)).tolist(), [2**62, 2**62, 2])
    got = top_k_batch(points, questions, **PLANS[plan])
    counts = {r.question_id: (r["n"], r.top) for r in got.groupBy("question_id").agg(
        F.countDistinct("id").alias("n"), F.max("rank").alias("top")).collect()}
    assert counts == {0: (3000, 3000), 1: (3000, 3000), 2: (2, 2)}


def test_integer_ids_order_as_numbers(spark):
    rows_ = [(i, "t", "c", [1.0, 0.0]) for i in (10, 9, 100, 2)]
    points = spark.createDataFrame(rows_, POINT.replace("id string", "id bigint"))
    for options in PLANS.values():
        got = top_k_batch(points, make_questions(spark, [[1, 0]], [3]), **options)
        assert [r.id for r in got.orderBy("rank").collect()] == [2, 9, 10]


def test_one_question(spark):
    points = make_points(spark, [[1, 0], [1, 1], [0, 1], [-1, 0]])
    got = top_k(points, [1.0, 0.2], 3).collect()
    assert [(r["rank"], r.id, r.title) for r in got] == [(1, "p0000", "tp0000"), (2, "p0001", "tp0001"), (3, "p0002", "tp0002")]
    assert top_k(points, [1.0, 0.0]).count() == 4
    assert top_k(points, [1.0, 0.0], 0).count() == 0
    assert top_k(points, [1.0, 0.0], 2**40).count() == 4


def test_cosine_column(spark):
    frame = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>"
    )
    got = [r[0] for r in frame.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5)
    assert got[1:] == [None, None]


def test_context_layout(spark):
    hits = spark.createDataFrame(
        [(1, 2, "B", "two "), (1, 1, "A", "one"), (2, 1, None, None)],
        "question_id int, rank int, title string, content string",
    )
    questions = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    got = {r.question_id: r.context for r in build_context(hits, questions).collect()}
    assert got == {
        1: "Page: A\nContent: one\n\n\n###\n\n\nPage: B\nContent: two \n\n\n###",
        2: "Page: \nContent: \n\n\n###",
        3: "",
    }


def test_passes():
    # 5,000 questions of width 1,536 are held at once, whatever the number of points.
    assert _passes(5_000 * 1536 * 4, 5 * 5_000, 5_000) == 1
    assert _passes(10**6 * 1536 * 4, 5 * 10**6, 10**6) == 92
    assert _passes(3 * 64, 3 * 2**40, 3) == 3


def test_hits_beyond_the_room_are_passed_on(monkeypatch, spark):
    monkeypatch.setattr(topk_kernel, "_ROOM", 50)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 4))
    schema = topk_kernel.pa.schema([("question_id", "int32"), ("id", "int64"), ("score", "float64"), ("k", "int64")])
    pa = topk_kernel.pa
    asked = pa.table({"question_id": pa.array([7, 8], "int32"), "embedding": rng.normal(size=(2, 4)).tolist(), "k": [200, 3]})
    batches = [
        pa.record_batch({"id": np.arange(i, i + 100), "embedding": pa.array(vectors[i : i + 100].tolist())})
        for i in range(0, 3000, 100)
    ]
    found = list(topk_kernel.score_partition(batches, asked, schema))
    assert len(found) > 2
    table = pa.Table.from_batches(found).to_pandas()
    for question, k, vector in zip((7, 8), (200, 3), asked["embedding"].to_pylist()):
        scores = vectors @ vector / np.linalg.norm(vectors, axis=1)
        want = set(np.argsort(-scores)[:k])
        assert want <= set(table[table.question_id == question].id)


@pytest.mark.parametrize("plan", PLANS)
def test_a_model_is_asked_once_per_question(spark, tmp_path, plan):
    log = str(tmp_path / "calls")

    @F.pandas_udf("array<float>")
    def model(ids):
        import pandas as pd

        with open(log, "a") as out:
            out.writelines(f"{i}\n" for i in ids)
        return pd.Series([[1.0, float(i)] for i in ids])

    questions = spark.range(40).select(
        F.col("id").cast("int").alias("question_id"), model.asNondeterministic()("id").alias("embedding"), F.lit(2).alias("k")
    )
    points = make_points(spark, [[1, 0], [0, 1], [1, 1]])
    assert retrieve(points, questions, **PLANS[plan]).count() == 80
    assert sorted(map(int, open(log).read().split())) == list(range(40))


class Unordered(str):
    """An id that must not be compared."""

    __hash__ = str.__hash__

    def __lt__(self, other):
        raise AssertionError("ids without a tie are compared")


def test_ids_are_compared_only_for_ties():
    rng = np.random.default_rng(3)
    vectors, questions = rng.normal(size=(3000, 8)), rng.normal(size=(4, 8))
    best = topk_kernel.BestPoints(questions, np.full(4, 5))
    best.add(np.array([Unordered(i) for i in range(3000)], dtype=object), vectors)
    rows_, scores, ids = best.result()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = questions / np.linalg.norm(questions, axis=1, keepdims=True) @ units.T
    for q in range(4):
        assert {int(i) for i in ids[rows_ == q]} == set(np.argsort(-want[q])[:5].tolist())


def test_scores_that_single_precision_cannot_tell_apart():
    """Best and next best differ by two millionths, ties at the k-th place go to smaller ids."""
    base = np.zeros(64)
    base[0] = 1.0
    steps = np.repeat(np.arange(1500), 3)
    scores = 0.5 + 2e-6 * steps
    vectors = np.zeros((len(steps), 64))
    vectors[:, 0], vectors[:, 1] = scores, np.sqrt(1 - scores**2)
    order = np.random.default_rng(0).permutation(len(steps))
    best = topk_kernel.BestPoints(base[None, :], np.array([7]))
    best.add(order.astype(object), vectors[order])
    _, found, ids = best.result()
    assert sorted(ids.tolist()) == [4491, *range(4494, 4500)]
    assert sorted(found.tolist())[-1] == round(float(scores[-1]), 6)


@pytest.fixture
def stored(spark, tmp_path):
    """2,000 points of small integers, very many of equal score, as they lie in a points table."""
    vectors = np.random.default_rng(9).integers(-2, 3, (2000, 6))
    rows_ = [(i, 0, f"t{i}", f"c{i}", 1, [float(x) for x in v]) for i, v in enumerate(vectors)]
    schema = "page_id int, chunk_no int, title string, content string, tokens int, embedding array<float>"
    rebuild(spark.createDataFrame(rows_, schema).repartition(3), str(tmp_path), 6)
    return read_points(spark, str(tmp_path))


def scan_twice(monkeypatch):
    """Small tables count as large ones; returns the hits that left each scan."""
    monkeypatch.setattr(operator, "_FLOOR_PAIRS", 0)
    monkeypatch.setattr(operator, "_FLOOR_QUESTIONS", 1)
    scans, scan = [], operator._score_scan
    monkeypatch.setattr(operator, "_score_scan", lambda *args: scans.append(scan(*args)) or scans[-1])
    return scans


@pytest.mark.parametrize("plan", PLANS)
def test_a_first_scan_tells_the_second_what_matters(monkeypatch, spark, stored, plan):
    rng = np.random.default_rng(10)
    questions = [*rng.integers(-2, 3, (30, 6)).tolist(), [0] * 6, None, *rng.integers(-2, 3, (3, 6)).tolist()]
    # The first scan does not find 150 points, and 5,000 are not there.
    asked = make_questions(spark, questions, [int(k) for k in rng.integers(0, 9, 30)] + [3, 3, 150, 900, 5000])
    monkeypatch.setattr(operator, "_FLOOR_K", 10_000)
    want = rows(top_k_batch(stored, asked, **PLANS[plan]))
    scans = scan_twice(monkeypatch)
    assert rows(top_k_batch(stored, asked, **PLANS[plan])) == want
    assert len(scans) > 1 and len(want) > 2000


def test_a_second_scan_passes_fewer_hits_on(monkeypatch, spark, stored):
    rng = np.random.default_rng(11)
    asked = make_questions(spark, rng.normal(size=(200, 6)).tolist(), [1] * 200)
    points = stored.repartition(20)
    # Dealt out anew, but still the stored points.
    points = points.withMetadata("bucket", stored.schema["bucket"].metadata)
    alone = rows(top_k_batch(points, asked))
    scans = scan_twice(monkeypatch)
    assert rows(top_k_batch(points, asked)) == alone
    first, second = (scan.count() for scan in scans)
    # A hit for each question and task, but for those that are no better than the first scan's best.
    assert first == 200 * spark.sparkContext.defaultParallelism
    assert second < 200 * 20 * 0.8


@pytest.mark.parametrize("ids", [[1, 1, 2], [1, None, 2]])
def test_questions_without_an_id_of_their_own_are_scored_in_one_scan(monkeypatch, spark, stored, ids):
    rows_ = [(i, [1.0, float(n), 0.0, 1.0, 0.0, 0.0], 4) for n, i in enumerate(ids)]
    asked = spark.createDataFrame(rows_, QUESTION)
    want = rows(top_k_batch(stored, asked))
    scans = scan_twice(monkeypatch)
    assert rows(top_k_batch(stored, asked)) == want
    assert len(scans) == 1


def test_floors_keep_ties_and_drop_what_is_below():
    pa = topk_kernel.pa
    vectors = [[1.0, 0.0], [3.0, 4.0], [4.0, 3.0], [6.0, 8.0], [0.0, 1.0]]
    batch = pa.record_batch({"id": pa.array(range(5)), "embedding": pa.array(vectors)})
    asked = pa.table(
        {
            "question_id": pa.array([7, 8], "int32"),
            "embedding": pa.array([[1.0, 0.0], [1.0, 0.0]]),
            "k": [3, 3],
            "floor": [0.6, float("-inf")],
        }
    )
    schema = pa.schema([("question_id", "int32"), ("id", "int64"), ("score", "float64"), ("k", "int64")])
    found = pa.Table.from_batches(topk_kernel.score_partition([batch], asked, schema)).to_pylist()
    assert sorted((r["question_id"], r["id"], r["score"]) for r in found) == [
        (q, i, s) for q in (7, 8) for i, s in ((0, 1.0), (1, 0.6), (2, 0.8))
    ]
    asked = asked.set_column(3, "floor", pa.array([0.7, 0.7]))
    found = pa.Table.from_batches(topk_kernel.score_partition([batch], asked, schema)).to_pylist()
    assert sorted((r["question_id"], r["id"]) for r in found) == [(7, 0), (7, 2), (8, 0), (8, 2)]
