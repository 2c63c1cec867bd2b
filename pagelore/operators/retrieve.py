"""Exact cosine top-k over a points table, and the context text made of the hits.

Points are ``id, embedding`` plus the payload ``title, content``, and ``norm`` and
``bucket`` where they come from a points table; questions are ``question_id, embedding, k``.
Ids may be of any orderable type. Each point is a hit of its own, also where several have
one id.

Scoring visits every (question, point) pair, so the work is a blocked matrix
product and no pair ever becomes a row. The smaller side, the questions, moves: they
are cut into passes of bounded bytes and bounded hits (counted, not guessed), each is
broadcast, and the points are scanned where they lie. One pass is the usual case; no
point vector is ever shuffled.

The survivors are ranked in two steps, first per question and salt: a task of the second
step sorts at most salts times ``k`` rows for one question. The first step gets up to
``k`` rows per question from each scan task, so the scan is cut into few tasks. Where some
question asks for very many, no task holds all rows of one: see :mod:`pagelore.operators.ranking`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelore.functions.text import trim
from pagelore.operators.lookup import MAX_BROADCAST_ROWS, lookup
from pagelore.operators.ranking import rank_hits
from pagelore.operators.topk_kernel import score_partition
from pagelore.session import use_checkpoints
from pagelore.sources.points import bucket_of, buckets_of

# Fixed value: how many points a question gets when it does not say.
DEFAULT_K = 5

# A pass of questions holds about so many bytes of vectors, and asks for about so many hits.
PASS_BYTES = 64 << 20
PASS_HITS = 2_000_000
# A scan has no more tasks than this or four times the cores, whichever is more.
_SCAN_TASKS = 1000
# Stored points are scanned twice where there are more pairs than this for each core, and no question wants
# more hits than this: a point in so many first, to know what a hit of the others has to reach.
_FLOOR_PAIRS = 1 << 31
_FLOOR_K = 1000
_FIRST = 16
# For fewer questions the points are not even counted.
_FLOOR_QUESTIONS = 1000


def top_k(points: DataFrame, vector: Sequence[float], k: int = DEFAULT_K) -> DataFrame:
    """The ``k`` nearest points of one vector, with payload, best first."""
    spark = points.sparkSession
    question = spark.createDataFrame(
        [(0, [float(x) for x in vector], int(k))], "question_id int, embedding array<float>, k bigint"
    )
    return retrieve(points, question).drop("question_id").orderBy("rank")


def top_k_batch(points: DataFrame, questions: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``question_id, rank, score, id`` of the ``k`` nearest points of each question."""
    return _top_k_batch(points, questions, pass_bytes)[0]


def retrieve(
    points: DataFrame,
    questions: DataFrame,
    pass_bytes: int = PASS_BYTES,
    max_broadcast_hits: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """:func:`top_k_batch` plus ``title, content`` of each hit."""
    hits, max_hits = _top_k_batch(points, questions, pass_bytes)
    return _with_payload(hits, points, max_hits, max_broadcast_hits)


def build_context(hits: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """``question_id, context``: the hits' texts in rank order.

    With ``questions`` every question has a row, and one without hits has ``''``.
    """
    # Fixed value: the layout of one hit.
    block = F.concat(
        F.lit("Page: "),
        F.coalesce("title", F.lit("")),
        F.lit("\nContent: "),
        F.coalesce("content", F.lit("")),
        F.lit("\n\n\n###\n\n\n"),
    )
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    context = trim(F.array_join(F.transform(blocks, lambda b: b["block"]), ""))
    contexts = hits.groupBy("question_id").agg(context.alias("context"))
    if questions is None:
        return contexts
    contexts = contexts.withColumn("found", F.lit(True))
    return (
        questions.select("question_id")
        .join(contexts, "question_id", "left")
        .select("question_id", F.when(F.col("found"), F.col("context")).otherwise("").alias("context"))
    )


def _top_k_batch(points: DataFrame, questions: DataFrame, pass_bytes: int) -> tuple[DataFrame, int]:
    """The ranked hits, and a bound on their number."""
    spark = points.sparkSession
    schema = hit_schema(points, questions)
    asked = asked_once(questions)
    measured = measure(asked)
    if measured["bytes"] is None:
        return rank_hits(spark.createDataFrame([], schema), 0).drop("k"), 0
    hits, most = int(measured["hits"]), measured["most"]
    parts = in_passes(asked, measured, pass_bytes)
    scan = _score_twice if _worth_floors(points, measured) else _score_scan
    found = reduce(DataFrame.union, [scan(points, part.toArrow(), schema) for part in parts])
    return rank_hits(found, most, scans=2 * scan_tasks(spark)).drop("k"), hits


def asked_once(questions: DataFrame) -> DataFrame:
    """``question_id, embedding, k`` of the questions that want something, written out.

    They are measured and then read by every pass, and no model is to be asked twice.
    """
    use_checkpoints(questions.sparkSession)
    k = F.coalesce("k", F.lit(DEFAULT_K)).cast("bigint").alias("k")
    return questions.select("question_id", "embedding", k).where("embedding is not null and k > 0").checkpoint()


def measure(asked: DataFrame, *lists: str) -> Row:
    """``bytes`` (with those of lists of numbers), ``hits`` wanted, ``questions`` and the ``most`` wanted by one."""
    wanted = F.least("k", F.lit(1 << 40))
    values = sum((F.size(name) for name in lists), F.size("embedding"))
    return asked.agg(
        F.sum(4 * values).alias("bytes"),
        F.sum(wanted.cast("decimal(38,0)")).alias("hits"),
        F.count("*").alias("questions"),
        F.max("k").alias("most"),
    ).first()


def in_passes(asked: DataFrame, measured: Row, pass_bytes: int) -> list[DataFrame]:
    """The questions cut into passes."""
    passes = _passes(measured["bytes"], int(measured["hits"]), measured["questions"], pass_bytes)
    share = F.pmod(F.xxhash64("question_id"), F.lit(passes))
    return [asked.where(share == n) for n in range(passes)]


def _passes(vector_bytes: int, hits: int, n_questions: int, pass_bytes: int = PASS_BYTES) -> int:
    """How many passes the questions are cut into: one where a task can hold them all.

    A question that asks for very much makes no more passes than there are questions; its
    hits leave the task whenever they fill its room.
    """
    return max(1, -(-vector_bytes // pass_bytes), min(n_questions, -(-hits // PASS_HITS)))


def hit_schema(points: DataFrame, questions: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("question_id", questions.schema["question_id"].dataType),
            T.StructField("id", points.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("k", T.LongType()),
        ]
    )


def _vectors(points: DataFrame) -> DataFrame:
    known = ["norm"] if "norm" in points.columns else []
    return points.select("id", "embedding", *known).where("embedding is not null")


def _worth_floors(points: DataFrame, measured: Row) -> bool:
    """Whether so many pairs are scored that a scan of some points first spares more than it takes.

    Asked of stored points only: their number is in their files, and they are the same in both scans.
    """
    if buckets_of(points) is None or measured["most"] > _FLOOR_K or measured["questions"] < _FLOOR_QUESTIONS:
        return False
    cores = points.sparkSession.sparkContext.defaultParallelism
    return measured["questions"] * points.count() > _FLOOR_PAIRS * cores


def _score_twice(points: DataFrame, questions: pa.Table, schema: T.StructType) -> DataFrame:
    """The hits of :func:`_score_scan`, fewer of them: one point in ``_FIRST`` is scored first, and of the
    others only those matter whose score reaches the ``k``-th found so far."""
    ids = questions["question_id"].combine_chunks()
    # A floor is told by the question's id.
    if pa.types.is_nested(ids.type) or not 0 < questions.num_rows == pc.count_distinct(ids).as_py():
        return _score_scan(points, questions, schema)
    cores = points.sparkSession.sparkContext.defaultParallelism
    early = F.pmod(F.xxhash64("id"), F.lit(_FIRST)) == 0
    found = _score_scan(points.where(early), questions, schema, cores)
    # Read by the floors and by the result.
    use_checkpoints(points.sparkSession)
    first = rank_hits(found, pc.max(questions["k"]).as_py(), scans=cores).select(schema.names).checkpoint()
    floors = first.groupBy("question_id").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.min("score").alias("floor"))
    # A number for each question of the pass.
    known = floors.where("n >= k").select("question_id", "floor").toArrow()
    place = pc.index_in(ids, value_set=known["question_id"].combine_chunks().cast(ids.type))
    floor = known["floor"].combine_chunks().take(place).fill_null(float("-inf"))
    return first.union(_score_scan(points.where(~early), questions.append_column("floor", floor), schema))


def _score_scan(points: DataFrame, questions: pa.Table, schema: T.StructType, tasks: int | None = None) -> DataFrame:
    """Best k per question of each task's share of the points, questions broadcast."""
    spark = points.sparkSession
    if questions.num_rows == 0:
        return spark.createDataFrame([], schema)
    arrow_schema = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast(questions)

    def score(batches):
        return score_partition(batches, shared.value, arrow_schema)

    return _vectors(points).coalesce(tasks or scan_tasks(spark)).mapInArrow(score, schema)


def scan_tasks(spark: SparkSession) -> int:
    return max(_SCAN_TASKS, 4 * spark.sparkContext.defaultParallelism)


def _with_payload(
    hits: DataFrame,
    points: DataFrame,
    max_hits: int,
    max_broadcast_hits: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join the payload to the hits without shuffling the texts of the whole table.

    Of points that lie in buckets only those of the hits are read.
    """
    wanted = ["question_id", "rank", "score", "id", "title", "content"]
    buckets = buckets_of(points)
    if buckets is not None:
        # Written once: their buckets are listed, at most as many numbers as there are buckets.
        use_checkpoints(points.sparkSession)
        hits = hits.checkpoint()
        found = [r[0] for r in hits.select(bucket_of(F.col("id"), buckets)).distinct().collect()]
        payload = points.where(F.col("bucket").isin(found)).select("id", "title", "content")
        return lookup(payload, hits, "id", max_hits, max_broadcast_hits).select(*wanted)
    # Ids may repeat: the n-th hit of an id takes the n-th of its texts.
    copy = F.row_number().over(Window.partitionBy("question_id", "id").orderBy("rank"))
    payload = points.select("id", "title", "content")
    joined = lookup(payload, hits.withColumn("copy", copy), "id", max_hits, max_broadcast_hits)
    place = F.row_number().over(Window.partitionBy("question_id", "rank").orderBy("title", "content"))
    return joined.withColumn("place", place).where("place = copy").select(*wanted)
