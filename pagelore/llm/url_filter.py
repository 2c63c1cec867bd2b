"""URLs judged by rules and by two character language models (operator 6)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute known)
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.byte_trees import Trees, build, count_strings, padded
from pagelore.llm.common import arrow_column, distinct_by_hash, map_arrow, stored, text_slices

ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty if it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``length, rule, verdict`` of the longest rule that fits; null if none does."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    fitting = []
    for r in rules:
        on_host = (host == r.host) | host.endswith("." + r.host)
        found = F.struct(
            F.lit(len(r.host + r.path)).alias("length"),
            F.lit(r.host + r.path).alias("rule"),
            F.lit(r.verdict).alias("verdict"),
        )
        fitting.append(F.when(on_host & path.startswith(r.path), found))
    return F.array_max(F.array(*fitting))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    url: str = "url",
    order: int = 4,
    sample_urls: int | None = None,
) -> DataFrame:
    """Rows ``page_id, host, path, rule, verdict, score``, one per row of ``pages``.

    The longest fitting rule decides. A url that no rule fits is judged by two byte
    models, learned from all distinct urls that rules allow and block, however often they
    repeat (with ``sample_urls`` from that many of each, those of smallest hash): ``score`` is
    the difference of their code lengths in bits per byte, above 0 if it looks more like an
    allowed one. It is allowed if the score reaches the threshold that tells a fifth of the
    urls, kept out of learning, apart best (by the mean of both rates of right answers; of
    equal ones the nearest to 0).

    Urls are counted and ranked by Spark. The driver and every task hold the models: a count
    for each distinct string of ``order + 1`` bytes, of which there are far fewer than urls.

    If rules allow none, all others are blocked; if they block none, allowed; so they are
    if no rule fits any. A null or empty url scores 0. Repeated rows get equal answers;
    other columns are left out, whatever their names. No rows give no rows.
    """
    host, path = split_url(F.col(url))
    given = pages.select(
        F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), host.alias("host"), path.alias("path")
    ).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    decided = given.where(F.col("fit").isNotNull()).select(F.col("fit.verdict").alias("verdict"), "url")
    if sample_urls is None:
        known = decided.distinct().withColumn("hash", F.xxhash64("url"))
    else:
        known = distinct_by_hash(decided, "url", sample_urls, "verdict")
    known = stored(known.select("verdict", "url", (F.col("hash") % 5 == 0).alias("out")), "urls")
    numbers = {r["verdict"]: r for r in known.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("out").alias("out")).collect()}
    if len(numbers) < 2:
        scored = given.withColumn("score", F.lit(0.0)).withColumn("judged", F.lit(BLOCK if BLOCK in numbers else ALLOW))
    else:
        # Where a fifth is none or all of them, all teach or are kept out too.
        all_out = [v for v, r in numbers.items() if r["out"] == r["n"]]
        none_out = [v for v, r in numbers.items() if not r["out"]]
        trees = _learn(known.where(~F.col("out") | F.col("verdict").isin(all_out)), order)
        model = pages.sparkSession.sparkContext.broadcast(cloudpickle.dumps(trees))
        threshold = _threshold(known.where(F.col("out") | F.col("verdict").isin(none_out)), model)
        scored = given.withColumn("score", arrow_column(_scorer(model), "double", F.col("url"))).withColumn(
            "judged", F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK)
        )
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "judged").alias("verdict"),
        "score",
    )


def _learn(urls: DataFrame, order: int) -> Trees:
    """The trees of the urls of each verdict, whose strings are counted where they lie and summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for verdict in (ALLOW, BLOCK):
                held = batch["url"].filter(pa.compute.equal(batch["verdict"], verdict)).cast(pa.binary())
                strings, n = count_strings(iter(held.to_pylist()), order)
                columns = [pa.array([verdict] * len(n), pa.string()), pa.array(strings.view(np.int64)), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["verdict", "string", "n"])

    counted = map_arrow(urls.select("verdict", "url"), count, "verdict string, string long, n long")
    model = counted.groupBy("verdict", "string").agg(F.sum("n").alias("n")).toArrow()
    counts = []
    for verdict in (ALLOW, BLOCK):
        own = model.filter(pa.compute.equal(model["verdict"], verdict))
        counts.append((own["string"].to_numpy().view(np.uint64), own["n"].to_numpy()))
    return build(counts, order)


def _threshold(urls: DataFrame, model) -> float:
    """The score from which on a url is allowed.

    Scores are sorted over all tasks, and each range is told how many of either verdict, and
    which score, lie before it. Between two neighbours all thresholds are alike: the middle
    and the upper end are tried, as are one below the first and one above the last.
    """
    good, bad = (F.count_if(F.col("verdict") == v) for v in (ALLOW, BLOCK))
    score = arrow_column(_scorer(model), "double", F.col("url"))
    zero = urls.sparkSession.range(1).select(F.lit("none").alias("verdict"), F.lit(0.0).alias("score"))
    found = urls.select("verdict", score.alias("score")).union(zero).groupBy("score").agg(good.alias("good"), bad.alias("bad"))
    ranged = stored(found.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    parts = ranged.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last"))
    # A row for each range: few.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("good").over(earlier), F.lit(0)).alias("good_before"),
        F.coalesce(F.sum("bad").over(earlier), F.lit(0)).alias("bad_before"),
        F.max("last").over(earlier).alias("score_before"),
    )
    n = urls.agg(good.alias("good"), bad.alias("bad")).first()
    along = Window.partitionBy("part").orderBy("score")
    below = along.rowsBetween(Window.unboundedPreceding, -1)
    good_below = F.coalesce(F.sum("good").over(below), F.lit(0)) + F.col("good_before")
    bad_below = F.coalesce(F.sum("bad").over(below), F.lit(0)) + F.col("bad_before")
    before = F.coalesce(F.lag("score").over(along), F.col("score_before"))
    middle = F.coalesce((F.col("score") + before) / 2, F.col("score") - 1)
    ends = F.array(F.struct(F.lit(0).alias("kind"), middle.alias("at")), F.struct(F.lit(1).alias("kind"), F.col("score").alias("at")))
    right = (n["good"] - good_below) / F.lit(float(n["good"])) + bad_below / F.lit(float(n["bad"]))
    told = ranged.join(F.broadcast(offsets), "part").select(right.alias("right"), ends.alias("ends"))
    tried = told.select("right", F.explode("ends").alias("end"))
    beyond = parts.agg((F.max("last") + 1).alias("at")).select(
        F.lit(1.0).alias("right"), F.struct(F.lit(2).alias("kind"), F.col("at")).alias("end")
    )
    best = tried.union(beyond).orderBy(F.desc("right"), F.abs("end.at"), "end.kind", "end.at").first()
    return best["end"]["at"]


def _scores(trees: Trees, urls: list[bytes]) -> np.ndarray:
    text, starts = padded(urls, trees.order)
    bits = trees.code_lengths(text, starts)
    return (bits[:, 1] - bits[:, 0]) / np.maximum(1, [len(u) for u in urls])


def _scorer(model):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = pickle.loads(model.value)
        for urls in batches:
            found = [np.zeros(0)]
            for low, high in text_slices(urls):
                found.append(_scores(trees, urls.slice(low, high - low).cast(pa.binary()).to_pylist()))
            yield pa.array(np.concatenate(found))

    return score
