import pytest
from pyspark.sql import functions as F

from pagelore.operators.conversation import nest_turns
from pagelore.operators.embed import HashedWords
from pagelore.plans.ask import ask
from pagelore.plans.dataset import build_points
from pagelore.plans.followup import follow_up_nested, to_chat_responses
from pagelore.sources.points import read_points
from pagelore.sources.requests import parse_requests, to_responses
from pagelore.streaming.jobs import stream_ask, stream_follow_up

EMBEDDER = HashedWords(16)
OPTIONS = {"embedder": EMBEDDER, "dim": 16, "system_text": "SYS"}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "points")
    pages = [(i, f"Page {i}", f"word{i} shared text") for i in range(6)]
    build_points(spark.createDataFrame(pages, "page_id int, title string, content string"), path, EMBEDDER, 16)
    return path


def lines(spark, tmp_path, name, ids):
    (tmp_path / "in").mkdir(exist_ok=True)
    text = "\n".join(f'{{"requestId":"r{i}","prompt":"word{i} ?","maxContextLength":{i}}}' for i in ids)
    (tmp_path / "in" / name).write_text(text + "\n")


def test_stream_of_questions_equals_batch(spark, tmp_path, table):
    completions = spark.createDataFrame([(f"r{i}", f" a{i} ") for i in range(6)], "request_id string, completion string")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        source = parse_requests(spark.readStream.text(str(tmp_path / "in")))
        stream_ask(
            source, lambda s: read_points(s, table), out, progress, "v", completions=completions, **OPTIONS
        ).awaitTermination()

    lines(spark, tmp_path, "1.json", [0, 1, 2])
    run()
    lines(spark, tmp_path, "2.json", [3, 4])
    run()
    run()  # nothing new: nothing written
    got = spark.read.parquet(out)
    assert sorted(r.batch_id for r in got.select("batch_id").distinct().collect()) == [0, 1]
    requests = parse_requests(spark.read.text(str(tmp_path / "in")))
    want = to_responses(ask(requests, read_points(spark, table), completions=completions, **OPTIONS), "v")
    columns = [c for c in want.columns if c != "duration"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.where("duration is null").count() == 0
    # A batch that runs again replaces its own output.
    before = got.count()
    (tmp_path / "progress" / "commits" / "1").unlink()
    (tmp_path / "progress" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert spark.read.parquet(out).count() == before


def test_stream_of_conversations_equals_batch(spark, tmp_path, table):
    turns = spark.createDataFrame(
        [(1, 0, "user", "word1 ?"), (1, 1, "assistant", "yes"), (2, 0, "user", "word2 ?"), (3, 0, "assistant", "x")],
        "conv_id int, turn bigint, role string, text string",
    )
    replies = spark.createDataFrame([(1, "a"), (2, "b")], "conv_id int, completion string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    nest_turns(turns).write.parquet(source)
    payloads = spark.read.parquet(source)
    stream = spark.readStream.schema(payloads.schema).parquet(source)
    stream_follow_up(
        stream, lambda s: read_points(s, table), out, str(tmp_path / "progress"), "v", completions=replies, **OPTIONS
    ).awaitTermination()
    want = to_chat_responses(
        follow_up_nested(payloads, read_points(spark, table), completions=replies, **OPTIONS), "v"
    )
    key = F.to_json(F.struct(*want.columns))
    got = spark.read.parquet(out)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in want.select(key).collect())
    assert {r.conv_id: r.reason for r in got.collect()} == {1: None, 2: None, 3: "no_user_turn"}
