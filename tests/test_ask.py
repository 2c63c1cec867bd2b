import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagelore.functions.names import clean_username, pseudonym
from pagelore.operators.checks import split_outcome, validate
from pagelore.operators.embed import HashedWords
from pagelore.operators.moderate import gate
from pagelore.operators.prompts import messages
from pagelore.plans.ask import ask, prepare
from pagelore.sources.requests import (
    parse_requests,
    read_requests,
    to_responses,
    write_answer_lines,
    write_answers,
)

REQUEST = "request_id int, prompt string, username string, max_length int, max_context_length bigint"
EMBEDDER = HashedWords(16)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def points(spark):
    rows = [(f"p{i}", f"Page {i}", text) for i, text in enumerate(["life meaning", "space ships", "life in space"])]
    frame = spark.createDataFrame(rows, "id string, title string, content string")
    vectors = {r[0]: [float(x) for x in EMBEDDER._unit_counts([r[2]])[0]] for r in rows}
    embedded = spark.createDataFrame(list(vectors.items()), "id string, embedding array<float>")
    return frame.join(embedded, "id")


def requests(spark, *rows):
    return read_requests(spark.createDataFrame(list(rows), REQUEST))


def answer_all(frame):
    return [" goofy answer \n" for _ in range(len(frame))]


def run(spark, points, *rows, **options):
    options = {"completions": answer_all, "embedder": EMBEDDER, "dim": 16, "system_text": "SYS"} | options
    return {r.request_id: r for r in ask(requests(spark, *rows), points, **options).collect()}


def test_answers_a_question(spark, points):
    with pytest.warns(UserWarning, match="no moderation"):
        got = run(spark, points, (1, "meaning of life", "someone", 100, None))[1]
    assert got.status == "ok"
    assert got.completion.strip() and got.response_tokens > 0
    assert got.question_tokens == 3
    assert got.context.startswith("Page: Page 0\nContent: life meaning\n\n\n###")
    assert not got.input_moderated and not got.output_moderated


def test_rejections(spark, points):
    flag_all = spark.createDataFrame([(3, True), (3, False), (4, False)], "request_id int, flagged boolean")
    rude = spark.createDataFrame([(4, True)], "request_id int, flagged boolean")
    got = run(
        spark, points,
        (1, " ", None, None, None), (2, "q", None, 0, None), (3, "q", None, None, None),
        (4, "q", None, None, None), (5, "q", None, None, None), (6, None, None, None, None),
        input_verdicts=flag_all, output_verdicts=rude,
    )
    assert {i: r.reason for i, r in got.items()} == {
        1: "blank_question", 2: "zero_max_tokens", 3: "flagged_input", 4: "flagged_output", 5: None, 6: "blank_question"
    }
    assert got[1].error == "The question cannot be empty."
    assert got[3].error == got[4].error == "The question was flagged by the moderation API"
    assert got[4].input_moderated and not got[5].input_moderated
    assert got[3].completion is None and got[3].context is None


def test_moderator_function_is_asked_once_per_open_request(spark, points, tmp_path):
    log = str(tmp_path / "calls")

    def moderator(texts):
        with open(log, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return [t == "bad" for t in texts]

    got = run(
        spark, points, (1, "bad", None, None, None), (2, "good", None, None, None), (3, "zero", None, 0, None),
        input_verdicts=moderator, output_verdicts=spark.createDataFrame([], "request_id int, flagged boolean"),
    )
    assert {i: r.reason for i, r in got.items()} == {1: "flagged_input", 2: None, 3: "zero_max_tokens"}
    assert sorted(open(log).read().split()) == ["bad", "good"]


def test_gate_keeps_an_earlier_rejection(spark):
    checked = validate(requests(spark, (1, "", None, None, None)))
    flagged = spark.createDataFrame([(1, True)], "request_id int, flagged boolean")
    assert gate(checked, flagged, "request_id", "prompt").first().reason == "blank_question"
    ok, rejects = split_outcome(checked)
    assert (ok.count(), rejects.count()) == (0, 1)


def test_context_length(spark, points):
    got = run(
        spark, points,
        (1, "life", None, None, 0), (2, "life", None, None, 1), (3, "life", None, None, None), (4, "", None, None, 2),
    )
    assert [got[i].context if got[i].context is None else got[i].context.count("Page: ") for i in (1, 2, 3, 4)] == [
        0, 1, 3, None
    ]
    assert got[1].context == ""


def test_any_number_of_pages(spark, points):
    asked = requests(spark, (1, "life", None, None, 2**62), (2, "life", None, None, 10_001), (3, "life", None, None, 2))
    got = {r.request_id: r for r in prepare(asked, points, EMBEDDER, 16).collect()}
    assert all(r.status == "ok" for r in got.values())
    assert [got[i].context.count("Page: ") for i in (1, 2, 3)] == [3, 3, 2]


def test_missing_completion_is_a_rejection(spark, points):
    table = spark.createDataFrame([(1, "yes")], "request_id int, completion string")
    got = run(spark, points, (1, "a", None, None, None), (2, "b", None, None, None), completions=table)
    assert (got[1].reason, got[2].reason) == (None, "no_completion")


def test_completer_sees_messages_and_model(spark, points):
    def echo(frame):
        return [json.dumps([json.loads(m), model, limit]) for m, model, limit in frame.itertuples(index=False)]

    got = json.loads(run(spark, points, (1, "life", "Al x", 7, 1), completions=echo)[1].completion)
    system, user = got[0]
    assert system == {"role": "system", "text": "SYS"}
    assert user["text"] == (
        "Information:\nPage: Page 0\nContent: life meaning\n\n\n###\n\n\n---\n\n\nQuestion: life\nUsername: Al\n"
    )
    assert user["participant"] == hashlib.sha256(b"Al").hexdigest().upper()
    assert got[1:] == ["gpt-4o-mini", 7]


def test_message_table(spark, points):
    prepared = prepare(requests(spark, (1, "life", None, None, 0), (2, "", None, None, 0)), points, EMBEDDER, 16)
    got = [tuple(r) for r in messages(prepared, "SYS").orderBy("position").collect()]
    assert got == [
        (1, 0, "system", "SYS", None),
        (1, 1, "user", "Information:\n\n\n\n---\n\n\nQuestion: life\nUsername: N/A\n", None),
    ]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("user-1_x y", "user-1_x"), ("!!ab cd", "ab"), ("?!", ""), ("  ", "  "), ("", ""), (None, None), ("é1", "1")],
)
def test_usernames(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "u string")
    name, code = frame.select(clean_username(F.col("u")), pseudonym(clean_username(F.col("u")))).first()
    assert name == want
    assert code == (None if want is None else hashlib.sha256(want.encode()).hexdigest().upper())


def test_request_lines(spark):
    lines = [
        '{"requestId":"a","prompt":"q"}',
        '{"request_id":"b","Prompt":"q","model":null,"userName":"u","maxLength":"3","MaxContextLength":18446744073709551615}',
        '{"requestId":"c","prompt":"q","maxLength":"x"}',
        '{"requestId":"d","prompt":"q","maxContextLength":-1}',
        '{"requestId":"e","prompt":"q","maxLength":1.5}',
        '{"prompt":"q"}',
        "no json",
        '{"requestId":"g","prompt":"first","PROMPT":"last","maxContextLength":0}',
    ]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [tuple(r) for r in parse_requests(frame).collect()]
    assert got[0] == ("a", "q", "gpt-4o-mini", None, None, 5, False)
    assert got[1] == ("b", "q", "gpt-4o-mini", "u", 3, 2**63 - 1, False)
    assert [r[-1] for r in got] == [False, False, True, True, True, True, True, False]
    assert got[7][1] == "last" and got[7][5] == 0
    assert validate(parse_requests(frame)).where("reason = 'malformed_request'").count() == 5


def test_responses(spark, points, tmp_path):
    answered = ask(
        requests(spark, (1, "life", None, None, 1), (2, "", None, None, 1)), points,
        completions=answer_all, embedder=EMBEDDER, dim=16, system_text="SYS",
    )
    responses = to_responses(answered, "v9", started_ms=0)
    assert all(t == "string" for n, t in responses.dtypes if n != "request_id")
    write_answers(responses, str(tmp_path / "a"))
    ok, bad = spark.read.parquet(str(tmp_path / "a")).orderBy("request_id").collect()
    assert (ok.answer, ok.version, ok.question_tokens) == ("goofy answer", "v9", "1")
    assert ok.response_tokens == "3"  # " goofy", " answer", " \n": counted before trimming
    assert int(ok.duration) > 0
    assert bad.answer is None and bad.duration is None and bad.reason == "blank_question"
    write_answer_lines(responses, str(tmp_path / "lines"))
    line = json.loads(spark.read.text(str(tmp_path / "lines")).where("value like '%goofy%'").first()[0])
    assert line["question_tokens"] == "1" and line["status"] == "ok"


def test_batches_for_a_moderator_are_bounded_in_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 1000, 1, 1).select(
        F.col("id").alias("request_id"), F.repeat(F.lit("ab "), 7000).alias("prompt"), F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error"),
    )
    sizes = gate(rows, lambda texts: [texts.str.len().sum() > 6 << 20] * len(texts), "request_id", "prompt")
    assert sizes.where("status = 'ok'").count() == 1000
