import pytest
from pyspark.sql import functions as F

from pagelore.operators.conversation import (
    append_reply,
    explode_turns,
    known_roles,
    last_user_turn,
    nest_turns,
    rewrite_followup,
)
from pagelore.operators.embed import HashedWords
from pagelore.plans.followup import follow_up, follow_up_nested, to_chat_responses
from pagelore.sources.requests import parse_conversations

TURN = "conv_id int, turn bigint, role string, text string"
EMBEDDER = HashedWords(16)
CONVERSATIONS = [
    (1, 0, "user", "first question"),
    (1, 1, "assistant", "first answer"),
    (1, 2, "user", "second question"),
    # Ends with an assistant turn, has a system turn and a role nobody knows.
    (2, 0, "system", "client system"),
    (2, 1, "user", "only question"),
    (2, 2, "tool", "noise"),
    (2, 3, "assistant", "an answer"),
    # Nobody asks.
    (3, 0, "assistant", "hello"),
    (4, 0, "user", " \n"),
    (5, 0, "user", "flagged question"),
    (6, 0, "user", "unanswered question"),
    (7, 0, "user", "rude answer"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(CONVERSATIONS, TURN)


@pytest.fixture(scope="module")
def options(spark):
    vector = [float(x) for x in EMBEDDER._unit_counts(["second only flagged"])[0]]
    points = spark.createDataFrame(
        [("p", "T", "C", vector)], "id string, title string, content string, embedding array<float>"
    )
    return {
        "points": points,
        "embedder": EMBEDDER,
        "dim": 16,
        "system_text": "SYS",
        "completions": spark.createDataFrame(
            [(i, f" reply {i} ") for i in (1, 2, 3, 4, 5, 7)], "conv_id int, completion string"
        ),
        "input_verdicts": spark.createDataFrame([(5, True), (1, False)], "conv_id int, flagged boolean"),
        "output_verdicts": spark.createDataFrame([(7, True)], "conv_id int, flagged boolean"),
    }


CONTEXT = "Page: T\nContent: C\n\n\n###"
WANT = {
    1: [
        ("system", "SYS"),
        ("user", "first question"),
        ("assistant", "first answer"),
        ("user", f"Question: second question\n\nInformation:\n{CONTEXT}"),
        ("assistant", " reply 1 "),
    ],
    2: [
        ("system", "SYS"),
        ("system", "client system"),
        ("assistant", "an answer"),
        ("user", f"Question: only question\n\nInformation:\n{CONTEXT}"),
        ("assistant", " reply 2 "),
    ],
}
REASONS = {
    1: None, 2: None, 3: "no_user_turn", 4: "blank_question", 5: "flagged_input", 6: "no_completion", 7: "flagged_output"
}


def test_rows(turns, options):
    result = follow_up(turns, **options)
    got = {}
    for r in result.turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == WANT
    assert {r.conv_id: r.reason for r in result.outcomes.collect()} == REASONS


def test_payloads(turns, options):
    answered = follow_up_nested(nest_turns(turns), **options).collect()
    assert {r.conv_id: r.reason for r in answered} == REASONS
    assert {
        r.conv_id: [(m.role, m.message) for m in r.conversation] for r in answered if r.conversation is not None
    } == WANT


@pytest.mark.parametrize("moderator", [False, True])
def test_nothing_is_retrieved_for_rejected_payloads(turns, options, tmp_path, moderator):
    asked, judged = tmp_path / "asked", tmp_path / "judged"

    def embedder(texts):
        with open(asked, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return EMBEDDER(texts)

    def verdicts(texts):
        with open(judged, "a") as out:
            out.writelines(f"{t.strip()}\n" for t in texts)
        return [t == " reply 7 " for t in texts]

    mine = options | {"embedder": embedder} | ({"output_verdicts": verdicts} if moderator else {})
    answered = follow_up_nested(nest_turns(turns), **mine).collect()
    assert {r.conv_id: r.reason for r in answered} == REASONS
    assert {r.conv_id: [(m.role, m.message) for m in r.conversation] for r in answered if r.status == "ok"} == WANT
    # Neither the unanswered nor the rude one is looked up.
    assert sorted(asked.read_text().splitlines()) == ["only question", "second question"]
    if moderator:
        assert sorted(judged.read_text().splitlines()) == ["reply 1", "reply 2", "reply 7"]


def test_one_system_message_and_a_completer_function(spark, turns, options):
    def completer(frame):
        return ["done"] * len(frame)

    mine = nest_turns(turns.where("conv_id = 1"))
    answered = follow_up_nested(mine, **(options | {"completions": completer, "input_verdicts": None}))
    response = to_chat_responses(answered, "v").first()
    roles = [m.role for m in response.conversation]
    assert roles.count("system") == 1 and "user" in roles and roles[-1] == "assistant"
    assert response.version == "v" and response.question_tokens is None and response.response_tokens is None


def test_payload_lines(spark, options):
    lines = [
        '{"conversationId":"a","conversation":[{"role":"user","message":"second only flagged"}],"model":"m"}',
        '{"conversationId":"b","conversation":[]}',
        '{"conversationId":"c"}',
        "no json",
    ]
    read = parse_conversations(spark.createDataFrame([(x,) for x in lines], "value string"))
    completions = spark.createDataFrame([("a", "R")], "conv_id string, completion string")
    mine = options | {"completions": completions, "input_verdicts": None, "output_verdicts": None}
    got = {r.conv_id: r for r in follow_up_nested(read, **mine).collect()}
    assert {i: r.reason for i, r in got.items()} == {
        "a": None, "b": "no_user_turn", "c": "malformed_request", None: "malformed_request"
    }
    assert [m.role for m in got["a"].conversation] == ["system", "user", "assistant"]


def test_nest_and_explode(turns):
    back = explode_turns(nest_turns(turns))
    assert {tuple(r) for r in back.collect()} == set(CONVERSATIONS)


def test_known_roles(turns):
    assert turns.count() - known_roles(turns).count() == 1


def test_last_user_turn(turns):
    got = {r.conv_id: (r.turn, r.text, r.status) for r in last_user_turn(turns).collect()}
    assert got[1] == (2, "second question", "ok")
    assert got[2] == (1, "only question", "ok")
    assert got[3] == (None, None, "no_user_turn")


def test_rewrite_and_reply(spark, turns):
    contexts = spark.createDataFrame([(1, "CTX")], "conv_id int, context string")
    one = rewrite_followup(turns.where("conv_id = 1"), contexts, "SYS")
    replies = spark.createDataFrame([(1, "R")], "conv_id int, completion string")
    got = [(r.role, r.text) for r in append_reply(one, replies).orderBy("turn").collect()]
    assert got == [
        ("system", "SYS"),
        ("user", "first question"),
        ("assistant", "first answer"),
        ("user", "Question: second question\n\nInformation:\nCTX"),
        ("assistant", "R"),
    ]


def test_one_conversation_with_most_turns(spark, options):
    long = spark.range(20_000).select(
        F.lit(1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    turns = long.unionByName(long.where("turn < 2").withColumn("conv_id", F.lit(2)))
    result = follow_up(turns, **options).turns
    assert {tuple(r) for r in result.groupBy("conv_id").count().collect()} == {(1, 20_002), (2, 4)}
    asked = result.where("conv_id = 1 and turn = 20000").first()
    assert asked.text.startswith("Question: t19998\n")


def test_no_conversation_is_lost(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (2, 0, "narrator", "x"), (3, 0, "system", "s")], "conv_id int, turn long, role string, text string"
    )
    got = {r.conv_id: r.status for r in last_user_turn(turns).collect()}
    assert got == {1: "ok", 2: "no_user_turn", 3: "no_user_turn"}


def test_empty_payloads_come_back(spark):
    payloads = spark.createDataFrame(
        [(1, [("user", "q")]), (2, []), (3, None)], "conv_id int, conversation array<struct<role:string,message:string>>"
    )
    rows = explode_turns(payloads)
    assert sorted((r.conv_id, r.turn) for r in rows.collect()) == [(1, 0), (2, None), (3, None)]
    assert {r.conv_id: len(r.conversation) for r in nest_turns(rows).collect()} == {1: 1, 2: 0, 3: 0}


def test_turn_rows_and_a_completer(turns, options, spark, tmp_path):
    log = str(tmp_path / "calls")

    def completer(asked):
        import json

        with open(log, "a") as out:
            out.writelines("x\n" for _ in range(len(asked)))
        for row in asked.itertuples():
            said = json.loads(row.messages)
            yield f"{said[0]['role']} {len(said)} {said[-1]['text'][:12]} {int(row.max_length)} {row.model}"

    limits = spark.createDataFrame([(1, 9, "m"), (1, 9, "m"), (2, 8, "n"), (6, 0, "m"), (7, 7, "m")], "conv_id int, max_length int, model string")
    found = follow_up(turns, **options | {"completions": completer}, limits=limits)
    outcomes = {r.conv_id: r.reason for r in found.outcomes.collect()}
    assert outcomes == {1: None, 2: None, 3: "no_user_turn", 4: "blank_question", 5: "flagged_input", 6: "zero_max_tokens", 7: "flagged_output"}
    last = {r.conv_id: r.text for r in found.turns.orderBy("turn").collect()}
    assert last == {1: "system 4 Question: se 9 m", 2: "system 4 Question: on 8 n"}
    assert found.turns.where("conv_id = 1").count() == 5
    # Asked once for each that passed the input gate, however often the result is read.
    assert len(open(log).readlines()) == 3
    assert CONTEXT in found.turns.where("conv_id = 1 and role = 'user'").orderBy(F.desc("turn")).first().text
