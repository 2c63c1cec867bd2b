"""Repaired conversations against a plain search over all edits."""

import hashlib
import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.llm.conversation_repair import damage, digests, repair
from pagelore.llm.turn_alignment import ASSISTANT, BLOCK, START, SYSTEM, USER, best_repair, repairs

SCHEMA = "conv_id long, turn long, role string, text string"


def every_way(turns, state=START, final=True):
    """The least ``(cost, audit)`` for each state, by walking all edits turn by turn."""

    def inserted(ways):
        for _ in range(3):
            for s, (cost, audit) in list(ways.items()):
                after = USER if s == ASSISTANT else ASSISTANT
                ways[after] = min(ways.get(after, (cost + 3, audit + "I")), (cost + 3, audit + "I"))
        return ways

    ways = {state: (0, "")}
    for role, fault in zip(turns[::2], turns[1::2]):
        found = []
        for s, (cost, audit) in inserted(ways).items():
            found.append((s, (cost + 4, audit + "D")))
            if fault in "bd":
                continue
            cost += 3 * (fault == "t")
            if role == "s" and s == START:
                found.append((SYSTEM, (cost, audit + "K")))
            wanted, after = ("a", USER) if s == ASSISTANT else ("u", ASSISTANT)
            found.append((after, (cost, audit + "K") if role == wanted else (cost + 3, audit + "R")))
        ways = {s: min(w for t, w in found if t == s) for s in {s for s, _ in found}}
    return inserted(ways) if final else ways


TURN = st.tuples(st.sampled_from("suax"), st.sampled_from("---tbd")).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=8), st.sampled_from([START, START, SYSTEM, USER, ASSISTANT]), st.booleans())
def test_bands_and_lengths_lose_nothing(turns, state, final):
    assert repairs("".join(turns), state, final) == every_way("".join(turns), state, final)


@settings(max_examples=10, deadline=None)
@given(st.lists(TURN, min_size=BLOCK - 1, max_size=3 * BLOCK))
def test_blocks_make_the_same_audit(turns):
    ways = every_way("".join(turns))
    assert best_repair("".join(turns)) == min(ways[s] for s in (START, USER) if s in ways)


def rows_of(spark, rows):
    # A column of a clashing name and one more that is left out.
    return spark.createDataFrame([(*r, "k", 0) for r in rows], SCHEMA + ", copy string, found int")


def told(frame):
    return {r.conv_id: r.asDict() for r in digests(frame).collect()}


def plain(rows):
    """Counts, cost, audit and hash of one conversation's rows."""
    rows = sorted(((t, r or "", x or "") for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    codes, seen = [], set()
    for _, role, text in rows:
        end = text.strip(" \t\n\v\f\r")[-1:]
        codes.append((role[:1] or " ") + ("b" if not end else "d" if (role, text) in seen else "-" if end in ".!?" else "t"))
        seen.add((role, text))
    pairs = [a[0] + b[0] for a, b in itertools.pairwise(codes)]
    ways = every_way("".join(c if c[0] in "sua" else "x" + c[1] for c in codes))
    cost, audit = min(ways[s] for s in (START, USER) if s in ways)
    lines, i, expected = [], 0, "user"
    for letter in audit:
        if letter != "D":
            role = rows[i][1] if letter == "K" else expected
            lines.append(f"{role}:{'' if letter == 'I' else rows[i][2]}")
            expected = "assistant" if role[:1] == "u" else "user"
        i += letter != "I"
    turns = {t for t, _, _ in rows if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{name: sum(c[1] == name[0] for c in codes) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "and then", " \t", "", None, "long " * rng.randint(1, 3000) + "."])
            rows += [(conv, rng.choice([turn, turn, turn + 3, None]), role, text)] * rng.choice([1, 1, 1, 2])
    rows += [(None, 5, "user", "Is this one?"), (None, None, "assistant", "It is.")]
    # One conversation holds more than a third of all rows.
    rows += [(99, i if i % 50 else None, rng.choice(["user", "assistant", "system"]), f"Turn {i % 150}" + rng.choice(".. ")) for i in range(230)]
    return rows


def test_any_number_of_insertions():
    """Two insertions cost what two new roles do and come first: the audit is as much longer as there are pairs."""
    for pairs in (3, 4, 6, 8):
        turns = "u-u-a-a-" * pairs
        assert repairs(turns)[USER] == every_way(turns)[USER] == (6 * pairs, "KIKKIK" * pairs)
    assert best_repair("u-u-a-a-" * 40) == (240, "KIKKIK" * 40)


def test_conversations_of_any_size(spark):
    rows = conversations()
    want = {c: {"conv_id": c, **plain([r for r in rows if r[0] == c])} for c in {r[0] for r in rows}}
    assert told(repair(rows_of(spark, rows))) == want
    # Cut into blocks wherever a conversation has more than two turns.
    assert told(repair(rows_of(spark, rows), most_turns=2)) == want
    assert told(repair(rows_of(spark, rows), most_bytes=64)) == want


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Who?"), (1, 2, "user", "Who?"), (1, 3, "tool", "me")]
    found = repair(rows_of(spark, rows)).orderBy("place").collect()
    assert found[0].found.audit == "KKDR" and found[0].found.cost == 10
    assert [(r.place, r.edit, r.role, r.text) for r in found[1:]] == [
        (1, "K", "system", "Be kind."), (2, "K", "user", "Who?"), (4, "R", "assistant", "me")
    ]


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(damage(empty)).collect() == [] and digests(repair(empty)).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b? c!") for c in range(60) for t in (0, 1, None)] + [(None, 3, None, None)]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "A b c" if text else " "}.get(kind, text or " ")
        want += [(conv, turn, "user" if kind == 4 else role or " ", text)] * {0: 0, 3: 2}.get(kind, 1)
    got = damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
