"""Conversations repaired to alternating turns at least cost (operator 11)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import map_arrow, stored
from pagelore.llm.turn_alignment import BLOCK, best_repair, block_table, edits, path

# White space, and what a whole text ends with.
_WHITE = " \t\n\x0b\x0c\r"
_ENDS = ".!?"
_NAMES = {"u": "user", "a": "assistant"}

_FOUND = (
    "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"
)
_PAIRS = frozenset(("su", "ua", "au"))


def damage(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Turns ``conv_id, turn, role, text`` with reproducible faults; a null role or text is one space.

    The crc32 of ``conv_id:turn`` (null: one space), by 20, decides: 0 drops a row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role ``user``.
    """
    space = F.lit(" ")
    key = F.concat(*(F.coalesce(c.cast("string"), space) for c in (F.col(conv_id),)), F.lit(":"),
                   F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    given = F.coalesce(F.col(text), space)
    return conversations.where(kind != 0).select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(given, _ENDS, "")).otherwise(given).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    most_turns: int = 4096,
    most_bytes: int = 8 << 20,
) -> DataFrame:
    """Repaired turns and audits: rows ``conv_id, place, edit, role, text, found``.

    Turns are taken in order of ``turn`` (nulls first; equal ones by role and text). A turn's
    first fault counts: blank (nothing but white space), duplicate (role and text of an
    earlier one), truncated (does not end with ``.!?``). Edits keep a turn (free), give it
    the role user or assistant (3), delete it (4; blank and duplicate ones must go) or insert
    an empty one of either role (3); a truncated turn that stays costs 3. The cheapest edits
    after which the role initials read ``(s?(ua)+)?`` are made; of equal ones those whose
    letters (``audit``) come first in ASCII order.

    A conversation's rows lie together, in order of ``place``: at 0 ``found`` tells gaps
    (turn numbers missing between least and greatest), faults, illegal (neighbours that are
    not su, ua or au), cost and audit; the others are the repaired turns, with ``edit`` and
    their letter's place in the audit. Null roles and texts are empty, a null ``conv_id`` is a
    conversation, repeated rows are duplicates. Other columns are left out, whatever their
    names. No rows give no rows.

    A conversation is held by one task if it has at most ``most_turns`` turns and
    ``most_bytes`` of text. Larger ones are cut into blocks, which are dealt out and aligned
    from each state to each state; one task then chooses a path through them, without texts.
    """
    kind = turns.schema[conv_id].dataType.simpleString()
    given = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    size = F.sum(F.octet_length("role") + F.octet_length("text"))
    large = given.groupBy("conv_id").agg(F.count("*").alias("n"), size.alias("size"))
    large = stored(large.where((F.col("n") > most_turns) | (F.col("size") > most_bytes)).select("conv_id", "n"), "large")
    schema = f"conv_id {kind}, place long, edit string, role string, text string, found {_FOUND}"
    if large.isEmpty():
        return _repair_whole(given, schema)
    large = large.withColumnRenamed("conv_id", "large_id")
    is_large = given["conv_id"].eqNullSafe(large["large_id"])
    small = given.join(large, is_large, "left_anti")
    return _repair_whole(small, schema).union(_repair_blocks(given.join(large, is_large).drop("large_id"), kind, schema))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, found`` of each conversation of ``repair``, and the hash of its ``role:text`` lines.

    A conversation streams by, however long it is.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = found = conv = None
        for batch in batches:
            ids, founds, hashes = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "found"))
            for here, place, role, text, about in zip(*columns, strict=True):
                if place:
                    running.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                    continue
                if running is not None:
                    ids.append(conv)
                    founds.append(found)
                    hashes.append(running.hexdigest())
                conv, found, running, first = here, about, hashlib.sha256(), True
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("conv_id").type),
                 pa.array(founds, batch.schema.field("found").type), pa.array(hashes, pa.string())],
                ["conv_id", "found", "repaired_sha256"],
            )
            last = batch.schema
        if running is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], last.field("conv_id").type), pa.array([found], last.field("found").type),
                 pa.array([running.hexdigest()], pa.string())],
                ["conv_id", "found", "repaired_sha256"],
            )

    return map_arrow(repaired, digest, f"conv_id {kind}, found {_FOUND}, repaired_sha256 string").select(
        "conv_id", "found.*", "repaired_sha256"
    )


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def _counts(codes: str) -> dict[str, int]:
    initials = codes[::2]
    return {
        "blank": codes[1::2].count("b"),
        "duplicate": codes[1::2].count("d"),
        "truncated": codes[1::2].count("t"),
        "illegal": sum(initials[i : i + 2] not in _PAIRS for i in range(len(initials) - 1)),
    }


def _repair_whole(turns: DataFrame, schema: str) -> DataFrame:
    """Each conversation in the task that holds it."""

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, kinds = [], [], 0, None
        for batch in batches:
            kinds = batch.schema.field("conv_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += _edited(held)
                    held = []
                    if size > 1 << 20:
                        yield _rows(out, kinds)
                        out, size = [], 0
                held.append(row)
                size += len(row[3]) + 100
        if held:
            out += _edited(held)
        if out:
            yield _rows(out, kinds)

    near = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(near.select("conv_id", "turn", "role", "text"), repaired, schema)


def _edited(held: list[tuple]) -> list[tuple]:
    """The rows of ``repair`` of one conversation's turns in order."""
    seen, codes = set(), []
    for _, _, role, text in held:
        end = text.rstrip(_WHITE)[-1:]
        fault = "b" if not end else "d" if (role, text) in seen else "-" if end in _ENDS else "t"
        seen.add((role, text))
        codes.append(_initial(role) + fault)
    codes = "".join(codes)
    cost, audit = best_repair(codes)
    conv = held[0][0]
    numbers = {turn for _, turn, _, _ in held if turn is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    rows = [(conv, 0, None, None, None, {"gaps": gaps, **_counts(codes), "cost": cost, "audit": audit})]
    at = 0
    for place, (letter, initial, _) in enumerate(edits(audit, codes, 0), 1):
        if letter == "I":
            rows.append((conv, place, letter, _NAMES[initial], "", None))
            continue
        if letter != "D":
            role = held[at][2] if letter == "K" else _NAMES[initial]
            rows.append((conv, place, letter, role, held[at][3], None))
        at += 1
    return rows


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = pa.struct([(n, pa.int64()) for n in names] + [("audit", pa.string())])
    kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), found)
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "edit", "role", "text", "found"])


def _fault() -> Column:
    """A turn's own code; whether it is a duplicate is told from outside, in column ``again``."""
    initial = F.substring("role", 1, 1)
    end = F.right(F.rtrim(F.col("text"), F.lit(_WHITE)), F.lit(1))
    return F.concat(
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
        F.when(end == "", "b").when(F.col("again"), "d").when(F.instr(F.lit(_ENDS), end) > 0, "-").otherwise("t"),
    )


def _repair_blocks(turns: DataFrame, kind: str, schema: str) -> DataFrame:
    """Large conversations (``n`` turns each): sorted and numbered over all tasks, aligned in blocks."""
    order = ["conv_id", "turn", "role", "text"]
    ranged = stored(
        turns.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        "ranged",
    )
    starts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("m"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col("conv_id").alias("id"), F.col("part").alias("in"), "first", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before")
    )
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    placed = stored(
        ranged.join(starts, ranged["conv_id"].eqNullSafe(starts["id"]) & (ranged["part"] == starts["in"])).select(
            *order, "n", (F.col("at") - F.col("first") + F.col("before")).alias("number"), digest.alias("digest")
        ),
        "placed",
    )
    twice = placed.groupBy("conv_id", "digest").agg(F.min("number").alias("once"), F.count("*").alias("m"))
    twice = twice.where("m > 1").select(F.col("conv_id").alias("id"), F.col("digest").alias("key"), "once")
    same = placed["conv_id"].eqNullSafe(twice["id"]) & (placed["digest"] == twice["key"])
    codes = placed.join(twice, same, "left").withColumn("again", F.coalesce(F.col("number") > F.col("once"), F.lit(False)))
    codes = codes.select(
        "conv_id", "n", "number", F.floor(F.col("number") / BLOCK).alias("block"), _fault().alias("code")
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def told() -> tuple:
            conv, n, _, block, _ = held[0]
            text = "".join(row[4] for row in held)
            table = block_table(text, (block + 1) * BLOCK >= n)
            return conv, block, text, json.dumps([sorted((q, *way) for q, way in t.items()) for t in table])

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0], held[0][3]) != (row[0], row[3]):
                    out.append(told())
                    held = []
                held.append(row)
            yield _told(out, batch)
            last = batch
        if held:
            yield _told([told()], last)

    def _told(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "block", "codes", "ways"]
        )

    dealt = codes.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "number")
    blocks = map_arrow(dealt, align, f"conv_id {kind}, block long, codes string, ways string")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            kinds = batch.schema.field("conv_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield from _chosen(held, kinds)
                    held = []
                held.append(row)
        if held:
            yield from _chosen(held, kinds)

    along = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    chosen = stored(
        map_arrow(along, choose, f"conv_id {kind}, place long, number long, edit string, role string, found {_FOUND}"),
        "chosen",
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    numbers = placed.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"))
    heads = chosen.where("place = 0").drop("number", "edit", "role")
    heads = heads.join(numbers.withColumnRenamed("conv_id", "id"), heads["conv_id"].eqNullSafe(F.col("id"))).select(
        "conv_id", "place", F.lit(None).cast("string").alias("edit"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.col("found").withField("gaps", F.col("gaps")).alias("found"),
    )
    edited = chosen.where("place > 0").alias("e")
    texts = placed.select(F.col("conv_id").alias("id"), F.col("number").alias("no"), F.col("role").alias("own"), "text")
    edited = edited.join(
        texts, F.col("e.conv_id").eqNullSafe(F.col("id")) & (F.col("e.number") == F.col("no")), "left"
    ).select(
        "conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("own")).otherwise(F.col("role")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), "found",
    )
    whole = heads.union(edited).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return whole.to(whole.sparkSession.createDataFrame([], schema).schema)


def _chosen(held: list[tuple], kind: pa.DataType, at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows of one large conversation without its texts; ``number`` is the turn that a letter stands for."""
    tables = [[{q: (c, a) for q, c, a in table} for table in json.loads(ways)] for _, _, _, ways in held]
    cost, audits = path(tables)
    found = {"gaps": 0, "cost": cost, "audit": "".join(audit for _, audit in audits)}
    total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    previous = ""
    for _, _, codes, _ in held:
        for name, n in _counts(codes).items():
            total[name] += n
        total["illegal"] += bool(previous) and previous + codes[0] not in _PAIRS
        previous = codes[-2]
    conv, place, number = held[0][0], 0, 0
    rows = [(conv, 0, None, None, None, found | total)]
    for (_, _, codes, _), (state, audit) in zip(held, audits, strict=True):
        for letter, initial, _ in edits(audit, codes, state):
            place += 1
            own = None if letter == "I" else number
            number += letter != "I"
            if letter != "D":
                rows.append((conv, place, own, letter, _NAMES.get(initial), None))
        if len(rows) >= at_once:
            yield _chosen_rows(rows, kind)
            rows = []
    if rows:
        yield _chosen_rows(rows, kind)


def _chosen_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    as_turns = _rows([(r[0], r[1], r[3], r[4], None, r[5]) for r in rows], kind)
    numbers = pa.array([r[2] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays(
        [as_turns["conv_id"], as_turns["place"], numbers, as_turns["edit"], as_turns["role"], as_turns["found"]],
        ["conv_id", "place", "number", "edit", "role", "found"],
    )
