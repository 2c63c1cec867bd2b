"""Near-copies of texts by an LSH forest with exact confirmation (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import map_arrow, stored, text_slices
from pagelore.llm.components import components
from pagelore.llm.shingles import WordHashes, digest, hash_functions, min_labels, shingle_set, words_of
from pagelore.operators.lookup import lookup


@dataclass(frozen=True)
class Forest:
    """Shape of the forest.

    Each tree is an order of texts by their signatures of ``depth`` labels. Neighbours in it
    whose longest common prefix is ``least_depth`` labels or more are a region, and are
    compared; a region of more than ``region`` texts is only compared where prefixes are
    longer, as long as it takes for no more to share them. At similarity 0.8 a pair misses all
    ``trees`` at the least depth with probability (1 - 0.8^4)^24, about 3 in a million.
    Texts of crowded regions that did not turn out connected stand in ``more_trees`` others,
    at full depth: (1 - 0.8^8)^72, about 2 in a million. Regions that are crowded even there are
    dealt into blocks that meet, so nothing more is lost however large they are.

    Compared are sketches of ``sketch_bits`` bits; a pair goes on to confirmation if their
    agreement stands for a similarity of ``similarity - slack`` or more (four standard
    deviations).
    """

    trees: int = 24
    least_depth: int = 4
    depth: int = 8
    more_trees: int = 72
    region: int = 4096
    sketch_bits: int = 256
    slack: float = 0.15
    # A block of a candidate component has about so many texts and bytes of sets at most,
    # or one text; two blocks meet in a task.
    block: int = 512
    block_bytes: int = 8 << 20


def near_copies(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 4,
    percent: int = 80,
    forest: Forest = Forest(),
) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id, kept``, one per row of ``documents``.

    Texts are linked if ``100 * common >= percent * union`` of their sets of ``width``-word
    shingles; a component is what links connect, named by its smallest ``doc_id``, which
    alone is ``kept``.

    Texts of equal words are one class. Classes stand in the trees, sorted by signature; those
    with a common prefix whose sketches agree are joined to candidate components, and each
    candidate component is then solved exactly from the full sets. Large regions are compared
    at greater depths (see ``Forest``); large components are dealt into blocks of bounded size
    (see ``_meetings``), so nothing is lost however large they are.
    Pairs never become rows: a task passes on at most one row for each text it holds.

    A text that is null or has no word has no shingles and is linked with nothing; its
    component is its own ``doc_id``. Rows of one ``doc_id`` are one document and share a
    component if any of them is linked. A null ``doc_id`` is linked with nothing: its
    component is null and it is kept. Other columns are left out, whatever their names.
    No rows give no rows.
    """
    given = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(_signed(given, width, forest.trees * forest.depth, forest.sketch_bits), "signed")
    classes = stored(
        signed.where(F.col("n_shingles") > 0)
        .where(F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("labels").alias("labels"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    candidates = components(_candidates(given, classes, width, percent, forest))
    placed = components(_confirmed(given, signed, candidates, width, percent, forest))
    named = classes.join(placed.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    named = stored(named, "named")
    # Texts without shingles have a key of their own each: none is hot.
    key = F.coalesce("digest", F.col("doc_id").cast("string").cast("binary"))
    found = signed.select("doc_id", "n_shingles", key.alias("digest")).join(named, "digest", "left")
    by_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", by_id.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    forest: Forest = Forest(),
) -> DataFrame:
    """``documents`` with one of each component of near-copies, the one of smallest ``doc_id``; all columns stay.

    See ``near_copies``. Rows without an id, and texts without words, stay. Repeated rows
    of one id and text are reduced to one. Only ids are joined; no rows give no rows.
    """
    found = near_copies(documents, doc_id, text, width, percent, forest)
    found = stored(found.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(doc_id), "kept"), "kept")
    gone = stored(found.where(~F.col("kept")).select(doc_id).distinct(), "gone")
    repeated = stored(found.groupBy(doc_id).count().where(F.col("count") > 1).select(doc_id), "repeated")
    left = documents.join(gone, doc_id, "left_anti")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, doc_id, "left_semi").dropDuplicates([doc_id, text])
    return left.join(repeated, doc_id, "left_anti").unionByName(once)


def _signed(documents: DataFrame, width: int, n_labels: int, sketch_bits: int, seed: int = 9) -> DataFrame:
    functions = hash_functions(max(n_labels, sketch_bits), seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(1)
            for low, high in text_slices(texts):
                n, keys, labels, sketches = [], [], [], []
                for whole in texts.slice(low, high - low).to_pylist():
                    words = words_of(whole or "")
                    shingles = shingle_set(words, width, hashes)
                    n.append(len(shingles))
                    if not words:
                        keys.append(None)
                        labels.append(None)
                        sketches.append(None)
                        continue
                    found = min_labels(shingles, functions)
                    keys.append(digest(words))
                    labels.append(found[:n_labels].tobytes())
                    sketches.append(np.packbits((found[:sketch_bits] & 1).astype(bool)).tobytes())
                hashes.trim()
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(low, high - low),
                        "n_shingles": pa.array(n, pa.int64()),
                        "digest": pa.array(keys, pa.binary()),
                        "labels": pa.array(labels, pa.binary()),
                        "sketch": pa.array(sketches, pa.binary()),
                    }
                )

    return map_arrow(documents, sign, "doc_id long, n_shingles long, digest binary, labels binary, sketch binary")


def _candidates(given: DataFrame, classes: DataFrame, width: int, percent: int, forest: Forest) -> DataFrame:
    """Edges ``a, b`` whose components hold every pair that the forest brings together."""
    order = _orders(classes, forest.trees, forest.depth)
    regions, crowded = _regions(order, forest.least_depth, forest)
    edges = _agreeing(regions, percent, forest)
    if crowded is None:
        return edges
    placed = stored(components(edges), "placed")
    # What is in one component needs no more comparing; of the other crowds all texts do.
    members = order.join(crowded.select("crowd"), F.col("crowd") == _prefix(forest.least_depth)).select("crowd", "rep")
    parts = members.join(placed.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    ends = parts.groupBy("crowd").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    open_crowds = stored(ends.where("least < most").select("crowd"), "open")
    known = placed.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if open_crowds.isEmpty():
        return known
    left = stored(members.join(open_crowds, "crowd").select(F.col("rep").alias("doc_id")).distinct(), "left")
    again = _signed(lookup(given, left, "doc_id"), width, forest.more_trees * forest.depth, forest.sketch_bits, seed=10)
    again = stored(again.where(F.col("n_shingles") > 0).withColumnRenamed("doc_id", "rep"), "signed")
    order = _orders(again, forest.more_trees, forest.depth)
    regions, crowded = _regions(order, forest.depth, forest)
    more = stored(known.union(_agreeing(regions, percent, forest)), "edges")
    if crowded is None:
        return more
    placed = stored(components(more), "placed")
    dense = order.withColumn("crowd", _prefix(forest.depth)).join(crowded.select("crowd"), "crowd")
    dense = dense.select("crowd", "rep", "sketch").withColumn("weight", F.lit(1.0 / max(1, forest.region // 2)))
    meetings = _meetings(dense, placed, "rep")
    known = placed.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if meetings is None:
        return known
    met = meetings.select("crowd", F.explode(_met()).alias("at"), "rep", "sketch").select(
        "crowd", "at.i", "at.j", "rep", "sketch"
    )
    return known.union(_agreeing(met, percent, forest))


def _orders(signed: DataFrame, trees: int, depth: int) -> DataFrame:
    """A row ``tree, signature, rep, sketch`` for each text in each tree."""
    size = 2 * depth
    signatures = F.array(*[F.substring("labels", 1 + t * size, size) for t in range(trees)])
    return signed.select("rep", "sketch", F.posexplode(signatures).alias("tree", "signature"))


def _prefix(depth: int) -> Column:
    """The crowd of a row: its tree and the first ``depth`` labels of its signature."""
    return F.xxhash64("tree", F.substring("signature", 1, 2 * depth))


def _regions(order: DataFrame, least_depth: int, forest: Forest) -> tuple[DataFrame, DataFrame | None]:
    """Rows ``crowd, i, j, rep, sketch``, a region being a ``crowd, i, j``; and what was crowded.

    A row's region is that of the least depth at which not more than ``forest.region`` texts
    share its prefix. Where they do at full depth, they are dealt into blocks ``i``. The
    crowds of the least depth are told too (``crowd, n``), or None if there are none.
    """
    zero = F.lit(0).cast("long")
    first = None
    open_rows, found = order, None
    for depth in range(least_depth, forest.depth + 1):
        rows = open_rows.withColumn("crowd", _prefix(depth))
        sizes = rows.groupBy("crowd").agg(F.count("*").alias("n")).where(F.col("n") > forest.region)
        crowded = stored(sizes, "crowded")
        done = crowded.isEmpty()
        calm = rows if done else rows.join(crowded, "crowd", "left_anti")
        calm = calm.withColumns({"i": zero, "j": zero})
        found = calm if found is None else found.unionByName(calm)
        if done:
            break
        first = crowded if first is None else first
        open_rows = rows.join(crowded.select("crowd"), "crowd", "left_semi").drop("crowd")
        if depth == forest.depth:
            blocks = F.ceil(F.col("n") / max(1, forest.region // 2))
            dealt = rows.join(crowded, "crowd").withColumns({"i": F.pmod(F.xxhash64("rep", "crowd"), blocks), "j": zero})
            found = found.unionByName(dealt.drop("n"))
    return found.select("crowd", "i", "j", "rep", "sketch"), first


def _meetings(rows: DataFrame, placed: DataFrame, node: str) -> DataFrame | None:
    """Rows of ``crowd``, ``node``, ``weight`` (as a part of a block) with what ``_met`` is told by; None if none meet.

    Every two rows of a crowd that are not in one component of ``placed`` (a node without
    one is its own) meet. Of each crowd the heaviest component need not meet itself: the
    other rows, those left open, are dealt into blocks ``j``, all rows into blocks ``i``,
    and each ``i`` meets each ``j``. A crowd that is one component has no meetings.
    """
    parts = rows.join(placed.withColumnRenamed("node", node), node, "left").withColumn(
        "component", F.coalesce("component", node)
    )
    weights = parts.groupBy("crowd", "component").agg(F.sum("weight").alias("weight"))
    heaviest = weights.groupBy("crowd").agg(
        F.max_by("component", "weight").alias("heaviest"),
        F.count("*").alias("n"),
        F.sum("weight").alias("all"),
        F.max("weight").alias("own"),
    )
    open_crowds = stored(
        heaviest.where(F.col("n") > 1).select(
            "crowd",
            "heaviest",
            F.ceil("all").alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("own"))).alias("open_blocks"),
        ),
        "open",
    )
    if open_crowds.isEmpty():
        return None
    return parts.join(open_crowds, "crowd").select(
        *rows.columns,
        F.pmod(F.xxhash64(node, F.lit(3)), F.col("blocks")).alias("i"),
        F.pmod(F.xxhash64(node, F.lit(4)), F.col("open_blocks")).alias("j"),
        "blocks",
        "open_blocks",
        (F.col("component") != F.col("heaviest")).alias("open"),
    )


def _met() -> Column:
    """The meetings ``i, j`` of a row; those of a first deal (no ``open_blocks``) are its blocks themselves."""
    i, j, zero = F.col("i"), F.col("j"), F.lit(0).cast("long")
    at = lambda i, j: F.struct(i.alias("i"), j.cast("long").alias("j"))
    blocks = F.when(F.col("blocks") > 1, F.array(at(i, F.lit(-1)), at(j, F.lit(-2)))).otherwise(F.array(at(i, F.lit(-1))))
    own = F.transform(F.sequence(zero, F.col("open_blocks") - 1), lambda x: at(i, x))
    others = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda x: at(x, j))
    return F.when(F.col("open_blocks") == 0, blocks).when(F.col("open"), F.array_union(own, others)).otherwise(own)


def _agreeing(rows: DataFrame, percent: int, forest: Forest) -> DataFrame:
    """Edges ``a, b`` that connect the texts of each ``crowd, i, j`` whose sketches agree enough."""
    least = (percent / 100 - forest.slack) * forest.sketch_bits
    rows = rows.select("crowd", "i", "j", "rep", "sketch").repartition("crowd", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, _meeting_keys):
            key = _meeting_keys(rows)
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            ids = rows.column(3).to_numpy()
            bits = _fixed(rows.column(4), forest.sketch_bits // 8).reshape(len(ids), -1)
            a, b = [], []
            for i in np.flatnonzero(np.diff(edge) > 1):
                member, leader = _close(ids[edge[i] : edge[i + 1]], bits[edge[i] : edge[i + 1]], least)
                a.append(member)
                b.append(leader)
            if a:
                yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    return map_arrow(rows.sortWithinPartitions("crowd", "i", "j"), compare, "a long, b long")


def _close(ids: np.ndarray, packed: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Each member and the leader it is connected with by sketches that agree enough."""
    signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
    return _connected(ids, lambda rows, cols: signs[rows] @ signs[cols].T >= least)


def _connected(ids: np.ndarray, linked, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a node and the first node it is connected with, without the pairs of themselves.

    Breadth first: ``linked(rows, columns)`` is asked for ``step`` rows and all columns not
    reached yet, once for each row.
    """
    left = np.arange(len(ids))
    a, b = [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            now, front = front[:step], front[step:]
            hit = linked(now, left).any(axis=0)
            reached, left = left[hit], left[~hit]
            a.append(ids[reached])
            b.append(np.full(len(reached), ids[seed]))
            front = np.concatenate([front, reached])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _confirmed(
    documents: DataFrame, signed: DataFrame, candidates: DataFrame, width: int, percent: int, forest: Forest
) -> DataFrame:
    """Edges ``a, b`` whose components are those of the true links within candidate components.

    A candidate component of more than one block is dealt into blocks twice, differently,
    which connects what is dense; blocks then meet for the pairs not connected yet.
    """
    weight = 1 / F.lit(forest.block) + 8 * F.max("n_shingles") / F.lit(forest.block_bytes)
    members = candidates.withColumnsRenamed({"node": "doc_id", "component": "crowd"})
    lengths = signed.select("doc_id", "n_shingles")
    members = stored(members.join(lengths, "doc_id").groupBy("crowd", "doc_id").agg(weight.alias("weight")), "members")
    sizes = stored(members.groupBy("crowd").agg(F.ceil(F.sum("weight")).alias("blocks")), "sizes")
    first = members.join(sizes, "crowd").select(
        "crowd",
        "doc_id",
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).alias("i"),
        F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("blocks")).alias("j"),
        "blocks",
        F.lit(0).cast("long").alias("open_blocks"),
        F.lit(False).alias("open"),
    )
    edges = stored(_linked(documents, first, width, percent), "links")
    crowded = sizes.where(F.col("blocks") > 1).select("crowd")
    if crowded.isEmpty():
        return edges
    placed = stored(components(edges), "placed")
    meetings = _meetings(members.join(crowded, "crowd"), placed, "doc_id")
    return edges if meetings is None else edges.union(_linked(documents, meetings, width, percent))


def _linked(documents: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges ``a, b`` that connect the linked texts of each meeting ``i, j`` of each ``crowd``."""
    told = ["crowd", "doc_id", "i", "j", "blocks", "open_blocks", "open"]

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for low, high in text_slices(batch.column("text")):
                part = batch.slice(low, high - low)
                sets = [
                    shingle_set(words_of(t or ""), width, hashes).tobytes() for t in part.column("text").to_pylist()
                ]
                hashes.trim()
                yield pa.record_batch([*(part.column(c) for c in told), pa.array(sets, pa.binary())], [*told, "set"])

    texts = lookup(documents, members.select(*told), "doc_id").select(*told, "text")
    kinds = "crowd long, doc_id long, i long, j long, blocks long, open_blocks long, open boolean, set binary"
    meetings = (
        map_arrow(texts, shingle, kinds)
        .select("crowd", F.explode(_met()).alias("at"), "doc_id", "set")
        .select("crowd", "at.i", "at.j", "doc_id", "set")
        .repartition("crowd", "i", "j")
        .sortWithinPartitions("crowd", "i", "j", "doc_id")
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, _meeting_keys):
            key = _meeting_keys(rows)
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            a, b = [], []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if j - i < 2:
                    continue
                part = rows.slice(i, j - i)
                links = _links([np.frombuffer(s, np.uint64) for s in part.column("set").to_pylist()], percent)
                member, leader = _connected(
                    part.column("doc_id").to_numpy(), lambda r, c, links=links: links[np.ix_(r, c)]
                )
                a.append(member)
                b.append(leader)
            if a:
                yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    return map_arrow(meetings, confirm, "a long, b long")


def _links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets are linked."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one set alone are in no intersection.
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.int64)
    wide = max(256, (1 << 22) // n)
    for start in range(0, int(shared.sum()), wide):
        low, high = np.searchsorted(column, [start, start + wide])
        has = np.zeros((n, int(min(wide, shared.sum() - start))), np.float32)
        has[row[low:high], column[low:high] - start] = 1
        common += (has @ has.T).astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def _meeting_keys(rows: pa.RecordBatch) -> np.ndarray:
    return np.stack([rows.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a binary column whose values are all ``width`` bytes long."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    start = int(offsets[0])
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, start)


def _runs(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.RecordBatch]:
    """The sorted rows again, in batches that never end within a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = keys(batch)
        if held and (keys(held[-1].slice(held[-1].num_rows - 1))[0] != key[0]).any():
            yield _joined(held)
            held = []
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        if len(change):
            end = int(change[-1]) + 1
            yield _joined([*held, batch.slice(0, end)])
            held = [batch.slice(end)]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)
