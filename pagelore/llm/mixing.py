"""Mixing sources to target weights by hierarchical budgets (operator 7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import stored

_BUCKET_DIGITS = 4


def byte_tokens(text: Column) -> Column:
    """Tokens of a text, estimated as one for each four bytes begun; none for null."""
    return F.coalesce(((F.octet_length(text) + 3) / 4).cast("long"), F.lit(0).cast("long"))


def mix(
    documents: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    percent: int,
    max_epochs: int = 1,
    seed: int = 7,
    doc_id: str = "doc_id",
    tokens: Column | None = None,
    prefix: str = "_",
) -> DataFrame:
    """``documents`` chosen to the weights, once for each epoch, with columns ``_epoch``, ``_tokens`` and each level as ``_<name>``.

    ``levels`` gives the tree from the root down: documents of equal values are in one
    node, a null value being the empty one. ``weights`` gives whole-number weights by
    level and value, 1 where there is none (0: nothing is taken). ``percent`` of all
    tokens are wanted; a leaf can give its tokens ``max_epochs`` times.

    Budgets go down the tree. At each node its budget is shared out by weight among the
    children; a child that holds less than its share gives all it has, and what it lacks
    goes to its siblings by weight. As a node is never asked for more than all below it
    can give, a shortage passes to the node's own siblings only when the siblings within
    are exhausted. Budgets are whole tokens and add up exactly.

    A leaf spends its budget on whole epochs, each all its documents, and on the
    beginning of one more: documents in the order of md5(seed:epoch:doc_id), up to where
    the budget is used up; the document that straddles that place is taken if this comes
    nearer to the budget. Rows of one ``doc_id`` go together. A document without tokens
    is taken with those around it. No rows give no rows. No column of ``documents`` may
    begin with ``prefix``, which all new ones do (see ``free_prefix``).

    Prefixes of a leaf are found by sums over 65,536 ranges of the order; only the range
    that holds the end is sorted. No leaf is ever gathered.
    """
    names = [f"{prefix}{name}" for name in levels]
    weights = {f"{prefix}{name}": by_value for name, by_value in weights.items()}
    full, cut = f"{prefix}full", f"{prefix}cut"
    leaf = {f"{prefix}{name}": F.coalesce(value.cast("string"), F.lit("")) for name, value in levels.items()}
    size = byte_tokens(F.col("text")) if tokens is None else tokens
    narrow = stored(
        documents.select(
            *(value.alias(name) for name, value in leaf.items()), F.col(doc_id).alias("doc_id"), size.alias("tokens")
        ),
        "sizes",
    )
    budgets = _budgets(narrow, names, weights, percent, max_epochs)
    plan = _cuts(narrow, budgets, names, seed).withColumnsRenamed({"full": full, "cut": cut})
    placed = documents.withColumns(leaf | {f"{prefix}tokens": size}).join(plan, names)
    order = _order(seed, F.col(full), F.col(doc_id))
    in_part = F.coalesce(order <= F.col(cut), F.lit(False)).cast("int")
    times = (F.col(full) + in_part).cast("int")
    every = F.when(times > 0, F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1))
    return placed.withColumn(f"{prefix}epoch", F.explode(every)).drop(full, cut)


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    parts = (F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _weight(name: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    weight = F.lit(1)
    for value, w in weights.get(name, {}).items():
        weight = F.when(F.col(name) == value, F.lit(w)).otherwise(weight)
    return weight


def _budgets(
    narrow: DataFrame, names: Sequence[str], weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int
) -> DataFrame:
    """``names``, ``tokens`` and ``budget`` of each leaf."""
    whole = "cast({} as decimal(38,0))".format
    wanted = F.lit(True)
    for name in names:
        wanted &= _weight(name, weights) > 0
    # What has no weight gives nothing.
    room = F.when(wanted, F.expr(whole("tokens")) * max_epochs).otherwise(0).cast("decimal(38,0)")
    nodes = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens")).withColumn("room", room)
    nodes = stored(nodes, "leaves")
    total = F.expr(f"cast({whole('sum(tokens)')} * {percent} div 100 as decimal(38,0))")
    above = nodes.groupBy().agg(total.alias("budget"))
    for depth, name in enumerate(names):
        parents = names[:depth]
        own = names[: depth + 1]
        children = (
            nodes.groupBy(*own)
            .agg(F.sum("room").cast("decimal(38,0)").alias("room"))
            .withColumn("weight", _weight(name, weights).cast("decimal(38,0)"))
        )
        children = children.join(above, parents) if parents else children.crossJoin(above)
        siblings = Window.partitionBy(*parents)
        # Fullest first: how much of its weight a child can hold.
        scarce = siblings.orderBy(F.expr("if(weight > 0, double(room) / double(weight), double(0))"), name)
        before = scarce.rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("decimal(38,0)")
        children = children.withColumns(
            {
                "left": F.col("budget") - F.coalesce(F.sum("room").over(before), zero),
                "others": F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), zero),
            }
        )
        # A child is exhausted by its share of what those before it, all exhausted, leave.
        children = children.withColumn("given_out", F.expr("room * others <= weight * left"))
        kept = lambda c: F.when(~F.col("given_out"), F.col(c)).otherwise(zero)
        spent = F.sum(F.when(F.col("given_out"), F.col("room")).otherwise(zero)).over(siblings)
        running = siblings.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        children = children.withColumns(
            {
                "rest": F.col("budget") - spent,
                "sum_weight": F.sum(kept("weight")).over(siblings),
                "to": F.sum(kept("weight")).over(running),
            }
        )
        share = "cast((rest * to) div sum_weight - (rest * (to - weight)) div sum_weight as decimal(38,0))"
        children = children.withColumn("budget", F.expr(f"if(given_out, cast(room as decimal(38,0)), {share})"))
        above = stored(children.select(*own, "budget"), "budgets")
    return nodes.join(above, list(names)).select(*names, "tokens", F.col("budget").cast("long").alias("budget"))


def _cuts(narrow: DataFrame, budgets: DataFrame, names: Sequence[str], seed: int) -> DataFrame:
    """``names``, ``full`` epochs and the ``cut``, the last place in the order that is taken of one more (null: none)."""
    epochs = stored(
        budgets.where(F.col("budget") > 0).select(
            *names,
            F.expr("budget div tokens").alias("full"),
            F.expr("budget % tokens").alias("rest"),
        ),
        "epochs",
    )
    ordered = (
        narrow.join(epochs.where(F.col("rest") > 0), list(names))
        .withColumn("order", _order(seed, F.col("full"), F.col("doc_id")))
        .withColumn("bucket", F.substring("order", 1, _BUCKET_DIGITS))
    )
    along = Window.partitionBy(*names).orderBy("bucket")
    sums = ordered.groupBy(*names, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    sums = sums.withColumn("till", F.sum("tokens").over(along)).where(F.col("till") > F.col("rest"))
    # The first bucket that the budget does not cover, and the tokens before it.
    ends = sums.groupBy(*names).agg(
        F.min("bucket").alias("bucket"), F.min_by(F.col("till") - F.col("tokens"), "bucket").alias("base")
    )
    ends = stored(ends, "ends")
    along = Window.partitionBy(*names).orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = ordered.join(ends, [*names, "bucket"]).withColumn("till", F.col("base") + F.sum("tokens").over(along))
    over = F.col("till") - F.col("rest")
    taken = (over <= 0) | ((over < F.col("tokens")) & (over < F.col("tokens") - over))
    cuts = inside.where(taken).groupBy(*names).agg(F.max("order").alias("last"))
    # Where nothing of that bucket is taken, all before it is: its name sorts before its own places.
    cut = F.coalesce("last", F.col("bucket"))
    return stored(
        epochs.join(ends, list(names), "left").join(cuts, list(names), "left").select(*names, "full", cut.alias("cut")),
        "plan",
    )
