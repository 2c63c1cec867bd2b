"""Current wiki text straight from the wiki's base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators.lookup import MAX_BROADCAST_ROWS, lookup

# Main and project namespace, the content role and the address scheme.
NAMESPACES = (0, 4)
ROLE = "main"
SCHEME = "tt:"


def current_text(
    page: DataFrame,
    slots: DataFrame,
    slot_roles: DataFrame,
    content: DataFrame,
    text: DataFrame,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``page_title, content`` of the current revision of every article page.

    Equi-joins on keys. The page, role and address filters reach the scans. The narrow
    tables are joined first; what they leave is looked up in the text table, which
    holds every old revision too and is never shuffled whole. Among the narrow tables
    the planner broadcasts by measured size.
    """
    articles = page.where(
        F.col("page_namespace").isin(*NAMESPACES) & (F.col("page_is_redirect") == 0)
    ).select("page_title", "page_latest")
    role = slot_roles.where(F.col("role_name") == ROLE).select("role_id")
    addresses = content.where(F.startswith("content_address", F.lit(SCHEME))).select(
        "content_id", text_key(F.expr(f"substring(content_address, {len(SCHEME) + 1})")).alias("text_id")
    )
    # Nearly all slots have one role, so its id is no key to shuffle on; roles are a handful by nature.
    main_slots = slots.join(F.broadcast(role), F.col("slot_role_id") == F.col("role_id")).select(
        "slot_revision_id", "slot_content_id"
    )
    wanted = (
        articles.join(main_slots, F.col("page_latest") == F.col("slot_revision_id"))
        .join(addresses, F.col("slot_content_id") == F.col("content_id"))
        .select(F.col("text_id").alias("old_id"), "page_title")
    )
    found = lookup(text.select("old_id", "old_text"), wanted, "old_id", None, max_broadcast_rows)
    return found.select("page_title", F.col("old_text").alias("content"))


def text_key(address: Column) -> Column:
    """The integer an address stands for; null if it is not one, so it joins nothing."""
    return address.try_cast("bigint")
