"""Change feeds applied to watchlists and positions.

A feed row has a unique ``seq``. Instead of replaying changes one by one, the final state of a
key is derived from a few aggregates over its changes, so the feed is reduced on the map side
and a key with very many changes needs no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["user_id", "ticker"]


def expand_watchlist_changes(changes: DataFrame) -> DataFrame:
    """(seq, user_id, op, tickers[]) -> one row per ticker: (step, user_id, ticker, op, position).

    ``add`` and ``remove`` carry lists too (a patch adds first and removes after, so with equal
    ``seq`` a remove comes later); in a ``reorder`` the list position is the new sort order.
    """
    rank = F.when(F.col("op") == "remove", 1).otherwise(0)
    return changes.select(
        (F.col("seq") * 2 + rank).alias("step"),
        "user_id",
        "op",
        F.posexplode("tickers").alias("position", "ticker"),
    )


def apply_watchlist_changes(
    user_tickers: DataFrame, changes: DataFrame, bucket_steps: int = 1 << 20
) -> DataFrame:
    """Watchlists after add (insert if absent, at position 0), remove and reorder changes.

    A row's life starts with the base table, or with the first add after the last remove; its
    sort order is that of the last reorder within that life. The feed is first reduced to a row per
    (key, range of steps), on the map side, so that a key with very many changes is spread over tasks. Only
    where a range holds adds on both sides of the last remove, its adds are looked at again.
    """
    steps = expand_watchlist_changes(changes).withColumn(
        "bucket", F.call_function("div", "step", F.lit(bucket_steps))
    )
    step_of = "case when op = '{}' then step end"
    ranges = steps.groupBy(*KEY, "bucket").agg(
        F.expr(f"max({step_of.format('remove')}) as removed"),
        F.expr(f"min({step_of.format('add')}) as first_add"),
        F.expr(f"max({step_of.format('add')}) as last_add"),
        F.expr(f"max({step_of.format('reorder')}) as moved_at"),
        F.expr(f"max_by(position, {step_of.format('reorder')}) as moved_to"),
    )
    ranges = ranges.withColumn("removed_at", F.max("removed").over(Window.partitionBy(*KEY)))
    split = ranges.where("first_add < removed_at and last_add > removed_at").select(*KEY, "bucket", "removed_at")
    again = steps.where("op = 'add'").join(split, [*KEY, "bucket"]).where("step > removed_at")
    again = again.groupBy(*KEY).agg(F.min("step").alias("again_at"))
    lives = (
        ranges.groupBy(*KEY)
        .agg(
            F.max("removed_at").alias("removed_at"),
            F.expr("min(case when first_add > coalesce(removed_at, -1) then first_add end) as added_at"),
            F.max("moved_at").alias("moved_at"),
            F.max_by("moved_to", "moved_at").alias("moved_to"),
        )
        .join(again, KEY, "left")
        .withColumn("added_at", F.least("added_at", "again_at"))
    )
    base = user_tickers.select(*KEY, "sort_order", F.lit(True).alias("listed"))
    state = base.join(lives, KEY, "full_outer")
    kept = F.expr("listed and removed_at is null")
    return (
        state.withColumns(
            {
                "born_at": F.when(kept, -1).otherwise(F.col("added_at")),
                "start": F.when(kept, F.col("sort_order")).otherwise(0),
            }
        )
        .where("born_at is not null")
        .selectExpr(
            *KEY, "case when moved_at > born_at then moved_to else start end as sort_order"
        )
    )


def reorder_watchlist(user_tickers: DataFrame, orders: DataFrame) -> DataFrame:
    """Sort orders set from the latest list of each user: (seq, user_id, tickers[]); tickers
    not on a list keep their place, list entries not on the watchlist are ignored."""
    changes = orders.select("seq", "user_id", F.lit("reorder").alias("op"), "tickers")
    return apply_watchlist_changes(user_tickers, changes)


def apply_position_changes(positions: DataFrame, changes: DataFrame) -> DataFrame:
    """Positions after a feed of (seq, user_id, op, position_id, ticker, shares, cost_basis).

    ``add`` inserts, ``update`` sets shares and cost, ``delete`` removes. Updates and deletes
    count only for the owner of the position and only after it exists; a delete is final.
    """
    base_cols = ["id", "user_id", "ticker", "shares", "cost_basis"]
    base = positions.select(*base_cols, F.lit(-1).cast("bigint").alias("born_at"))
    first = F.struct("seq", "user_id", "ticker", "shares", "cost_basis")
    added = (
        changes.where(F.col("op") == "add")
        .groupBy(F.col("position_id").alias("id"))
        .agg(F.min(first).alias("a"))
        .select("id", "a.user_id", "a.ticker", "a.shares", "a.cost_basis", F.col("a.seq").alias("born_at"))
        .join(positions.select("id"), "id", "left_anti")
    )
    alive = base.unionByName(added)
    # reduced per position and user before the join: a position with very many edits costs one
    # row per map task, and the last edit of its owner is all that counts
    is_update = "case when op = 'update' then seq end"
    edits = (
        changes.where(F.col("op").isin("update", "delete"))
        .groupBy(F.col("position_id").alias("id"), "user_id")
        .agg(
            F.expr("max(case when op = 'delete' then seq end) as _deleted"),
            F.expr(f"max({is_update}) as _updated"),
            F.expr(f"max_by(shares, {is_update}) as _shares"),
            F.expr(f"max_by(cost_basis, {is_update}) as _basis"),
        )
    )
    updated = F.expr("_updated > born_at")
    return (
        alive.join(edits, ["id", "user_id"], "left")
        .where("_deleted is null or _deleted < born_at")
        .select(
            "id",
            "user_id",
            "ticker",
            F.when(updated, F.col("_shares")).otherwise(F.col("shares")).alias("shares"),
            F.when(updated, F.col("_basis")).otherwise(F.col("cost_basis")).alias("cost_basis"),
        )
    )
