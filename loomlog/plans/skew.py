"""Joining a large relation to one row per key when some keys are hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task may hold.
ROWS_PER_TASK = 500_000
# Hot keys (a hash and a number each) up to which their list is broadcast, 16 MB.
BROADCAST_KEYS = 1_000_000


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join by name in which nulls are equal, with ``left``'s key columns."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(and_, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def hot_list(hot: DataFrame) -> DataFrame:
    """Marked for broadcast if the counted list is short; else it is joined by a
    shuffle, where adaptive execution splits the hot keys."""
    few = hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return F.broadcast(hot) if few else hot.hint("merge")


def join_unique(
    big: DataFrame,
    unique: DataFrame,
    on: Sequence[str],
    weight: str,
    total: int,
    spread_by: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner join of ``big`` to ``unique``, which holds one row per ``on`` key; null
    keys are equal.

    ``unique[weight]`` tells how many rows of ``big`` the key has and ``total``
    their sum. A key heavier than ``rows_per_task`` is cut into blocks by a hash
    of ``spread_by``; its single row on the other side is copied once per block. If
    even the total is small there is nothing to split.
    """
    on = list(on)
    weights = unique.select(*on, weight)
    unique = unique.drop(weight)
    if total <= rows_per_task:
        return join_on(big, unique, on)
    hot = hot_list(
        weights.where(F.col(weight) > rows_per_task)
        .select(
            F.xxhash64(*on).alias("_h"), F.ceil(F.col(weight) / rows_per_task).cast("int").alias("_n")
        )
        .groupBy("_h")
        .agg(F.max("_n").alias("_n"))
    )
    n = F.coalesce(F.col("_n"), F.lit(1))

    def blocks(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", F.xxhash64(*on)).join(hot, "_h", "left")

    left = blocks(big).withColumn("_block", F.pmod(F.xxhash64(spread_by), n).cast("int"))
    right = blocks(unique).withColumn("_block", F.explode(F.sequence(F.lit(0), n - 1)))
    return join_on(left.drop("_h", "_n"), right.drop("_h", "_n"), [*on, "_block"]).drop("_block")
