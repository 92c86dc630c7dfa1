"""Keyed tables: put by key and conditional status changes (operators U1, U2, K4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seatpool import schemas as S
from seatpool.functions.columns import composite_key
from seatpool.functions.ordered import latest


def upsert(
    table: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Whole rows replaced under their key, the last change per key wins."""
    last = latest(changes, key, order).select(*table.columns)
    kept = table.join(last.select(*key), list(key), "left_anti")
    return kept.select(*table.columns).unionByName(last)


def change_status(
    table: DataFrame,
    requests: DataFrame,
    key: Sequence[str],
    status: str,
    expected: str | None = None,
) -> DataFrame:
    """One change per key of ``requests``, if the present status is as expected.

    A key without a row counts as not changed; the old status is kept.
    """
    wanted = requests.select(*key).distinct()
    present = table.select(*key, F.col("status").alias("old_status"))
    joined = wanted.join(present, list(key), "left")
    passes = F.col("old_status").isNotNull()
    if expected is not None:
        passes = F.coalesce(F.col("old_status") == expected, F.lit(False))
    return joined.withColumn("changed", passes).withColumn(
        "status", F.when(passes, status).otherwise(F.col("old_status"))
    )


def with_status(table: DataFrame, changed: DataFrame, key: Sequence[str], status: str) -> DataFrame:
    """``table`` with ``status`` on the keys of ``changed``; derived keys follow."""
    marks = changed.select(*key).withColumn("hit", F.lit(True))
    return with_derived_keys(
        table.join(marks, list(key), "left")
        .withColumn("status", F.when(F.col("hit"), status).otherwise(F.col("status")))
        .drop("hit")
    )


def with_derived_keys(table: DataFrame) -> DataFrame:
    """Recompute the denormalised user_id_status, where the table has it."""
    if "user_id_status" not in table.columns:
        return table
    return table.withColumn("user_id_status", composite_key("user_id", "status"))
