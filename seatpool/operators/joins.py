"""Joins of interest with free days (operators J1, J2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def interest_by_slot(
    bids: DataFrame, slots: DataFrame, keep: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Every title a user bids on, for every day the user is free.

    ``how='left'`` also keeps users without a free day, with a null day.
    """
    bids = bids.select("user_id", "title_id", "total_bid", *keep)
    return bids.join(slots.select("user_id", "day"), "user_id", how)


def unmatched_interest(bids: DataFrame, slots: DataFrame) -> DataFrame:
    """Bids of users who have no free day at all."""
    bids = bids.select("user_id", "title_id", "total_bid")
    return bids.join(slots.select("user_id"), "user_id", "left_anti")
