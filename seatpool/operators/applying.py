"""Applying results: show events, conditional bookings, rejects."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from seatpool import schemas as S
from seatpool.functions.columns import composite_key, ticket_price
from seatpool.functions.ordered import first_by
from seatpool.operators.upsert import with_derived_keys, with_status
from seatpool.session import stored


def show_events(
    messages: DataFrame,
    titles: DataFrame,
    capacity: int = S.EVENT_CAPACITY,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Event records from messages (title_id, day, num_tickets, bids_total).

    Messages about unknown titles, or without day, total or tickets, are dropped
    here and listed by ``event_rejects``.
    """
    messages = messages.where(_whole())
    details = titles.select("title_id", "title_name", "from", "to", "year")
    left = (F.lit(capacity) - F.col("num_tickets")).cast("bigint")
    return messages.join(details, "title_id").select(
        *keep,
        composite_key("title_id", "day").alias("title_id_day"),
        "title_id",
        "title_name",
        "from",
        "to",
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"),
        "day",
        F.when(left <= 0, S.FULL).otherwise(S.AVAILABLE).alias("status"),
        left.alias("num_tickets_available"),
        ticket_price(
            F.col("bids_total").cast("decimal(30,6)"), F.col("num_tickets").cast("bigint")
        ).alias("ticket_price"),
    )


def _whole() -> Column:
    """An event message says what is needed; a price per ticket needs a ticket."""
    return F.coalesce(
        F.col("day").isNotNull() & F.col("bids_total").isNotNull() & (F.col("num_tickets") >= 1),
        F.lit(False),
    )


def event_rejects(messages: DataFrame, titles: DataFrame) -> DataFrame:
    """E4 for events: messages that make no event, with the reason."""
    broken = messages.where(~_whole()).withColumn("reason", F.lit(S.INVALID_MESSAGE))
    return unknown_titles(messages.where(_whole()), titles).unionByName(broken)


def unknown_titles(messages: DataFrame, titles: DataFrame) -> DataFrame:
    """E4 for events: messages without a title."""
    missing = messages.join(titles.select("title_id"), "title_id", "left_anti")
    return missing.withColumn("reason", F.lit(S.NO_SUCH_TITLE))


class Applied(NamedTuple):
    """What reservation messages lead to."""

    bookings: DataFrame
    bid_winners: DataFrame
    slot_winners: DataFrame
    verdicts: DataFrame


_MESSAGE = ["seq", "user_id", "day", "title_id"]


def looked_up(
    messages: DataFrame, titles: DataFrame, bids: DataFrame, slots: DataFrame
) -> DataFrame:
    """Messages with what the tables say about their title, bid and timeslot.

    Each table is read once; all that follows is decided on these rows.
    """
    details = titles.select(
        "title_id", "title_name", F.col("year").alias("title_year"), F.lit(True).alias("has_title")
    )
    bid = bids.select(
        "user_id", "title_id", "is_preapp", "num_tickets", "ticket_bid", F.col("status").alias("bid_status")
    )
    slot = slots.select("user_id", "day", F.col("status").alias("slot_status"))
    return (
        messages.select(*_MESSAGE)
        .join(details, "title_id", "left")
        .join(bid, ["user_id", "title_id"], "left")
        .join(slot, ["user_id", "day"], "left")
    )


def apply_reservations(
    messages: DataFrame, titles: DataFrame, bids: DataFrame, slots: DataFrame
) -> Applied:
    """Messages (seq, user_id, day, title_id) in order of seq.

    The first message for an AVAILABLE bid takes it; of those, the first for
    an AVAILABLE timeslot takes that and makes a booking. A taken bid stays
    taken when its timeslot fails. Both firsts are minima, combined per task
    before the shuffle, so a key with very many messages is no hot spot. What the
    tables say about the messages is written once.
    """
    return decided(stored(looked_up(messages, titles, bids, slots), "messages"))


def decided(rows: DataFrame) -> Applied:
    """What messages that were ``looked_up`` lead to."""
    asking = rows.where(F.col("has_title") & (F.col("bid_status") == S.AVAILABLE))
    found = first_by(asking, ["user_id", "title_id"], ["seq"])
    placing = found.where(F.col("slot_status") == S.AVAILABLE)
    placed = first_by(placing, ["user_id", "day"], ["seq"])
    details = ["is_preapp", "num_tickets", "ticket_bid"]
    event_id = composite_key("title_id", "day")
    bookings = placed.select(
        composite_key("user_id", event_id).alias("user_id_event_id"),
        F.lit(S.BOOKED).alias("status"),
        *details,
        "user_id",
        "day",
        "title_id",
        event_id.alias("event_id"),
        "title_name",
        "title_year",
    )
    bid_winners = found.select(*_MESSAGE, *details)
    slot_winners = placed.select(*_MESSAGE, *details)
    return Applied(bookings, bid_winners, slot_winners, _verdicts(rows, bid_winners, slot_winners))


def _verdicts(rows: DataFrame, bid_winners: DataFrame, slot_winners: DataFrame) -> DataFrame:
    """What became of each message."""
    won = bid_winners.select("user_id", "title_id", F.struct("seq", "day").alias("bid_won_by"))
    slot = slot_winners.select("user_id", "day", F.struct("seq", "title_id").alias("slot_won_by"))
    # by the whole message, since sequence numbers may repeat
    has_bid = F.col("bid_won_by").eqNullSafe(F.struct("seq", "day"))
    has_slot = has_bid & F.col("slot_won_by").eqNullSafe(F.struct("seq", "title_id"))
    reason = (
        F.when(has_slot, None)
        .when(F.col("has_title").isNull(), S.NO_SUCH_SHOW)
        .when(F.col("bid_status").isNull(), S.NO_SUCH_BID)
        .when(F.col("bid_status") != S.AVAILABLE, "bid not available")
        .when(~has_bid, "bid taken")
        .when(F.col("slot_status").isNull(), "no such timeslot")
        .when(F.col("slot_status") != S.AVAILABLE, "timeslot not available")
        .otherwise("timeslot taken")
    )
    return (
        rows.join(won, ["user_id", "title_id"], "left")
        .join(slot, ["user_id", "day"], "left")
        .select(*_MESSAGE, reason.alias("reason"))
    )


def rejected(applied: Applied) -> DataFrame:
    """Messages that made no booking, with the reason."""
    return applied.verdicts.where("reason IS NOT NULL")


def bids_after(bids: DataFrame, applied: Applied) -> DataFrame:
    """E3 for bids, with a flag on bids taken by a message that found no timeslot."""
    key = ["user_id", "title_id"]
    placed = applied.slot_winners.select(*key, F.lit(True).alias("placed"))
    taken = applied.bid_winners.select(*key, F.lit(True).alias("taken")).join(placed, key, "left")
    after = bids.join(taken, key, "left").withColumns(
        {
            "status": F.when(F.col("taken"), S.BOOKED).otherwise(F.col("status")),
            "orphan": F.col("taken").isNotNull() & F.col("placed").isNull(),
        }
    )
    return with_derived_keys(after.drop("taken", "placed"))


def slots_after(slots: DataFrame, applied: Applied) -> DataFrame:
    """E3 for timeslots."""
    return with_status(slots, applied.slot_winners, ["user_id", "day"], S.BOOKED)
