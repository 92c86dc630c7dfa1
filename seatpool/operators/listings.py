"""Lookups and listings over the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seatpool import schemas as S
from seatpool.functions.columns import composite_key
from seatpool.functions.ordered import BLOCK, in_blocks, running


def page(
    rows: DataFrame,
    order: str,
    per: Sequence[str] = (),
    limit: int | None = None,
    after: str | None = None,
) -> DataFrame:
    """T4: all rows, or the first ``limit`` by key, per asker or overall, behind key ``after``.

    The rank filter is applied inside each task before the shuffle, so at most
    ``limit`` rows per asker leave a task. The last key of a page is the next ``after``.
    """
    if after is not None:
        rows = rows.where(F.col(order) > F.lit(after))
    if limit is None:
        return rows
    if not per:
        return rows.orderBy(order).limit(limit)
    ranks = Window.partitionBy(*per).orderBy(order)
    return rows.withColumn("rank_no", F.row_number().over(ranks)).where(
        F.col("rank_no") <= limit
    ).drop("rank_no")


def lookup(requests: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each request with the row under its key, or nulls."""
    return requests.join(table, list(key), "left")


def active_bids(
    bids: DataFrame, users: DataFrame | None = None, limit: int | None = None, after: str | None = None
) -> DataFrame:
    """AVAILABLE bids per user."""
    rows = bids.where(F.col("status") == S.AVAILABLE).select(
        "user_id",
        "user_id_title_id",
        "user_id_status",
        "title_id",
        "num_tickets",
        "ticket_bid",
        "from",
        "status",
        "is_preapp",
    )
    return page(_of(rows, users), "user_id_title_id", ["user_id"], limit, after)


def timeslots(
    slots: DataFrame, users: DataFrame | None = None, limit: int | None = None, after: str | None = None
) -> DataFrame:
    """Timeslots that are not expired, per user."""
    live = [status for status in S.STATUSES if status != S.EXPIRED]
    rows = slots.where(F.col("status").isin(live)).select(
        "user_id_day", "user_id", "day", "status", "is_preapp"
    )
    return page(_of(rows, users), "user_id_day", ["user_id"], limit, after)


def current_titles(
    titles: DataFrame, limit: int | None = None, after: str | None = None, first=None, last=None
) -> DataFrame:
    """Titles that are not expired; P12: that can be seen between ``first`` and ``last``."""
    rows = in_range(in_range(titles, "to", first), "from", last=last)
    rows = rows.where("expired = 0").select("title_id", "expired", "title_name")
    return page(rows, "title_id", (), limit, after)


def available_events(
    events: DataFrame,
    limit: int | None = None,
    after: str | None = None,
    first=None,
    last=None,
    statuses: Sequence[str] = (S.AVAILABLE,),
) -> DataFrame:
    """Events with seats left, or of other statuses; P12: within a range of days."""
    rows = in_range(events, "day", first, last, statuses).select(
        "title_id_day", "status", "title_name", "day", "ticket_price", "num_tickets_available"
    )
    return page(rows, "title_id_day", (), limit, after)


def preferences_of(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Each asker's preferences, or why there are none."""
    found = lookup(users.select("user_id"), preferences, ["user_id"])
    return found.withColumn(
        "error", F.when(F.col("or_or_any").isNull(), S.NO_SUCH_USER)
    )


def in_range(
    rows: DataFrame, column: str, first=None, last=None, statuses: Sequence[str] | None = None
) -> DataFrame:
    """Optional date range and status filters of a listing."""
    if first is not None:
        rows = rows.where(F.col(column) >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col(column) <= F.lit(last).cast("date"))
    if statuses is not None:
        rows = rows.where(F.col("status").isin(list(statuses)))
    return rows


def bookings_of(
    bookings: DataFrame,
    users: DataFrame | None = None,
    first=None,
    last=None,
    statuses: Sequence[str] | None = None,
) -> DataFrame:
    """Bookings by user, date range and status."""
    return in_range(_of(bookings, users), "day", first, last, statuses)


def buy_tickets(requests: DataFrame, events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Requests (seq, user_id, title_id, day, num_tickets) for existing events.

    In order of seq, a request is granted while the tickets asked for so far,
    its own included, fit in the seats that are left; a request that does not fit
    still counts as asked for. Requests for fewer or more tickets than the contract
    allows, or without key or seq, are refused and count nothing. ``tickets_sold`` and
    ``seats_after`` give what follows from the answers.
    """
    fine = F.col("num_tickets").between(*S.NUM_TICKETS_RANGE)
    for name in ("seq", "title_id", "day"):
        fine = fine & F.col(name).isNotNull()
    fine = F.coalesce(fine, F.lit(False))
    refused = requests.where(~fine).withColumns(
        {"reason": F.lit("invalid request"), "granted": F.lit(False)}
    )
    requests = in_blocks(requests.where(fine), "seq", block)
    key = ["title_id", "day"]
    seats = events.select(*key, "num_tickets_available", F.lit(True).alias("has_event"))
    asked = running(requests, key, "seq", totals={"asked_so_far": F.col("num_tickets")})
    upto: Column = F.coalesce("asked_so_far", F.lit(0)) + F.col("num_tickets")
    # requests are not joined before the running total: it keeps the hot key in blocks
    answered = (
        asked.join(seats, key, "left")
        .withColumn(
            "reason",
            F.when(F.col("has_event").isNull(), "no such event").when(
                upto > F.col("num_tickets_available"), "not enough tickets"
            ),
        )
        .withColumn("granted", F.col("reason").isNull())
        .drop("asked_so_far", "has_event", "num_tickets_available")
    )
    return answered.unionByName(refused)


def tickets_sold(answered: DataFrame) -> DataFrame:
    """A booked bid per granted request."""
    event_id = composite_key("title_id", "day")
    return answered.where("granted").select(
        "seq",
        composite_key("user_id", event_id).alias("user_id_event_id"),
        "user_id",
        "title_id",
        "day",
        "num_tickets",
        F.lit(S.BOOKED).alias("status"),
    )


def seats_after(events: DataFrame, answered: DataFrame) -> DataFrame:
    """Show events with the seats and the status that granted requests leave."""
    key = ["title_id", "day"]
    sold = answered.where("granted").groupBy(*key).agg(F.sum("num_tickets").alias("sold"))
    left = F.col("num_tickets_available") - F.coalesce("sold", F.lit(0))
    return (
        events.join(sold, key, "left")
        .withColumn("num_tickets_available", left)
        .withColumn(
            "status",
            F.when(F.col("sold").isNotNull() & (F.col("num_tickets_available") <= 0), S.FULL)
            .otherwise(F.col("status")),
        )
        .select(*events.columns)
    )


def cancel_bookings(bookings: DataFrame, requests: DataFrame) -> DataFrame:
    """Bookings with those asked for set to CANCELED; repeating changes nothing."""
    key = ["user_id", "title_id", "day"]
    marks = requests.select(*key).distinct().withColumn("asked", F.lit(True))
    status = F.when(F.col("asked"), S.CANCELED).otherwise(F.col("status"))
    return bookings.join(marks, key, "left").withColumn("status", status).drop("asked")


def _of(rows: DataFrame, users: DataFrame | None) -> DataFrame:
    return rows if users is None else rows.join(users.select("user_id"), "user_id", "left_semi")
