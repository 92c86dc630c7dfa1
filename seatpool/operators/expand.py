"""Dataset expansion from given ids (operators X1, X3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seatpool.functions.columns import format_hour, hours_after
from seatpool.functions.ordered import numbered, sized
from seatpool.operators.metrics import expected_rows


def expand_bids(
    users: DataFrame,
    titles: DataFrame,
    venues: DataFrame,
    first_day: str,
    bids_per_user: int,
    slots_per_user: int,
    venues_per_user: int,
    days: int = 14,
) -> DataFrame:
    """Each user bids on some titles, timeslots and venues, round robin.

    ``users`` has user_id and a whole number ``user_no``. Timeslots lie on a
    grid of every second hour from midnight to noon. Choices follow from the
    numbers of the user and of the line, not from chance.
    """

    def steps(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    user = F.col("user_no")
    lines = (
        users.select("user_id", "user_no", steps(bids_per_user).alias("i"))
        .select("*", steps(slots_per_user).alias("j"))
        .select("*", steps(venues_per_user).alias("k"))
        .withColumn("title_line", user * bids_per_user + F.col("i"))
        .withColumn("slot_line", F.col("title_line") * slots_per_user + F.col("j"))
        .withColumn("venue_line", F.col("slot_line") * venues_per_user + F.col("k"))
        .withColumn("total_bid", (10 + user % 6) * (1 + user % 4))
    )
    day = F.date_add(F.lit(first_day).cast("date"), (F.col("slot_line") % days).cast("int"))
    lines = lines.withColumn(
        "timeslot", format_hour(hours_after(day, (F.col("slot_line") % 7 * 2).cast("int")))
    )
    lines = _round_robin(lines, titles, "title_id", "title_line")
    lines = _round_robin(lines, venues, "venue_id", "venue_line")
    return lines.select("user_id", "title_id", "timeslot", "venue_id", "total_bid")


def expand_to_size(
    users: DataFrame,
    titles: DataFrame,
    venues: DataFrame,
    first_day: str,
    interest_multiplier: float,
    slot_multiplier_per_day: float,
    days: int = 14,
) -> DataFrame:
    """X2 over X1: as many bids and timeslots per user as the multipliers stand for, given how many
    users and titles there are."""
    total_users, total_titles = users.count(), titles.count()
    rows = expected_rows(total_users, total_titles, interest_multiplier, slot_multiplier_per_day, days)
    bids, slots = (n // max(total_users, 1) for n in rows.values())
    if not bids or not slots:
        return expand_bids(users, titles, venues, first_day, 1, 1, 1, days).limit(0)
    return expand_bids(users, titles, venues, first_day, bids, slots, 1, days)


def _round_robin(lines: DataFrame, choices: DataFrame, name: str, line: str) -> DataFrame:
    choices, count = numbered(choices.select(name), [name])
    turn = F.pmod(F.col(line), F.lit(max(count, 1))) == F.col("position")
    return lines.join(sized(choices, count), turn).drop("position")


def validity_split(titles: DataFrame, today: str, days: int = 14) -> DataFrame:
    """The first half of the titles is current, the second half ended yesterday."""
    placed, count = numbered(titles.select("title_id", "title_name"), ["title_id"])
    now = F.lit(today).cast("date")
    current = F.col("position") * 2 < count
    return placed.select(
        "title_id",
        "title_name",
        F.when(current, now).otherwise(F.date_add(now, -1 - days)).alias("from"),
        F.when(current, F.date_add(now, days)).otherwise(F.date_add(now, -1)).alias("to"),
        F.when(current, 0).otherwise(1).alias("expired"),
    )
