"""Group totals and bookings kept up to date under changes (J1 with A1, I1 for I8).

A change of a bid or a free day is a row with a sign: -1 for what is no longer there, 1 for
what is new. The join of interest with free days changes by three products,

    changed bids with the days as they were, the bids as they were with changed days,
    changed bids with changed days,

so totals per group follow from the changes and their partners alone.

A booking run picks groups in the order of their totals, which never rise. A group that no
change touches has the same rows before and after. A touched group can be picked no earlier
than at the place of its larger total, the one before or the one after. So up to the first
such place both runs pick the same groups and close the same rows: those events stand. What
they leave open is what is left of bids and days without the titles and days they booked.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from seatpool import schemas as S
from seatpool.functions.ordered import sized
from seatpool.operators.allocate import Bookings, book, over_minimum
from seatpool.operators.joins import interest_by_slot
from seatpool.session import stored

GROUP = ("day", "title_id")


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one table that the other does not have, each with how many more or fewer."""
    both = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
    names = [n for n in both.columns if n != "sign"]
    return both.groupBy(*names).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def joined_changes(
    bids: DataFrame, slots: DataFrame, bid_changes: DataFrame, slot_changes: DataFrame
) -> DataFrame:
    """Changes of J1 with their sign. ``bids`` and ``slots`` are as they were before.

    Changes are counted; as long as they are few, the tables are not shuffled.
    """
    new_bids = sized(
        bid_changes.select("user_id", "title_id", "total_bid", F.col("sign").alias("b")),
        bid_changes.count(),
    )
    new_slots = sized(
        slot_changes.select("user_id", "day", F.col("sign").alias("s")), slot_changes.count()
    )
    bids, slots = bids.select("user_id", "title_id", "total_bid"), slots.select("user_id", "day")
    columns = ["user_id", "day", "title_id", "total_bid"]
    return (
        slots.join(new_bids, "user_id")
        .select(*columns, F.col("b").alias("sign"))
        .unionByName(bids.join(new_slots, "user_id").select(*columns, F.col("s").alias("sign")))
        .unionByName(
            new_bids.join(new_slots, "user_id").select(
                *columns, (F.col("b") * F.col("s")).alias("sign")
            )
        )
    )


def total_changes(rows: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """What changed rows add to the totals of their groups; a group that is touched without a
    difference has a row too."""
    return rows.groupBy(*group).agg(
        F.sum(F.col("total_bid") * F.col("sign")).alias("bids_total"),
        F.sum("sign").alias("num_tickets"),
    )


def summed_totals(parts: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """A1 out of stored totals and their changes; groups without rows are gone."""
    summed = parts.groupBy(*group).agg(
        F.sum("bids_total").alias("bids_total"), F.sum("num_tickets").alias("num_tickets")
    )
    return summed.where("num_tickets > 0")


def first_reach(totals: DataFrame, changes: DataFrame, minimum, strict: bool = True):
    """The touched group that can be picked first, before or after its change, as a row
    (bids_total, day, title_id); None if none of them can be picked at all."""
    delta = changes.select(*GROUP, F.col("bids_total").alias("more"))
    before = F.coalesce("bids_total", F.lit(0))
    reach = delta.join(totals, list(GROUP), "left").select(
        F.greatest(before, before + F.col("more")).alias("bids_total"), *GROUP
    )
    reach = reach.where(over_minimum(F.col("bids_total"), minimum, strict))
    found = reach.orderBy(F.desc("bids_total"), *GROUP).limit(1).collect()
    return found[0] if found else None


def _precedes(row) -> Column:
    total = F.lit(row["bids_total"])
    place = F.struct(*[F.col(n) for n in GROUP]) < F.struct(*[F.lit(row[n]).alias(n) for n in GROUP])
    return (F.col("bids_total") > total) | ((F.col("bids_total") == total) & place)


class Rebooked(NamedTuple):
    """A run that takes over the first ``stood`` events of the run before."""

    events: DataFrame
    booked: DataFrame
    stood: int
    replayed: bool


def rebook(
    events: DataFrame,
    booked: DataFrame,
    bids: DataFrame,
    slots: DataFrame,
    totals: DataFrame,
    changes: DataFrame,
    minimum=S.SERVICE_MINIMUM,
    strict: bool = True,
    **options,
) -> Rebooked:
    """I8: the run over ``bids`` and ``slots`` as they are now, given the run before.

    ``totals`` are those before, ``changes`` what has been added to them since (for every
    touched group). No bid may be negative or incomplete, before or now. The result equals
    ``book(bids, slots)``.
    """
    border = first_reach(totals, changes, minimum, strict)
    if border is None:
        return Rebooked(events, booked, events.count(), False)
    standing = events.where(_precedes(border))
    stood = standing.count()
    kept = booked.where(F.col("event_rank") <= stood)
    if stood:
        bids = bids.join(kept.select("user_id", "title_id").distinct(), ["user_id", "title_id"], "left_anti")
        slots = slots.join(kept.select("user_id", "day").distinct(), ["user_id", "day"], "left_anti")
    rest = book(bids, slots, minimum, strict, **options)
    later = (F.col("event_rank") + stood).alias("event_rank")

    def after(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        return rows.select(*[later if n == "event_rank" else F.col(n) for n in columns])

    return Rebooked(
        standing.unionByName(after(rest.events, events.columns)),
        kept.unionByName(after(rest.booked, booked.columns)),
        stood,
        True,
    )


def with_outcome(events: DataFrame, booked: DataFrame, bids: DataFrame, slots: DataFrame) -> Bookings:
    """A run's events and booked rows with what they mean for every row of its tables."""
    # a user is booked once per day at most, so their bookings fit in one array
    wins = booked.groupBy("user_id").agg(
        F.collect_list(F.struct("event_rank", "day", "title_id")).alias("wins")
    )
    rows = interest_by_slot(bids, slots).join(wins, "user_id", "left")
    rows = rows.selectExpr(
        "user_id", "day", "title_id", "total_bid", "1L AS tickets",
        "exists(wins, w -> w.day = day AND w.title_id = title_id) AS own",
        "array_min(filter(wins, w -> w.day = day OR w.title_id = title_id)).event_rank AS cause_rank",
    )
    status = (
        F.when(F.col("own"), "B").when(F.col("cause_rank").isNotNull(), "C").otherwise("A").alias("status")
    )
    outcome = rows.select("user_id", *GROUP, "total_bid", "tickets", status, "cause_rank")
    return Bookings(events, booked, outcome)


def first_run(bids: DataFrame, slots: DataFrame, minimum=S.SERVICE_MINIMUM, strict: bool = True, **options):
    """The run that later ones take over from: (totals, events, booked), written."""
    totals = interest_by_slot(bids, slots).withColumn("sign", F.lit(1))
    run = book(bids, slots, minimum, strict, **options)
    return stored(total_changes(totals), "totals"), stored(run.events, "events"), stored(run.booked, "booked")
