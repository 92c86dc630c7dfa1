"""Bid and timeslot requests through the status transitions.

Requests are rows with a sequence number; within a batch they act in that
order, each seeing what earlier ones of its key did.

A refused request leaves the status as it is. An accepted one sets the status
it asked for, and from AVAILABLE and CANCELED_BY_USER on the status always
equals the one last asked for. So the status before a request is the starting
status until the first request that the starting status accepts, and after
that what the request just before asked for. Both are running values, which do
not need a key's requests in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from seatpool import schemas as S
from seatpool.functions import columns as C
from seatpool.functions.ordered import BLOCK, in_blocks, latest, running, sized
from seatpool.session import stored

# Days of a stretch by which periods of validity and requests meet.
VERSION_DAYS = 32

_TRANSITION = T.StructType(
    [
        T.StructField("old_status", T.StringType()),
        T.StructField("new_status", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
)


def transitions(spark: SparkSession, machine: Sequence[tuple]) -> DataFrame:
    """A transition table; its size is fixed."""
    return F.broadcast(spark.createDataFrame(list(machine), _TRANSITION))


# ---------------------------------------------------------------- checks


def title_valid(now) -> Column:
    """Now is between midnights of the title's from and to."""
    moment = F.lit(now).cast("timestamp")
    return moment.between(F.col("title_from").cast("timestamp"), F.col("title_to").cast("timestamp"))


def at_their_time(requests: DataFrame, versions: DataFrame, days: int = VERSION_DAYS) -> DataFrame:
    """P7 for requests that carry the moment they were made, ``at``: adds ``title_known`` and
    ``title_valid``.

    ``versions`` has a row per period (title_id, from, to) in which a title is on offer, ends
    included; periods may overlap or leave gaps. Periods are cut at stretches of ``days`` days,
    and a request looks only at those of its title in its own stretch, so the join is one on
    equal values, and exact bounds are checked on what it finds.
    """
    micros = lambda moment: F.unix_micros(F.col(moment).cast("timestamp"))
    stretch = lambda moment: F.expr(f"unix_date(to_date(`{moment}`)) DIV {days}").cast("int")
    titles = versions.select("title_id").distinct()
    periods = (
        versions.where(F.col("to") >= F.col("from"))
        .select("title_id", "from", "to", F.explode(F.sequence(stretch("from"), stretch("to"))).alias("stretch"))
        .groupBy("title_id", "stretch")
        .agg(
            F.collect_set(F.struct(micros("from").alias("first"), micros("to").alias("last"))).alias("periods")
        )
    )
    cut, known = stored(periods, "periods"), stored(titles, "titles")
    known = sized(known.select("title_id", F.lit(True).alias("title_known")), known.count())
    inside = F.exists("periods", lambda p: micros("at").between(p["first"], p["last"]))
    return (
        requests.withColumn("stretch", stretch("at"))
        .join(sized(cut, cut.count()), ["title_id", "stretch"], "left")
        .join(known, "title_id", "left")
        .withColumns({
            "title_known": F.coalesce("title_known", F.lit(False)),
            "title_valid": F.coalesce(inside, F.lit(False)),
        })
        .drop("stretch", "periods")
    )


def day_reason(now, day: Column | None = None, zone: str = S.USER_ZONE) -> Column:
    """Why a day cannot be declared free, or null."""
    day = F.col("day") if day is None else day
    first = C.today(now, zone)
    return F.when(day < first, S.DAY_IN_PAST).when(
        day > F.date_add(first, S.DAYS_AHEAD), S.DAY_TOO_FAR
    )


def with_defaults(requests: DataFrame) -> DataFrame:
    """P10: what a request leaves out."""
    defaults = {
        "num_tickets": F.lit(1),
        "is_preapp": F.lit(True),
        "status": F.lit(S.AVAILABLE),
        "or_or_any": F.lit("ANY"),
    }
    present = {n: F.coalesce(n, v) for n, v in defaults.items() if n in requests.columns}
    return requests.withColumns(present) if present else requests


def contract_rejects(requests: DataFrame) -> DataFrame:
    """Requests outside the declared ranges, with the first reason."""
    reason = C.first_reason(
        [
            (F.col("user_id").rlike(S.USERNAME_PATTERN), "username"),
            (F.col("ticket_bid").between(*S.TICKET_BID_RANGE), "ticket_bid"),
            (F.col("num_tickets").between(*S.NUM_TICKETS_RANGE), "num_tickets"),
        ]
    )
    return requests.withColumn("reason", reason).where("reason IS NOT NULL")


# ---------------------------------------------------------------- transitions


class Outcome(NamedTuple):
    """Verdict per request, and the changes of accepted requests in their order."""

    results: DataFrame
    changes: DataFrame


def _decide(
    requests: DataFrame,
    state: DataFrame,
    key: Sequence[str],
    machine: Sequence[tuple],
) -> DataFrame:
    """Add ``accepted`` and ``text`` to requests ``in_blocks`` whose ``refusal`` is null."""
    spark = requests.sparkSession
    table = transitions(spark, machine)
    start = state.select(*key, F.col("status").alias("start_status"))
    asked = requests.where("refusal IS NULL").join(start, list(key), "left")
    at_start = table.select(
        F.col("old_status").alias("s_old"),
        F.col("new_status").alias("s_new"),
        F.col("accepted").alias("s_accepted"),
    )
    asked = asked.join(
        at_start,
        F.col("start_status").eqNullSafe(F.col("s_old")) & (F.col("status") == F.col("s_new")),
        "left",
    ).drop("s_old", "s_new")
    asked = running(
        asked,
        key,
        "seq",
        firsts={"left_start": F.when(F.col("s_accepted"), F.col("seq"))},
        previous={"asked_before": "status"},
    )
    before = F.when(F.col("left_start").isNull(), F.col("start_status")).otherwise(
        F.col("asked_before")
    )
    asked = asked.withColumn("status_before", before).drop(
        "left_start", "asked_before", "s_accepted", "start_status"
    )
    decided = asked.join(
        table,
        F.col("status_before").eqNullSafe(F.col("old_status"))
        & (F.col("status") == F.col("new_status")),
        "left",
    ).drop("old_status", "new_status")
    return decided.withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn(
        "text", F.coalesce("text", F.lit(S.UNDEFINED_TRANSITION))
    )


def _results(requests: DataFrame, decided: DataFrame, key: Sequence[str]) -> DataFrame:
    """One verdict per request."""
    refused = requests.where("refusal IS NOT NULL").select(
        "seq", *key, F.lit(False).alias("ok"), F.col("refusal").alias("message")
    )
    answered = decided.select(
        "seq", *key, F.col("accepted").alias("ok"), F.col("text").alias("message")
    )
    return answered.unionByName(refused).withColumn("result", result_message())


def result_message() -> Column:
    """R14 as the caller sees it."""
    errors = F.to_json(
        F.struct(F.lit("client_error").alias("reason"), F.array("message").alias("errors"))
    )
    return F.when(F.col("ok"), '"success"').otherwise(errors)


def bid_requests(
    requests: DataFrame, titles: DataFrame, bids: DataFrame, now, block: int = BLOCK
) -> Outcome:
    """Requests (seq, op, user_id, title_id, status, ...) against the bid table.

    ``op`` is 'put' or 'cancel'. Only a put is checked against the title's
    dates and the statuses a user may ask for. Without ``now``, each request is judged
    at the moment ``at`` it was made, and a title may have several periods of validity.
    """
    key = ["user_id", "title_id"]
    checked = with_defaults(_cancels(in_blocks(requests, "seq", block)))
    if now is None:
        checked = at_their_time(checked, titles)
        known, valid = F.col("title_known"), F.col("title_valid")
    else:
        dates = titles.select(
            "title_id", F.col("from").alias("title_from"), F.col("to").alias("title_to")
        )
        checked = checked.join(dates, "title_id", "left")
        known, valid = F.col("title_from").isNotNull(), title_valid(now)
    refusal = C.first_reason(
        [
            (known, S.NO_SUCH_TITLE),
            (valid, S.TITLE_EXPIRED),
            (F.col("status").isin(S.AVAILABLE, S.CANCELED_BY_USER), S.BID_STATUS_RULE),
        ]
    )
    needed = key if now is not None else [*key, "at"]
    checked = checked.withColumn("refusal", _refusal(needed, refusal))
    checked = checked.drop("title_from", "title_to", "title_known", "title_valid")
    decided = _decide(checked, bids, key, S.BID_TRANSITIONS)
    return Outcome(_results(checked, decided, key), decided.where("accepted"))


def timeslot_requests(
    requests: DataFrame, slots: DataFrame, now, zone: str = S.USER_ZONE, block: int = BLOCK
) -> Outcome:
    """Requests (seq, op, user_id, day, status) against the timeslot table. Without
    ``now``, each request is judged at the moment ``at`` it was made."""
    key = ["user_id", "day"]
    refusal = F.coalesce(
        F.when(F.col("status") != S.AVAILABLE, S.TIMESLOT_STATUS_RULE),
        day_reason(F.col("at") if now is None else now, zone=zone),
    )
    checked = with_defaults(_cancels(in_blocks(requests, "seq", block)))
    needed = key if now is not None else [*key, "at"]
    checked = checked.withColumn("refusal", _refusal(needed, refusal))
    decided = _decide(checked, slots, key, S.TIMESLOT_TRANSITIONS)
    return Outcome(_results(checked, decided, key), decided.where("accepted"))


def _refusal(key: Sequence[str], put: Column) -> Column:
    """Why a request is not looked at: it has no place in the order, no key or no known
    operation; or, for a put, ``put``."""
    whole = F.col("seq").isNotNull()
    for name in key:
        whole = whole & F.col(name).isNotNull()
    known = F.coalesce(F.col("op").isin("put", "cancel"), F.lit(False))
    return (
        F.when(~whole, S.INCOMPLETE_REQUEST)
        .when(~known, S.UNKNOWN_OPERATION)
        .when(F.col("op") == "put", put)
    )


def _cancels(requests: DataFrame) -> DataFrame:
    asked = F.when(F.col("op") == "cancel", S.CANCELED_BY_USER).otherwise(F.col("status"))
    return requests.withColumn("status", asked)


def after_requests(
    table: DataFrame, changes: DataFrame, key: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """The table after a batch: rows of the last put, status of the last change.

    A cancel changes the status only, so the other fields come from the last
    accepted put, or from the table where there was none.
    """
    put_seq = F.when(F.col("op") == "put", F.col("seq"))
    touched = changes.groupBy(*key).agg(
        F.max_by(F.struct(*fields), put_seq).alias("put"),
        F.max_by("status", "seq").alias("new_status"),
    )
    kept = F.struct(*fields)
    return (
        table.select(*key, F.col("status").alias("old_status"), kept.alias("old"))
        .join(touched, list(key), "full")
        .select(
            *key,
            F.coalesce("new_status", "old_status").alias("status"),
            *[
                F.when(F.col("put").isNotNull(), F.col(f"put.{name}"))
                .otherwise(F.col(f"old.{name}"))
                .alias(name)
                for name in fields
            ],
        )
    )


def preferences_after(table: DataFrame | None, requests: DataFrame) -> DataFrame:
    """Preferences by user, last write wins, no transitions."""
    changes = with_defaults(requests)
    last = latest(changes, ["user_id"], ["seq"]).select("user_id", "is_preapp", "or_or_any")
    if table is None:
        return last
    kept = table.join(last.select("user_id"), "user_id", "left_anti")
    return kept.select(*last.columns).unionByName(last)
