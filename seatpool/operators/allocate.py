"""Greedy group booking (operators I1 to I7).

The rule is sequential: take the group with the largest total, book all its
open rows, close every row of the booked users that shares a day or a title
with the booking, and repeat while a total exceeds the minimum. One job per
group would need as many passes over the data as there are events.

Two groups disturb each other only if some user has open rows in both and the
rows share a value on an axis (a day or a title). With bids that are not
negative, closing rows only lowers totals. So a group that precedes, by (total
descending, group ascending), every group it can disturb will be picked by the
sequential rule with exactly its present total, whatever happens elsewhere.
All such groups can be booked in one round: the locally dominant choice known
from greedy matching. They are found by votes: every user names the first group
per day and the first per title, and a group is dominant if it is named on both
axes by all of its rows. Where most users want the same things, a cheaper test
finds as many: a group that is first among all groups of its day and of its
title needs no votes. A round uses votes until they find no more than that.

State is nested per user: the open bids and the open days, not their product.
Group totals are a table: the state is expanded once for them, inside the task and
summed before the exchange, and a round takes from them what it closed, so only the
users it hit are expanded again. Votes move one row per user and axis value. Winners
go out as whole numbers, so applying them is a scan without a shuffle. The state is
written every few rounds, which cuts lineage and lets later rounds skip users with
nothing left.
Users with more options than a row should hold are split into parts; bookings
of such a user are shared between the parts.

Groups are numbered in tie-break order, so that ``gid - total * groups`` is one
number that sorts like (total descending, group ascending).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seatpool import schemas
from seatpool.functions import ordered
from seatpool.functions.ordered import numbered, sized
from seatpool.session import discard, new_folder, stored, stored_in

# Options of one user kept in one nested row. Users above it are split.
OPTIONS_PER_ROW = 50_000
# Bids per file of a state, and so per task of a round.
ROWS_PER_FILE = 200_000
# Rounds computed from one written state.
ROUNDS_PER_WRITE = 4
# After this many rounds without votes, ask again whether votes find more; twice as many each
# time that they did not.
ROUNDS_WITHOUT_VOTES = 8
# Winners up to which a round names them in the scan of the state; more are a table to join.
# Totals of no more groups are kept on the driver between the rounds; more are a table.
WINNERS_IN_SCAN = 20_000
# Days from the start of year 1 to the end of year 9999.
CALENDAR_DAYS = 3_652_059
FIRST_OF_CALENDAR = "DATE'0001-01-01'"


class Shape(NamedTuple):
    """Columns that make a group, in tie-break order, and the two axes."""

    group: tuple[str, ...]
    axes: tuple[str, str]
    value: str


class Layout(NamedTuple):
    """How the open rows of a user are kept, and what a round does to them.

    ``rows`` is SQL that expands nested users to rows (user_id, gid, a1, a2,
    value, tickets), where a1 and a2 are the places on the two axes. Numbers of groups
    are below ``groups``, and ``known_groups`` bounds how many there are. ``hits`` is SQL
    for the rows a list of group numbers books; ``close`` gives for every array
    what is left of it, where ``hit1`` and ``hit2`` are the places of what is booked. ``named`` adds the group columns to rows with a gid. ``options``
    is the array that leaves what can never be booked to the array ``rest``.
    """

    shape: Shape
    groups: int
    known_groups: int
    rows: str
    hits: Callable[[Sequence[int]], str]
    close: dict[str, str]
    is_open: str
    named: Callable[[DataFrame], DataFrame]
    options: str


class Bookings(NamedTuple):
    """Result of a run. All members are lazy but the events, which are written."""

    events: DataFrame
    booked: DataFrame
    outcome: DataFrame

    def canceled(self) -> DataFrame:
        """Rows closed by a booking of the same user, with the first such event."""
        return self.outcome.where("status = 'C'").drop("status")

    def statuses(self) -> DataFrame:
        """Every input row with A (open), B (booked) or C (canceled)."""
        return self.outcome.drop("cause_rank")

    def with_causes(self) -> DataFrame:
        """I3 with the day and title of the event that closed each row."""
        group = [n for n in self.events.columns if n in self.outcome.columns]
        causes = self.events.select(
            F.col("event_rank").alias("cause_rank"), *[F.col(n).alias(f"cause_{n}") for n in group]
        )
        return self.canceled().join(causes, "cause_rank")

    def stats(self) -> DataFrame:
        """Events, money, booked rows and distinct booked users in one row."""
        events = self.events.agg(
            F.count("*").alias("events_found"),
            F.coalesce(F.sum("bids_total"), F.lit(0)).cast("bigint").alias("total_bids"),
        )
        rows = self.booked.agg(
            F.coalesce(F.sum("tickets"), F.lit(0)).cast("bigint").alias("rows_booked"),
            F.countDistinct("user_id").alias("unique_users"),
        )
        # one row each
        return events.join(F.broadcast(rows), F.lit(True))


# ---------------------------------------------------------------- totals


def over_minimum(total: Column, minimum, strict: bool = True) -> Column:
    return total > F.lit(minimum) if strict else total >= F.lit(minimum)


def group_totals(rows: DataFrame, group: Sequence[str], value: str = "total_bid") -> DataFrame:
    """A1, A2 and A4: summed bids and row count per group."""
    return rows.groupBy(*group).agg(
        F.sum(value).alias("bids_total"), F.count("*").alias("num_tickets")
    )


def ranked_groups(totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups by total, best first."""
    return totals.orderBy(F.desc("bids_total"), *group)


def best_group(
    totals: DataFrame, group: Sequence[str], minimum, strict: bool = True
) -> DataFrame:
    """The best group, if it clears the minimum."""
    clears = totals.where(over_minimum(F.col("bids_total"), minimum, strict))
    return ranked_groups(clears, group).limit(1)


# ---------------------------------------------------------------- layouts


def _calendar(shape: Shape, titles: DataFrame, count: int, days: int) -> Layout:
    """Rows are every open bid of a user on every open day of the user."""
    day, title = shape.axes
    # outer, then dropped: the inner form would push the whole nested expression down
    # as a filter and have it computed several times
    rows = f"""
        SELECT *, a1 * {count}L + a2 AS gid, 1L AS tickets
        FROM {{state}} LATERAL VIEW OUTER explode(days) AS a1
                       LATERAL VIEW OUTER inline(bids) AS a2, value
        WHERE a1 IS NOT NULL AND a2 IS NOT NULL"""

    def hits(winners: Sequence[int]) -> str:
        wanted = ", ".join(f"{w}L" for w in winners)
        named = ", ".join(f"{t}L" for t in sorted({w % count for w in winners}))
        dated = ", ".join(f"{d}L" for d in sorted({w // count for w in winners}))
        number = f"d * {count}L + b.title_no"
        return f"""flatten(transform(
            IF(exists(days, d -> d IN ({dated})), filter(bids, b -> b.title_no IN ({named})), slice(bids, 1, 0)),
            b -> transform(filter(days, d -> {number} IN ({wanted})),
                           d -> struct({number} AS gid, d AS a1, b.title_no AS a2, b.value, 1L AS tickets))))"""

    def named(rows: DataFrame) -> DataFrame:
        title_no = F.pmod(F.col("gid"), F.lit(count))
        rows = rows.join(titles, title_no == F.col("position"))
        since = F.expr(f"CAST(gid DIV {count} AS INT)")
        return rows.withColumn(day, F.date_add(F.expr(FIRST_OF_CALENDAR), since)).drop("position")

    return Layout(
        shape,
        CALENDAR_DAYS * count,
        days * count,
        rows,
        hits,
        close={
            "bids": "filter(bids, b -> NOT array_contains(hit2, b.title_no))",
            "days": "array_except(days, hit1)",
        },
        is_open="size(bids) > 0 AND size(days) > 0",
        named=named,
        options="bids",
    )


def _calendar_with_periods(shape: Shape, titles: DataFrame, count: int, days: int) -> Layout:
    """As ``_calendar``, but each entry of ``bids`` is open on the days of a period alone.
    Periods of one title do not overlap, so a user has one row per day and title."""
    plain = _calendar(shape, titles, count, days)
    rows = f"""
        SELECT *, a1 * {count}L + a2 AS gid
        FROM {{state}} LATERAL VIEW OUTER explode(days) AS a1
                       LATERAL VIEW OUTER inline(bids) AS a2, value, tickets, first_no, last_no
        WHERE a1 BETWEEN first_no AND last_no"""

    def hits(winners: Sequence[int]) -> str:
        wanted = ", ".join(f"{w}L" for w in winners)
        named = ", ".join(f"{t}L" for t in sorted({w % count for w in winners}))
        dated = ", ".join(f"{d}L" for d in sorted({w // count for w in winners}))
        number = f"d * {count}L + b.title_no"
        return f"""flatten(transform(
            IF(exists(days, d -> d IN ({dated})), filter(bids, b -> b.title_no IN ({named})), slice(bids, 1, 0)),
            b -> transform(filter(days, d -> d BETWEEN b.first_no AND b.last_no AND {number} IN ({wanted})),
                           d -> struct({number} AS gid, d AS a1, b.title_no AS a2, b.value, b.tickets))))"""

    is_open = "exists(bids, b -> exists(days, d -> d BETWEEN b.first_no AND b.last_no))"
    return plain._replace(rows=rows, hits=hits, is_open=is_open)


def _listed(shape: Shape, groups: DataFrame, count: int) -> Layout:
    """Rows are listed one by one; nothing is assumed about their combinations."""

    # outer, then dropped, as above
    rows = """
        SELECT * FROM {state} LATERAL VIEW OUTER inline(options) AS gid, a1, a2, value, tickets
        WHERE gid IS NOT NULL"""

    def hits(winners: Sequence[int]) -> str:
        wanted = ", ".join(f"{w}L" for w in winners)
        return f"filter(options, o -> o.gid IN ({wanted}))"

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(groups, F.col("gid") == F.col("position")).drop("position")

    return Layout(
        shape,
        count,
        count,
        rows,
        hits,
        close={
            "options": """filter(options, o -> NOT array_contains(hit1, o.a1)
                                           AND NOT array_contains(hit2, o.a2))"""
        },
        is_open="size(options) > 0",
        named=named,
        options="options",
    )


# ---------------------------------------------------------------- nesting


class _Sizes(NamedTuple):
    split_users: int
    total: int
    files: int


def _sizes(rows: DataFrame, value: str, per_row: int) -> _Sizes:
    per_user = rows.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum(F.abs(value)).alias("total")
    )
    found = per_user.agg(
        F.count_if(F.col("n") > per_row).alias("split"),
        F.sum("total").alias("total"),
        F.sum("n").alias("rows"),
    ).first()
    # enough partitions for every core and for the rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = max(cores, (found["rows"] or 0) // ROWS_PER_FILE)
    return _Sizes(found["split"], found["total"] or 0, files)


def _split(rows: DataFrame, per_row: int, split_users: int) -> DataFrame:
    """Users with more options than a row should hold, and their number of parts."""
    users = (
        rows.groupBy("user_id")
        .agg(F.ceil(F.count("*") / per_row).cast("int").alias("parts"))
        .where("parts > 1")
    )
    return sized(users, split_users)


def _nested(
    rows: DataFrame, users: DataFrame | None, key: str, name: str, row: Column, files: int
) -> DataFrame:
    """One row per user and part, with ``row`` of the live rows in the array ``name`` and of
    all others in ``rest``."""
    arrays = [
        F.collect_list(F.when(F.col("live"), row)).alias(name),
        F.collect_list(F.when(~F.col("live"), row)).alias("rest"),
    ]
    if users is None:
        grouped = rows.repartition(files, "user_id").groupBy("user_id")
        return grouped.agg(F.lit(0).alias("part"), F.lit(1).alias("parts"), *arrays)
    rows = rows.join(users, "user_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    rows = rows.repartition(files, "user_id", "part")
    return rows.groupBy("user_id", "part").agg(F.first("parts").alias("parts"), *arrays)


def _nest_calendar(
    bids: DataFrame, slots: DataFrame, users: DataFrame | None, files: int
) -> DataFrame:
    """Bids (user_id, title_no, value, live), with periods or without, and slots (user_id,
    day_no), one row per user and part."""
    row = F.struct(*[name for name in bids.columns if name not in ("user_id", "live")])
    bids = _nested(bids, users, "title_no", "bids", row, files)
    # a user's days are bounded by the calendar, so they fit in one array
    days = F.collect_set("day_no").alias("days")
    if users is None:
        slots = slots.repartition(files, "user_id").groupBy("user_id").agg(days)
        return bids.join(slots, "user_id")
    slots = slots.groupBy("user_id").agg(days).join(users, "user_id", "left")
    every_part = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    slots = slots.select("user_id", F.explode(every_part).alias("part"), "days")
    return bids.join(slots.repartition(files, "user_id", "part"), ["user_id", "part"])


def _nest_listed(rows: DataFrame, users: DataFrame | None, files: int) -> DataFrame:
    row = F.struct("gid", "a1", "a2", "value", "tickets")
    return _nested(rows, users, "gid", "options", row, files)


# ---------------------------------------------------------------- rounds


class _Ledger:
    """The states written during one run, as one table partitioned by write.

    The first holds all rows. Of any other only the users that are finished are needed once
    the next is written, so the rest of it is removed. Each write is in buckets by ``keys``, as
    the state was dealt out when it was nested, so that votes and bookings meet per user without
    a shuffle.
    """

    def __init__(
        self, spark: SparkSession, schema: T.StructType, layout: Layout, keys: Sequence[str], files: int
    ):
        self.spark = spark
        self.folder = new_folder(spark, "booking")
        self.table = f"seatpool_{self.folder.rsplit('/', 1)[-1].replace('-', '_')}"
        self.schema = T.StructType(schema.fields + [T.StructField("open", T.IntegerType())])
        self.layout = layout
        self.keys = keys
        self.files = files
        self.writes = 0

    def _named(self, write: int) -> str:
        return f"{self.table}_{write}"

    def write(self, state: DataFrame) -> DataFrame:
        self.writes += 1
        folder = f"{self.folder}/cut={self.writes}"
        with_flag = state.selectExpr("*", f"int({self.layout.is_open}) AS open")
        with_flag.write.partitionBy("open").bucketBy(self.files, *self.keys).saveAsTable(
            self._named(self.writes), format="parquet", path=folder
        )
        if self.writes > 2:
            self.forget(self.writes - 1)
            discard(self.spark, f"{self.folder}/cut={self.writes - 1}/open=1")
        return self.spark.table(self._named(self.writes)).where("open = 1").drop("open", "rest")

    def forget(self, write: int) -> None:
        """Drop the name of a write; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._named(write)}")

    def first(self) -> DataFrame:
        """Every user with all rows."""
        state = self.spark.table(self._named(1)).select(*self.schema.names)
        name = self.layout.options
        return state.withColumn(name, F.concat(name, "rest")).drop("rest")

    def last(self) -> DataFrame:
        """Every user once: as finished in some write, or as left by the last one."""
        schema = T.StructType(self.schema.fields + [T.StructField("cut", T.IntegerType())])
        return (
            self.spark.read.schema(schema)
            .parquet(self.folder)
            .where((F.col("open") == 0) | (F.col("cut") == self.writes))
        )


class _Run(NamedTuple):
    """What stays the same over the rounds of one run."""

    layout: Layout
    minimum: object
    strict: bool
    key: str
    sequential: bool
    split_users: int
    files: int
    rounds_per_write: int
    # (gid, a1, a2, bids_total, num_tickets, members) of the groups with open rows
    totals: DataFrame | None = None


def _key(layout: Layout, total: int, total_type: T.DataType) -> str:
    """SQL for one number that sorts like (total descending, gid ascending)."""
    if isinstance(total_type, T.DecimalType):
        scale = total_type.scale
    elif isinstance(total_type, T.IntegralType):
        scale = 0
    else:
        raise TypeError("bids must be whole numbers or decimals, so that sums are exact")
    units = f"bids_total * {10**scale}L" if scale else "bids_total"
    if (int(total) + 1) * 10**scale * layout.groups < 2**62:
        return f"gid - CAST({units} AS BIGINT) * {layout.groups}L"
    wide = "CAST({} AS DECIMAL(38, 0))"
    return f"{wide.format('gid')} - {wide.format(units)} * {wide.format(layout.groups)}"


def _sql(state: DataFrame, text: str, **others: DataFrame) -> DataFrame:
    return state.sparkSession.sql(text, state=state, **others)


def _rows(state: DataFrame, layout: Layout, *keep: str) -> DataFrame:
    columns = ("user_id", *keep, "gid", "a1", "a2", "value", "tickets")
    return _sql(state, f"SELECT {', '.join(columns)} FROM ({layout.rows})")


def _winners(state: DataFrame, run: _Run, by_votes: bool) -> DataFrame:
    """Groups to book now."""
    layout = run.layout
    clears = f"{'>' if run.strict else '>='} {run.minimum}"
    totals = f"""
        WITH totals AS (SELECT *, {run.key} AS place FROM {{totals}} WHERE bids_total {clears})"""
    result = "SELECT gid, a1, a2, bids_total, num_tickets, place FROM"
    if run.sequential:
        return _sql(state, f"{totals} {result} totals ORDER BY place LIMIT 1", totals=run.totals)
    small = layout.known_groups <= ordered.BROADCAST_ROWS
    if not by_votes and small:
        query = f"""{totals}
            {result} (SELECT *, min(place) OVER (PARTITION BY a1) AS one,
                                min(place) OVER (PARTITION BY a2) AS two FROM totals)
            WHERE place = one AND place = two"""
    elif not by_votes:
        # least places are taken per task first, so an axis value with many groups is no hot spot
        query = f"""{totals},
            one AS (SELECT min(place) AS place FROM totals GROUP BY a1),
            two AS (SELECT min(place) AS place FROM totals GROUP BY a2)
            {result} (SELECT * FROM totals LEFT SEMI JOIN one USING (place)
                                           LEFT SEMI JOIN two USING (place))"""
    else:
        # one vote per user and axis value; the place gives back the group
        hint = "/*+ BROADCAST(totals) */" if small else ""
        query = f"""{totals},
            rows AS ({layout.rows}),
            votes AS (
              SELECT axis, min(place) AS place FROM (
                SELECT {hint} user_id, place,
                       inline(array(struct(1 AS axis, rows.a1 AS at), struct(2 AS axis, rows.a2 AS at)))
                FROM rows JOIN totals ON rows.gid = totals.gid)
              GROUP BY user_id, axis, at),
            named AS (
              SELECT CAST(pmod(place, {layout.groups}) AS BIGINT) AS gid,
                     count_if(axis = 1) AS first, count_if(axis = 2) AS second
              FROM votes GROUP BY place)
            {result} (SELECT {hint} totals.* FROM named JOIN totals ON named.gid = totals.gid
                      WHERE members = first AND members = second)"""
    return _sql(state, query, totals=run.totals)


def _summed(rows: str) -> str:
    return f"""SELECT gid, a1, a2, sum(value) AS bids_total, sum(tickets) AS num_tickets, count(*) AS members
               FROM ({rows}) GROUP BY gid, a1, a2"""


def _closed_totals(run: _Run, hits: DataFrame) -> DataFrame:
    """What closing the rows that ``hits`` books takes from the group totals: every row is taken out
    once in a run, and users that were not hit are not expanded."""
    touched = hits.selectExpr(
        # emptied, not filtered, for the same reason as in the layouts
        *[f"IF(size(hits) > 0, {name}, slice({name}, 1, 0)) AS {name}" for name in run.layout.close],
        "hit1",
        "hit2",
    )
    rows = f"SELECT * FROM ({run.layout.rows}) WHERE array_contains(hit1, a1) OR array_contains(hit2, a2)"
    return _sql(touched, _summed(rows))


class _Totals:
    """The totals of groups with open rows between the rounds of a run: on the driver if all groups,
    counted beforehand, are as few as the winners it may see, and a table otherwise."""

    def __init__(self, state: DataFrame, run: _Run, total_type: T.DataType):
        self.spark, self.run, self.total_type = state.sparkSession, run, total_type
        totals = self._typed(_sql(state, _summed(run.layout.rows)))
        self.schema = totals.schema
        self.held: dict[int, tuple] | None = None
        self.folder, self.writes = new_folder(self.spark, "totals"), 0
        if run.layout.known_groups <= WINNERS_IN_SCAN:
            self.held = {row["gid"]: tuple(row) for row in totals.collect()}
        else:
            self.table = stored_in(totals, f"{self.folder}/0")

    def _typed(self, totals: DataFrame) -> DataFrame:
        return totals.withColumn("bids_total", F.col("bids_total").cast(self.total_type))

    def frame(self) -> DataFrame:
        if self.held is None:
            return self.table
        rows = [dict(zip(self.schema.names, row)) for row in self.held.values()]
        return self.spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(self.schema)), self.schema)

    def first(self) -> list[dict]:
        """Held groups that clear the minimum and come first on both their axes; one by one, the first."""
        ranked, firsts = [], ({}, {})
        for gid, a1, a2, total, _, _ in self.held.values():
            if total > self.run.minimum or (total == self.run.minimum and not self.run.strict):
                place = (-total, gid)
                ranked.append((place, a1, a2))
                for first, at in zip(firsts, (a1, a2)):
                    first[at] = min(place, first.get(at, place))
        if self.run.sequential:
            ranked = [min(ranked)] if ranked else []
        found = [(p, a1, a2) for p, a1, a2 in ranked if self.run.sequential or p == firsts[0][a1] == firsts[1][a2]]
        return [{"gid": place[1], "a1": a1, "a2": a2} for place, a1, a2 in found]

    def take(self, closed: DataFrame) -> None:
        """Take out what a round closed."""
        if self.held is not None:
            for gid, a1, a2, *less in closed.collect():
                left = [x - y for x, y in zip(self.held[gid][3:], less)]
                if left[-1]:
                    self.held[gid] = (gid, a1, a2, *left)
                else:
                    del self.held[gid]
            return
        numbers = ("bids_total", "num_tickets", "members")
        less = closed.select("gid", "a1", "a2", *[(-F.col(n)).alias(n) for n in numbers])
        sums = self.table.unionAll(less).groupBy("gid", "a1", "a2").agg(*[F.sum(n).alias(n) for n in numbers])
        self.table = stored_in(self._typed(sums.where("members > 0")), f"{self.folder}/{self.writes + 1}")
        discard(self.spark, f"{self.folder}/{self.writes}")
        self.writes += 1

    def end(self) -> None:
        discard(self.spark, self.folder)


def _hit(state: DataFrame, run: _Run, winners: Sequence[int]) -> DataFrame:
    """The state with what a round with few winners books: they are named in the scan."""
    hits = state.selectExpr("*", f"{run.layout.hits(winners)} AS hits")
    if run.split_users:
        shared = (
            hits.where("parts > 1 AND size(hits) > 0")
            .groupBy("user_id")
            .agg(F.expr("flatten(collect_list(hits)) AS shared"))
        )
        # a hit per day and split user at most
        hits = hits.join(sized(shared, run.split_users), "user_id", "left")
        hits = hits.withColumn("hits", F.coalesce("shared", "hits"))
    return hits


def _hit_by_table(state: DataFrame, run: _Run, winners: DataFrame, count: int) -> DataFrame:
    """The state with what a round with many winners (gid) books: they meet its rows in a join, and
    what is hit, a row per user and day at most, meets the users of the state."""
    rows = _rows(state, run.layout).join(sized(winners.select("gid"), count), "gid")
    hits = rows.groupBy("user_id").agg(
        F.collect_list(F.struct("gid", "a1", "a2", "value", "tickets")).alias("hits")
    )
    state = state.join(hits, "user_id", "left")
    return state.withColumn("hits", F.coalesce("hits", F.slice("booked", 1, 0)))


def _closed(state: DataFrame, layout: Layout) -> DataFrame:
    """The state after a round."""
    columns = [n for n in state.columns if n not in ("booked", "hits", "hit1", "hit2", "shared", *layout.close)]
    # a round hits few users, and the others need not be looked through
    closed = [f"IF(size(hits) > 0, {sql}, {name}) AS {name}" for name, sql in layout.close.items()]
    return state.selectExpr(*columns, *closed, "IF(size(hits) > 0, concat(booked, hits), booked) AS booked")


def _play(nested: DataFrame, run: _Run, total_type: T.DataType):
    """Play all rounds; the groups booked come back in their order if they came one by one."""
    layout = run.layout
    types = {f.name: f.dataType.simpleString() for f in _rows(nested, layout).schema}
    fields = ",".join(f"{name}:{types[name]}" for name in ("gid", "a1", "a2", "value", "tickets"))
    booked_type = f"array<struct<{fields}>>"
    nested = nested.withColumn("booked", F.expr(f"CAST(array() AS {booked_type})"))
    keys = ("user_id", "part") if run.split_users else ("user_id",)
    ledger = _Ledger(nested.sparkSession, nested.schema, layout, keys, run.files)
    state = ledger.write(nested)
    # each part of a split user needs the others, so a round reads its state twice
    rounds_per_write = 1 if run.split_users else run.rounds_per_write
    totals = _Totals(state, run, total_type)
    events, pending, quiet, patience = [], 0, 0, ROUNDS_WITHOUT_VOTES
    while True:
        by_votes = quiet == 0 and not run.sequential
        if totals.held is not None and not by_votes:
            winners = totals.first()
        else:
            found = _winners(state, run._replace(totals=totals.frame()), by_votes)
            winners = found.limit(WINNERS_IN_SCAN + 1).collect()
        if not winners:
            break
        many = len(winners) > WINNERS_IN_SCAN
        if many:
            found = stored(found, "winners")
            counts = found.agg(
                F.count("*").alias("gid"),
                *[F.countDistinct(axis).alias(axis) for axis in ("a1", "a2")],
            ).first()
        else:
            counts = {name: len({w[name] for w in winners}) for name in ("gid", "a1", "a2")}
        if by_votes:
            # winners that share a day or a title are those only votes can tell
            shared = counts["gid"] > min(counts["a1"], counts["a2"])
            quiet, patience = (0, ROUNDS_WITHOUT_VOTES) if shared else (patience, 2 * patience)
        else:
            quiet -= 1
        if run.sequential:
            events.append(winners[0]["gid"])
        if many:
            hits = _hit_by_table(state, run, found, counts["gid"])
        else:
            hits = _hit(state, run, [w["gid"] for w in winners])
        hits = hits.selectExpr("*", "hits.a1 AS hit1", "hits.a2 AS hit2")
        totals.take(_closed_totals(run, hits))
        state = _closed(hits, layout)
        pending += 1
        if many or pending == rounds_per_write:
            state, pending = ledger.write(state), 0
    if pending:
        ledger.write(state)
    totals.end()
    if ledger.writes > 1:
        ledger.forget(ledger.writes)
    return events, ledger


def _bookings(nested: DataFrame, run: _Run, total_type: T.DataType) -> Bookings:
    layout, shape = run.layout, run.layout.shape
    order, ledger = _play(nested, run, total_type)
    entries = ledger.last().selectExpr("user_id", "inline(booked)")
    if run.split_users:
        entries = entries.distinct()
    ranked, count = _ranked(entries, order if run.sequential else None, total_type)
    ranked = sized(ranked, count)
    frame = layout.named(ranked).select("event_rank", *shape.group, "bids_total", "num_tickets")
    entries = entries.join(ranked.select("gid", "event_rank"), "gid")
    booked = layout.named(entries).select(
        "user_id", *shape.group, F.col("value").alias(shape.value), "tickets", "event_rank"
    )

    # a user is booked once per day and per title at most, so their bookings fit in two maps, which
    # compiled code looks up for each row
    wins = entries.groupBy("user_id").agg(F.expr("collect_list(struct(event_rank, gid, a1, a2)) AS wins"))
    wins = wins.selectExpr(
        "user_id", "map_from_arrays(wins.a1, wins) AS wins1", "map_from_arrays(wins.a2, wins.event_rank) AS wins2"
    )
    # read from the same files as the state, so users meet their bookings on user_id alone
    rows = _rows(ledger.first().join(wins, "user_id", "left"), layout, "wins1", "wins2")
    rows = rows.selectExpr(
        "user_id",
        "gid",
        "value",
        "tickets",
        "coalesce(wins1[a1].gid = gid, false) AS own",
        "least(wins1[a1].event_rank, wins2[a2]) AS cause_rank",
    )
    outcome = layout.named(rows).select(
        "user_id",
        *shape.group,
        F.col("value").alias(shape.value),
        "tickets",
        F.when(F.col("own"), "B")
        .when(F.col("cause_rank").isNotNull(), "C")
        .otherwise("A")
        .alias("status"),
        "cause_rank",
    )
    return Bookings(frame, booked, outcome)


def _ranked(entries: DataFrame, order: list | None, total_type: T.DataType):
    """The events of a run out of its booked rows, in their order; and how many there are.

    The sequential rule picks totals that never rise unless bids are negative, so the order
    is by total, then group. Groups that were picked one by one come as a list.
    """
    events = entries.groupBy("gid").agg(
        F.sum("value").cast(total_type).alias("bids_total"),
        F.sum("tickets").cast("bigint").alias("num_tickets"),
    )
    if order is None:
        events, count = numbered(events.withColumn("down", -F.col("bids_total")), ["down", "gid"])
        events = events.withColumn("event_rank", F.col("position") + 1)
    else:
        # there was a job for each of them
        places = entries.sparkSession.createDataFrame(
            [(i + 1, gid) for i, gid in enumerate(order)], "event_rank bigint, gid bigint"
        )
        events, count = events.join(places, "gid"), len(order)
    return events.select("event_rank", "gid", "bids_total", "num_tickets"), count


# ---------------------------------------------------------------- runs


def unbookable(rows: DataFrame, needed: Sequence[str], value: str = "total_bid") -> DataFrame:
    """Rows that rounds leave out, with the reason."""
    whole = F.lit(True)
    for name in (*needed, value):
        whole = whole & F.col(name).isNotNull()
    reason = F.when(~whole, schemas.INCOMPLETE_BID).when(F.col(value) < 0, schemas.NEGATIVE_BID)
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def _bookable(rows: DataFrame, needed: Sequence[str], value: str, sequential: bool) -> DataFrame:
    rows = rows.dropna(subset=[*needed, value])
    return rows if sequential else rows.where(F.col(value) >= 0)


def _day_no(day: Column) -> Column:
    return F.datediff(day, F.expr(FIRST_OF_CALENDAR)).cast("bigint")


def periods(bids: DataFrame) -> DataFrame:
    """Bids (user_id, title_id, total_bid, from, to) as periods that do not overlap: user_id,
    title_id, total_bid, tickets, first_no, last_no.

    Bids of one user for one title add up on the days they share. A bid counts on days d with
    from <= d <= to, where a day is its first moment; bids without from or to, and those that end
    before they begin, count on none. Each bid leaves its value at its first day and takes it back
    after its last; running sums over those days, of which a calendar has few, are the periods.
    """
    first, last = F.to_date("from"), F.to_date("to")
    first = F.when(first.cast("timestamp") < F.col("from").cast("timestamp"), F.date_add(first, 1)).otherwise(first)
    rows = bids.select("user_id", "title_id", "total_bid", _day_no(first).alias("first_no"), _day_no(last).alias("last_no"))
    rows = rows.where("first_no <= last_no")
    steps = rows.selectExpr(
        "user_id", "title_id",
        "inline(array(struct(first_no AS at, total_bid AS value, 1L AS n), struct(last_no + 1 AS at, -total_bid AS value, -1L AS n)))",
    )
    steps = steps.groupBy("user_id", "title_id", "at").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    order = Window.partitionBy("user_id", "title_id").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(
        "user_id", "title_id", F.sum("value").over(upto).alias("total_bid"), F.sum("n").over(upto).alias("tickets"),
        F.col("at").alias("first_no"), (F.lead("at").over(order) - 1).alias("last_no"),
    ).where("tickets > 0")


def _live(value: str, minimum, strict: bool, sequential: bool) -> Column:
    """Whether the rows of a group can ever be booked. Totals do not rise unless bids are
    negative, which only the sequential form takes."""
    return F.lit(True) if sequential else over_minimum(F.sum(value), minimum, strict)


def book(
    bids: DataFrame,
    slots: DataFrame,
    minimum=schemas.SERVICE_MINIMUM,
    strict: bool = True,
    sequential: bool = False,
    respect_validity: bool = False,
    per_row: int = OPTIONS_PER_ROW,
    rounds_per_write: int = ROUNDS_PER_WRITE,
) -> Bookings:
    """I1 over bids (user_id, title_id, total_bid) and free days (user_id, day).

    Bids of one user for one title add up to one. Bids without user, title or amount and
    negative bids, which no contract allows, are left out; ``unbookable`` lists them.
    ``sequential`` books one group per round and takes negative bids too, since totals may
    rise then. ``respect_validity`` books a bid only on days between its from and to, which the
    state keeps as ``periods`` next to the days; their product is formed inside a task alone.
    """
    shape = Shape(("day", "title_id"), ("day", "title_id"), "total_bid")
    # read several times below, and possibly the result of a long plan
    kept = ["from", "to"] if respect_validity else []
    bids = bids.select("user_id", "title_id", "total_bid", *kept)
    bids = _bookable(bids, ["user_id", "title_id"], "total_bid", sequential)
    if respect_validity:
        bids = periods(bids)
    else:
        bids = bids.groupBy("user_id", "title_id").agg(F.sum("total_bid").alias("total_bid"))
    bids = stored(bids, "bids")
    sizes = _sizes(bids, "total_bid", per_row)
    # no day of a title has more than all its bids
    live = _live("total_bid", minimum, strict, sequential)
    titles, count = numbered(bids.groupBy("title_id").agg(live.alias("live")), ["title_id"])
    titles = sized(titles, count)
    days = slots.select("day").distinct().count()
    layout = _calendar_with_periods if respect_validity else _calendar
    layout = layout(shape, titles.drop("live"), max(count, 1), days)
    period = ["tickets", "first_no", "last_no"] if respect_validity else []
    bids = bids.join(titles, "title_id").selectExpr(
        "user_id", "position AS title_no", "total_bid AS value", "live", *period
    )
    slots = slots.select("user_id", _day_no(F.col("day")).alias("day_no")).where("day_no IS NOT NULL")
    users = _split(bids, per_row, sizes.split_users) if sizes.split_users else None
    nested = _nest_calendar(bids, slots, users, sizes.files)
    return _run(nested, layout, sizes, minimum, strict, sequential, rounds_per_write)


def allocate(
    rows: DataFrame,
    shape: Shape,
    minimum,
    strict: bool = True,
    sequential: bool = False,
    per_row: int = OPTIONS_PER_ROW,
    rounds_per_write: int = ROUNDS_PER_WRITE,
) -> Bookings:
    """Greedy booking over listed rows (user_id, group columns, value).

    Rows without user, group or value cannot be booked and are left out, and negative ones
    unless the run is ``sequential``.
    """
    rows = _bookable(rows, ["user_id", *shape.group], shape.value, sequential)
    rows = rows.groupBy("user_id", *shape.group).agg(
        F.sum(shape.value).alias("value"), F.count("*").alias("tickets")
    )
    rows = stored(rows, "rows")
    sizes = _sizes(rows, "value", per_row)
    live = _live("value", minimum, strict, sequential)
    groups, count = numbered(rows.groupBy(*shape.group).agg(live.alias("live")), shape.group)
    # the place on an axis goes by the first group there, a whole number
    places = groups
    for axis, at in zip(shape.axes, ("a1", "a2")):
        places = places.join(sized(groups.groupBy(axis).agg(F.min("position").alias(at)), count), axis)
    places = stored(places, "places")
    groups = sized(groups, count)
    layout = _listed(shape, groups.drop("live"), max(count, 1))
    rows = rows.join(sized(places, count), list(shape.group)).select(
        "user_id",
        F.col("position").alias("gid"),
        "a1",
        "a2",
        "value",
        "tickets",
        "live",
    )
    users = _split(rows, per_row, sizes.split_users) if sizes.split_users else None
    nested = _nest_listed(rows, users, sizes.files)
    return _run(nested, layout, sizes, minimum, strict, sequential, rounds_per_write)


def _run(nested, layout, sizes, minimum, strict, sequential, rounds_per_write) -> Bookings:
    rows = _rows(nested, layout)
    total_type = rows.agg(F.sum("value").alias("total")).schema["total"].dataType
    run = _Run(
        layout,
        minimum,
        strict,
        _key(layout, sizes.total, total_type),
        sequential,
        sizes.split_users,
        sizes.files,
        rounds_per_write,
    )
    return _bookings(nested, run, total_type)


def book_venues(
    rows: DataFrame, minimum=schemas.VENUE_MINIMUM, strict: bool = False, **options
) -> Bookings:
    """I4 over rows (user_id, title_id, timeslot, venue_id, total_bid)."""
    shape = Shape(("timeslot", "title_id", "venue_id"), ("timeslot", "title_id"), "total_bid")
    return allocate(rows, shape, minimum, strict, **options)
