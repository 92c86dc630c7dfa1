"""The registered queries, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seatpool import schemas as S
from seatpool.functions.columns import composite_key
from seatpool.functions.ordered import first_by
from seatpool.operators import allocate as A, applying, expand, indexes, joins, listings, metrics
from seatpool.operators import requests as R
from seatpool.operators.upsert import change_status
from seatpool.plans import domain as D
from seatpool.session import new_folder, stored
from seatpool.sinks import writers
from seatpool.sources import readers
from seatpool.streaming import jobs, rebooking

Query = Callable[[SparkSession, str], DataFrame]

MINIMUM = 1000
VENUE_MINIMUM = 150
SWEEP_MINIMUM = 300
VALID_MINIMUM = 60
GROUP = ("day", "title_id")
VENUE_GROUP = ("timeslot", "title_id", "venue_id")

_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its name; days leave as ISO text, decimals as doubles."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = build(spark, sf_dir)
        plain = {}
        for field in rows.schema:
            if field.dataType == T.DateType():
                plain[field.name] = F.date_format(field.name, S.ISO_DAY)
            elif isinstance(field.dataType, T.DecimalType):
                plain[field.name] = F.col(field.name).cast("double")
        return rows.withColumns(plain) if plain else rows

    _QUERIES[build.__name__] = run
    return build


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


# ---------------------------------------------------------------- sources


@query
def available_bids(spark, sf_dir):
    return readers.available_bids(D.raw_bids(spark, sf_dir))


@query
def available_timeslots(spark, sf_dir):
    return readers.available_timeslots(D.user_timeslots(spark, sf_dir))


@query
def dedup_first_bid(spark, sf_dir):
    rows = D.raw_bids(spark, sf_dir)
    order = ["l_orderkey", "l_linenumber", "total_bid"]
    return first_by(rows.select("user_id", "title_id", *order), ["user_id", "title_id"], order)


# ---------------------------------------------------------------- joins and totals


@query
def interest_by_slot(spark, sf_dir):
    return joins.interest_by_slot(D.interest(spark, sf_dir), D.free_days(spark, sf_dir))


@query
def unmatched_interest(spark, sf_dir):
    bids = D.user_bids(spark, sf_dir)
    return joins.unmatched_interest(bids, D.free_days(spark, sf_dir))


@query
def group_totals(spark, sf_dir):
    return A.group_totals(interest_by_slot(spark, sf_dir), GROUP)


@query
def ranked_groups(spark, sf_dir):
    return A.ranked_groups(group_totals(spark, sf_dir), GROUP)


@query
def best_group(spark, sf_dir):
    return A.best_group(group_totals(spark, sf_dir), GROUP, MINIMUM)


@query
def venue_totals(spark, sf_dir):
    return A.group_totals(D.venue_bids(spark, sf_dir), VENUE_GROUP)


@query
def best_show(spark, sf_dir):
    totals = venue_totals(spark, sf_dir)
    return A.best_group(totals, VENUE_GROUP, VENUE_MINIMUM, strict=False)


# ---------------------------------------------------------------- booking


def booking(spark: SparkSession, sf_dir: str, minimum: int = MINIMUM) -> A.Bookings:
    return A.book(D.interest(spark, sf_dir), D.free_days(spark, sf_dir), minimum)


@query
def booking_events(spark, sf_dir):
    return booking(spark, sf_dir).events


@query
def booking_events_valid(spark, sf_dir):
    """Bids count on the days of their own period alone."""
    bids, slots = D.bids_with_periods(spark, sf_dir), D.free_days(spark, sf_dir)
    return A.book(bids, slots, VALID_MINIMUM, respect_validity=True).events


@query
def booked_rows(spark, sf_dir):
    return booking(spark, sf_dir).booked.drop("tickets")


@query
def canceled_rows(spark, sf_dir):
    rows = booking(spark, sf_dir).with_causes().withColumnRenamed("cause_title_id", "cause_title")
    return rows.drop("tickets")


@query
def final_status(spark, sf_dir):
    return booking(spark, sf_dir).statuses().drop("tickets")


@query
def run_stats(spark, sf_dir):
    return booking(spark, sf_dir).stats()


@query
def venue_booking_events(spark, sf_dir):
    return A.book_venues(D.venue_bids(spark, sf_dir), VENUE_MINIMUM).events


# ---------------------------------------------------------------- messages and their application


@query
def event_messages(spark, sf_dir):
    lines = writers.event_messages(booking(spark, sf_dir).events)
    return readers.event_messages(lines)


@query
def reservation_messages(spark, sf_dir):
    lines = writers.reservation_messages(booking(spark, sf_dir).booked)
    return readers.reservation_messages(lines, seq=False)


@query
def show_events(spark, sf_dir):
    return applying.show_events(event_messages(spark, sf_dir), D.titles(spark, sf_dir))


def _applied(spark: SparkSession, sf_dir: str) -> applying.Applied:
    return applying.apply_reservations(
        D.reservation_requests(spark, sf_dir),
        D.titles(spark, sf_dir),
        D.user_bids(spark, sf_dir),
        D.user_timeslots(spark, sf_dir),
    )


@query
def bookings(spark, sf_dir):
    return _applied(spark, sf_dir).bookings


@query
def bids_after_apply(spark, sf_dir):
    after = applying.bids_after(D.user_bids(spark, sf_dir), _applied(spark, sf_dir))
    return after.select("user_id", "title_id", "status", "user_id_status", "orphan")


@query
def status_changes(spark, sf_dir):
    """Timeslots that reservations ask for, taken where they are AVAILABLE."""
    requests = D.reservation_requests(spark, sf_dir)
    slots = D.user_timeslots(spark, sf_dir)
    return change_status(slots, requests, ["user_id", "day"], S.BOOKED, S.AVAILABLE)


@query
def slots_after_apply(spark, sf_dir):
    after = applying.slots_after(D.user_timeslots(spark, sf_dir), _applied(spark, sf_dir))
    return after.select("user_id", "day", "status")


@query
def rejected_messages(spark, sf_dir):
    return applying.rejected(_applied(spark, sf_dir))


# ---------------------------------------------------------------- requests


def _bid_outcome(spark: SparkSession, sf_dir: str) -> R.Outcome:
    return R.bid_requests(
        D.bid_requests(spark, sf_dir), D.titles(spark, sf_dir), D.user_bids(spark, sf_dir), D.NOW
    )


def _timeslot_outcome(spark: SparkSession, sf_dir: str) -> R.Outcome:
    return R.timeslot_requests(
        D.timeslot_requests(spark, sf_dir), D.user_timeslots(spark, sf_dir), D.NOW
    )


@query
def bid_requests_result(spark, sf_dir):
    return _bid_outcome(spark, sf_dir).results


@query
def timeslot_requests_result(spark, sf_dir):
    return _timeslot_outcome(spark, sf_dir).results


@query
def bids_after_requests(spark, sf_dir):
    return R.after_requests(
        D.user_bids(spark, sf_dir),
        _bid_outcome(spark, sf_dir).changes,
        jobs.BidRequests.key,
        jobs.BidRequests.fields,
    )


@query
def timeslots_after_requests(spark, sf_dir):
    changes = _timeslot_outcome(spark, sf_dir).changes
    slots = D.user_timeslots(spark, sf_dir)
    return R.after_requests(slots, changes, ["user_id", "day"], ["is_preapp"])


@query
def preferences(spark, sf_dir):
    users = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    stated = R.preferences_after(None, D.preference_requests(spark, sf_dir))
    return listings.preferences_of(users, stated)


@query
def contract_rejects(spark, sf_dir):
    return R.contract_rejects(D.contract_requests(spark, sf_dir))


# ---------------------------------------------------------------- listings


@query
def user_active_bids(spark, sf_dir):
    return listings.active_bids(D.user_bids(spark, sf_dir))


@query
def active_bids_page(spark, sf_dir):
    """Two bids per user, continued from a key."""
    return listings.active_bids(D.user_bids(spark, sf_dir), limit=2, after="5")


@query
def user_timeslots(spark, sf_dir):
    return listings.timeslots(D.user_timeslots(spark, sf_dir))


@query
def current_titles(spark, sf_dir):
    return listings.current_titles(D.titles(spark, sf_dir))


@query
def available_events(spark, sf_dir):
    return listings.available_events(show_events(spark, sf_dir))


@query
def bookings_of_user(spark, sf_dir):
    return listings.bookings_of(
        bookings(spark, sf_dir), first="2024-01-02", last="2024-01-10", statuses=[S.BOOKED]
    )


@query
def bookings_of_users(spark, sf_dir):
    customers = D.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    users = customers.select(F.col("c_custkey").alias("user_id"))
    return listings.bookings_of(bookings(spark, sf_dir), users, first="2024-01-05")


@query
def titles_in_range(spark, sf_dir):
    titles = D.titles(spark, sf_dir)
    return listings.current_titles(titles, first="2024-01-16", last="2024-01-20")


@query
def events_in_range(spark, sf_dir):
    return listings.available_events(
        show_events(spark, sf_dir),
        first="2024-01-03",
        last="2024-01-09",
        statuses=[S.AVAILABLE, S.FULL],
    )


@query
def ticket_purchases(spark, sf_dir):
    return listings.buy_tickets(D.ticket_requests(spark, sf_dir), show_events(spark, sf_dir))


@query
def tickets_sold(spark, sf_dir):
    return listings.tickets_sold(ticket_purchases(spark, sf_dir))


@query
def events_after_purchases(spark, sf_dir):
    events = show_events(spark, sf_dir)
    answered = listings.buy_tickets(D.ticket_requests(spark, sf_dir), events)
    return listings.seats_after(events, answered)


@query
def canceled_bookings(spark, sf_dir):
    rows = listings.cancel_bookings(bookings(spark, sf_dir), D.cancel_requests(spark, sf_dir))
    return rows.select("user_id_event_id", "user_id", "title_id", "day", "status")


# ---------------------------------------------------------------- profiles and expansion


@query
def input_profile(spark, sf_dir):
    return metrics.input_profile(D.interest(spark, sf_dir), D.free_days(spark, sf_dir))


@query
def experiment_summary(spark, sf_dir):
    """Two populations that make up all users: by the sign of the account balance."""
    customers = D.table(spark, sf_dir, "customer")
    users = customers.select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("in_debt")
    )
    bids = stored(D.interest(spark, sf_dir).join(users, "user_id"), "sweep")
    slots = stored(D.free_days(spark, sf_dir).join(users, "user_id"), "sweep")
    populations = [
        (name, bids.where(F.col("in_debt") == debt), slots.where(F.col("in_debt") == debt))
        for name, debt in (("in debt", True), ("others", False))
    ]
    folder = new_folder(spark, "metrics")
    metrics.size_sweep(populations, folder, SWEEP_MINIMUM)
    summary = metrics.experiment_summary(metrics.read_metrics(spark, folder))
    return summary.drop(
        "start_time",
        "end_time",
        "total_duration",
        "gen_input_duration",
        "read_input_duration",
        "process_duration",
    )


@query
def bid_expansion(spark, sf_dir):
    customers = D.table(spark, sf_dir, "customer")
    users = customers.select(
        F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("user_no")
    )
    suppliers = D.table(spark, sf_dir, "supplier")
    venues = suppliers.select(F.col("s_suppkey").alias("venue_id"))
    return expand.expand_bids(users, D.titles(spark, sf_dir), venues, D.FIRST_DAY, 2, 2, 5)


@query
def validity_split(spark, sf_dir):
    parts = D.table(spark, sf_dir, "part")
    names = parts.select(
        F.format_string("%012d", "p_partkey").alias("title_id"), F.col("p_name").alias("title_name")
    )
    return expand.validity_split(names, "2024-01-03")


# ---------------------------------------------------------------- files


@query
def text_roundtrip(spark, sf_dir):
    folder = new_folder(spark, "lines")
    rows = D.venue_bids(spark, sf_dir)
    line = F.concat_ws(
        " ", F.col("user_id").cast("string"), "title_id", "timeslot", "venue_id",
        F.col("total_bid").cast("string"),
    )
    writers.write_lines(rows.select(line.alias("value")), folder)
    return readers.venue_bids_text(spark, folder)


@query
def canceled_output(spark, sf_dir):
    """K3: canceled rows as written for those who want them."""
    folder = new_folder(spark, "canceled")
    writers.write_canceled(booking(spark, sf_dir).canceled().drop("tickets"), folder)
    return spark.read.parquet(folder)


@query
def cleared_table(spark, sf_dir):
    """K8: rows of the timeslot table before and after it is cleared."""
    folder = new_folder(spark, "cleared")
    D.user_timeslots(spark, sf_dir).write.parquet(folder)
    before = spark.read.parquet(folder).count()
    writers.clear_table(spark, S.USER_TIMESLOTS, folder)
    after = spark.read.parquet(folder).agg(F.count("*").alias("rows_after"))
    return after.select(F.lit(before).cast("bigint").alias("rows_before"), "rows_after")


@query
def id_list(spark, sf_dir):
    folder = new_folder(spark, "ids")
    customers = D.table(spark, sf_dir, "customer")
    line = F.concat_ws(" ", "c_name", "c_mktsegment")
    writers.write_lines(customers.select(line.alias("value")), folder)
    return readers.id_list(spark, folder)


@query
def interest_csv(spark, sf_dir):
    folder = new_folder(spark, "interest")
    rows = D.interest(spark, sf_dir).select("user_id", "title_id", "total_bid")
    writers.write_csv(rows, folder)
    return readers.interest_csv(spark, folder)


@query
def timeslot_csv(spark, sf_dir):
    folder = new_folder(spark, "timeslots")
    slots = D.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    # not distinct: the reader drops repeated days
    rows = slots.select(
        F.col("o_custkey").alias("user_id"), D.day_of(F.col("o_orderdate")).alias("day")
    )
    writers.write_csv(rows, folder)
    return readers.timeslot_csv(spark, folder)


@query
def encoded_records(spark, sf_dir):
    """Bid records as base64 lines and back."""
    folder = new_folder(spark, "records")
    requests = R.with_defaults(D.bid_requests(spark, sf_dir))
    lines = writers.as_json(requests, ["seq", *S.BID_RECORD.names])
    writers.write_messages(writers.encoded(lines), folder)
    return readers.bid_records(readers.decoded(spark.read.text(folder)))


# ---------------------------------------------------------------- streams


def _arrivals(rows: DataFrame, chunks: int = 3):
    """The rows in order of ``seq``, in chunks that arrive one after the other."""
    borders = F.percentile_approx("seq", [(i + 1) / chunks for i in range(chunks - 1)])
    borders = rows.agg(borders.alias("b")).first()["b"] or []
    low = None
    for high in [*borders, None]:
        chunk = rows
        if low is not None:
            chunk = chunk.where(F.col("seq") > low)
        if high is not None:
            chunk = chunk.where(F.col("seq") <= high)
        low = high
        yield chunk


def _feed(spark: SparkSession, rows: DataFrame, columns, start) -> str:
    """Let the rows arrive as messages in three chunks and run the job after each."""
    inbox = new_folder(spark, "inbox")
    lines = None
    for chunk in _arrivals(rows):
        writers.write_messages(writers.as_json(chunk, columns), inbox)
        lines = lines or readers.message_stream(spark, inbox)
        start(lines).awaitTermination()
    return inbox


@query
def stream_bid_upsert(spark, sf_dir):
    requests = R.with_defaults(D.bid_requests(spark, sf_dir))
    folder = new_folder(spark, "ingest")
    _feed(
        spark,
        requests,
        ["seq", *S.BID_RECORD.names],
        lambda lines: jobs.ingest_bids(lines, folder),
    )
    return jobs.ingested_bids(spark, folder)


def _event_feed(spark, sf_dir, titles) -> str:
    events = booking(spark, sf_dir).events.withColumnRenamed("event_rank", "seq")
    events = events.withColumn("bids_total", F.col("bids_total").cast("double"))
    folder = new_folder(spark, "events")
    _feed(
        spark,
        events,
        ["seq", *S.EVENT_MESSAGE.names],
        lambda lines: jobs.apply_events(lines, titles, folder),
    )
    return folder


@query
def stream_events(spark, sf_dir):
    folder = _event_feed(spark, sf_dir, D.titles(spark, sf_dir))
    return jobs.applied_events(spark, folder)


@query
def stream_event_rejects(spark, sf_dir):
    """Events about titles that are no longer shown."""
    folder = _event_feed(spark, sf_dir, D.titles(spark, sf_dir).where("expired = 0"))
    return jobs.rejects(spark, folder, jobs.EVENT_REJECTS)


def _reservation_feed(spark, sf_dir) -> jobs.Reservations:
    titles = stored(D.titles(spark, sf_dir), "tables")
    bids, slots = (
        jobs.by_bucket(f(spark, sf_dir), new_folder(spark, "tables"), buckets=8)
        for f in (D.user_bids, D.user_timeslots)
    )
    job = jobs.Reservations(titles, bids, slots, new_folder(spark, "reservations"), buckets=8)
    requests = D.reservation_requests(spark, sf_dir)
    _feed(spark, requests, ["seq", *S.RESERVATION_MESSAGE.names], job.start)
    return job


@query
def stream_reservations(spark, sf_dir):
    return _reservation_feed(spark, sf_dir).bookings()


@query
def stream_rejects(spark, sf_dir):
    """A bid or timeslot taken by an earlier batch is not available to a later one, so what was
    taken and what was not available go by one name here."""
    reason = F.regexp_replace("reason", " (taken|not available)$", " not free")
    return _reservation_feed(spark, sf_dir).rejects().withColumn("reason", reason)


@query
def stream_transitions(spark, sf_dir):
    titles, bids = (
        stored(t, "tables") for t in (D.titles(spark, sf_dir), D.user_bids(spark, sf_dir))
    )
    job = jobs.BidRequests(titles, bids, D.NOW, new_folder(spark, "requests"))
    requests = D.bid_requests(spark, sf_dir)
    _feed(spark, requests, ["seq", "op", *S.BID_RECORD.names], job.start)
    return job.bids_now()


@query
def stream_timeslots(spark, sf_dir):
    """Timeslot requests; after every run the job goes on from the table as written."""
    slots = jobs.by_bucket(D.user_timeslots(spark, sf_dir), new_folder(spark, "tables"), buckets=8)
    job = jobs.TimeslotRequests(slots, D.NOW, new_folder(spark, "requests"), buckets=8)

    def start(lines):
        nonlocal job
        job = job.rebased(new_folder(spark, "tables"))
        return job.start(lines)

    requests = D.timeslot_requests(spark, sf_dir)
    _feed(spark, requests, ["seq", *jobs.TIMESLOT_REQUEST.names], start)
    return job.slots_now()


@query
def rebooked_events(spark, sf_dir):
    """Bookings as published by the periodic run, on the arrival of a change."""
    inbox, folder = new_folder(spark, "inbox"), new_folder(spark, "published")
    lines = F.to_json(F.struct("seq", "user_id", "title_id"))
    writers.write_messages(D.bid_requests(spark, sf_dir).select(lines.alias("value")), inbox)
    jobs.rebook(
        # one run for all files
        readers.message_stream(spark, inbox, files_per_trigger=1_000_000),
        lambda: D.interest(spark, sf_dir),
        lambda: D.free_days(spark, sf_dir),
        lambda result, number: writers.put_changes(result.events, folder, number),
        new_folder(spark, "rebook"),
        MINIMUM,
        jobs.ONCE,
    ).awaitTermination()
    return spark.read.parquet(folder).drop("batch")


def _changed(spark, sf_dir, job):
    """A job that has seen all changes of bids and free days, in three chunks."""
    columns = ["seq", *rebooking.CHANGE.names]
    _feed(spark, D.table_changes(spark, sf_dir), columns, job.start)
    return job


def _tables(spark, sf_dir):
    return stored(D.interest(spark, sf_dir), "tables"), stored(D.free_days(spark, sf_dir), "tables")


@query
def stream_group_totals(spark, sf_dir):
    """Group totals kept up to date while bids and free days come, change and go."""
    folder = new_folder(spark, "totals")
    return _changed(spark, sf_dir, rebooking.GroupTotals(*_tables(spark, sf_dir), folder)).totals()


@query
def rebooked_after_changes(spark, sf_dir):
    """Bookings after every chunk of changes, from the first event on that a change can reach."""
    folder = new_folder(spark, "rebooking")
    job = rebooking.Rebooking(*_tables(spark, sf_dir), folder, MINIMUM)
    return _changed(spark, sf_dir, job).events()


@query
def rebooked_statuses(spark, sf_dir):
    """What the bookings after one chunk of changes mean for every row."""
    folder = new_folder(spark, "rebooking")
    job = rebooking.Rebooking(*_tables(spark, sf_dir), folder, MINIMUM)
    inbox = new_folder(spark, "inbox")
    columns = ["seq", *rebooking.CHANGE.names]
    writers.write_messages(writers.as_json(D.table_changes(spark, sf_dir), columns), inbox)
    job.start(readers.message_stream(spark, inbox, files_per_trigger=1_000_000)).awaitTermination()
    return job.result().statuses().drop("tickets")


# ---------------------------------------------------------------- requests at their own time


@query
def bid_requests_at_their_time(spark, sf_dir):
    requests = D.with_moments(spark, sf_dir, D.bid_requests(spark, sf_dir))
    periods, bids = D.title_periods(spark, sf_dir), D.user_bids(spark, sf_dir)
    return R.bid_requests(requests, periods, bids, None).results


@query
def timeslot_requests_at_their_time(spark, sf_dir):
    requests = D.dated_timeslot_requests(spark, sf_dir)
    return R.timeslot_requests(requests, D.user_timeslots(spark, sf_dir), None, zone="UTC").results


# ---------------------------------------------------------------- sizes


SWEEP_SIZES = range(500, 5001, 500)


@query
def size_sweep(spark, sf_dir):
    """Ten populations, the first 500, 1000, ... users, booked in one set of rounds."""
    return metrics.nested_sweep(D.interest(spark, sf_dir), D.free_days(spark, sf_dir), SWEEP_SIZES, MINIMUM)


@query
def sized_expansion(spark, sf_dir):
    customers = D.table(spark, sf_dir, "customer")
    users = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("user_no"))
    venues = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("venue_id"))
    return expand.expand_to_size(users, D.titles(spark, sf_dir), venues, D.FIRST_DAY, 0.2, 0.143)


@query
def numbered_files(spark, sf_dir):
    """Venue bids as lines in their order, over files of 10,000; what each file holds."""
    folder = new_folder(spark, "numbered-lines")
    rows = D.venue_bids(spark, sf_dir)
    line = F.concat_ws(" ", F.lpad(F.col("user_id").cast("string"), 12, "0"), "title_id", "timeslot", "venue_id", F.col("total_bid").cast("string"))
    writers.write_numbered_lines(rows.select(line.alias("value")), ["value"], folder)
    read = spark.read.schema("value string, file_no long").text(folder)
    return read.groupBy("file_no").agg(
        F.count("*").alias("lines"), F.min("value").alias("first_line"), F.max("value").alias("last_line"),
        F.count_if(F.col("value").contains("Brand#")).alias("whole_lines"),
    )


# ---------------------------------------------------------------- distinct users over runs


@query
def users_over_runs(spark, sf_dir):
    """A5 over any two stored runs: distinct users out of sketches, against the exact count."""
    slots, bids = D.free_days(spark, sf_dir), D.interest(spark, sf_dir)
    runs = bids.join(slots, "user_id").select(F.date_format("day", S.ISO_DAY).alias("run"), "user_id")
    runs = stored(runs.distinct(), "runs")
    found = metrics.users_of_pairs(metrics.run_sketches(runs))
    exact = metrics.exact_users_of_pairs(runs)
    near = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(0.03 * F.col("users"), F.lit(1))
    return exact.join(found, ["run", "other"]).select("run", "other", "users", near.alias("within_three_percent"))


# ---------------------------------------------------------------- indexes


def _askers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who signed up."""
    return D.table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id").distinct()


@query
def indexed_active_bids(spark, sf_dir):
    """R7 by index: bids still open after the bookings, of the users who signed up."""
    folder = new_folder(spark, "indexed-bids")
    after = applying.bids_after(D.user_bids(spark, sf_dir), _applied(spark, sf_dir))
    indexes.write_indexed(after, folder, 1, [indexes.BIDS_BY_USER_AND_STATUS])
    keys = indexes.keys_of(_askers(spark, sf_dir))
    return listings.active_bids(indexes.under(spark, folder, indexes.BIDS_BY_USER_AND_STATUS, keys))


@query
def indexed_timeslots(spark, sf_dir):
    """R8 by index: timeslots of the users who signed up, after the bookings."""
    folder = new_folder(spark, "indexed-timeslots")
    after = applying.slots_after(D.user_timeslots(spark, sf_dir), _applied(spark, sf_dir))
    indexes.write_indexed(after, folder, 1, [indexes.TIMESLOTS_BY_USER, indexes.TIMESLOTS_BY_STATUS])
    return listings.timeslots(indexes.under(spark, folder, indexes.TIMESLOTS_BY_USER, _askers(spark, sf_dir)))


@query
def indexed_events(spark, sf_dir):
    """R10 by index: events with seats left, and full ones."""
    folder = new_folder(spark, "indexed-events")
    indexes.write_indexed(show_events(spark, sf_dir), folder, 1, [indexes.EVENTS_BY_STATUS])
    keys = indexes.statuses(spark, S.AVAILABLE, S.FULL)
    found = indexes.under(spark, folder, indexes.EVENTS_BY_STATUS, keys)
    return listings.available_events(found, statuses=[S.AVAILABLE, S.FULL])
