"""Structured Streaming jobs (M1 to M4, I8).

Messages come as lines of JSON and act in order of arrival, then of ``seq``
within a micro-batch. Every job puts the changes of a micro-batch in a folder
of that batch, and reads only those of earlier batches. A batch that is run
again after a failure therefore starts from the same tables and replaces what
it wrote, and the result does not depend on how lines fell into batches.

Lines and messages that lead to nothing are put beside the changes with the
reason, so that none is lost. Tables laid out by ``by_bucket`` let a batch read
only the buckets of its users. The history of a job grows with time; ``rebased``
writes the tables as they are and gives a job that goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from seatpool import schemas as S
from seatpool.functions.columns import composite_key, parse_day
from seatpool.functions.ordered import sized
from seatpool.operators import applying, requests as R
from seatpool.operators.allocate import Bookings, book
from seatpool.operators.upsert import with_status
from seatpool.sinks.writers import put_changes, read_changes, read_latest
from seatpool.sources import readers

FIRST_BATCH = -1
BUCKETS = 256

EVERY = {"processingTime": f"{S.RERUN_SECONDS} seconds"}
ONCE = {"availableNow": True}

BID_CHANGES = T.StructType(
    [T.StructField("seq", T.LongType()), *S.USER_BIDS.fields]
)
EVENT_CHANGES = T.StructType([T.StructField("seq", T.LongType()), *S.SHOW_EVENTS.fields])
BID_REQUEST = T.StructType([T.StructField("op", T.StringType()), *S.BID_RECORD.fields])
TIMESLOT_REQUEST = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("is_preapp", T.BooleanType()),
    ]
)
EVENT_REJECTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("title_id", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)
UNREADABLE = T.StructType([T.StructField("value", T.StringType())])


def _create(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """An empty first batch, so that the table can be read before anything has arrived."""
    put_changes(spark.createDataFrame([], schema), folder, FIRST_BATCH)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def by_bucket(table: DataFrame, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """Write a table with a folder per bucket of users, for jobs that read few users at a time."""
    table = table.withColumn("bucket", _bucket(buckets))
    # rebalanced, so that a bucket with very many rows goes to several tasks and files
    spread = table.hint("rebalance", F.col("bucket"))
    spread.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


_Keys = Callable[[DataFrame, Sequence[str]], DataFrame]


def _keep_all(table: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.drop("bucket")


def _of_batch(batch: DataFrame, buckets: int) -> _Keys:
    """Keep the rows of a table whose keys occur in a batch.

    A batch is small against the tables, and its rows are counted, so the tables
    are not shuffled. Of a table laid out by bucket, only the batch's buckets are read.
    """
    found = batch.groupBy(_bucket(buckets).alias("bucket")).count().collect()
    count, present = sum(r["count"] for r in found), [r["bucket"] for r in found]

    def keep(table: DataFrame, key: Sequence[str]) -> DataFrame:
        if "bucket" in table.columns:
            table = table.where(F.col("bucket").isin(present)).drop("bucket")
        return table.join(sized(batch.select(*key).distinct(), count), list(key), "left_semi")

    return keep


def rejects(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """E4 for streams: messages that led to nothing, with the reason."""
    return read_changes(spark, f"{folder}/rejects", _with_reason(schema)).drop("batch")


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that were no message of the job."""
    return read_changes(spark, f"{folder}/unreadable", UNREADABLE).drop("batch")


def _with_reason(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("reason", T.StringType())])


def _start(
    lines: DataFrame, step: Callable[[DataFrame, int], None], folder: str, trigger: dict
) -> StreamingQuery:
    return (
        lines.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(**trigger)
        .start()
    )


# ---------------------------------------------------------------- M1


def ingest_bids(lines: DataFrame, folder: str, trigger: dict = ONCE) -> StreamingQuery:
    """M1: bid records into the keyed bid table."""
    spark = lines.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        rows = readers.bid_records(batch).withColumn(
            "user_id_title_id", composite_key("user_id", "title_id")
        )
        rows = rows.withColumn("user_id_status", composite_key("user_id", "status"))
        put_changes(rows.select(*BID_CHANGES.names), f"{folder}/bids", number)

    _create(spark, f"{folder}/bids", BID_CHANGES)
    return _start(lines, step, folder, trigger)


def ingested_bids(spark: SparkSession, folder: str) -> DataFrame:
    return read_latest(spark, f"{folder}/bids", BID_CHANGES, ["user_id_title_id"]).drop("seq")


# ---------------------------------------------------------------- M2


def apply_events(
    lines: DataFrame, titles: DataFrame, folder: str, trigger: dict = ONCE
) -> StreamingQuery:
    """M2: event messages into the show event table."""
    spark = lines.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        rows = readers.in_arrival_order(readers.event_messages(batch, seq=True)).persist()
        events = applying.show_events(rows, titles, keep=["seq"])
        refused = applying.event_rejects(rows, titles)
        put_changes(events.select(*EVENT_CHANGES.names), f"{folder}/events", number)
        put_changes(refused.select(*_with_reason(EVENT_REJECTS).names), f"{folder}/rejects", number)
        put_changes(readers.unreadable(batch, S.EVENT_MESSAGE), f"{folder}/unreadable", number)
        rows.unpersist()

    _create(spark, f"{folder}/events", EVENT_CHANGES)
    _create(spark, f"{folder}/rejects", _with_reason(EVENT_REJECTS))
    _create(spark, f"{folder}/unreadable", UNREADABLE)
    return _start(lines, step, folder, trigger)


def applied_events(spark: SparkSession, folder: str) -> DataFrame:
    return read_latest(spark, f"{folder}/events", EVENT_CHANGES, ["title_id_day"]).drop("seq")


# ---------------------------------------------------------------- M3


class Reservations:
    """M3: reservation messages against bid and timeslot tables.

    ``bids`` and ``slots`` hold what batches up to ``since`` led to.
    """

    def __init__(
        self,
        titles: DataFrame,
        bids: DataFrame,
        slots: DataFrame,
        folder: str,
        since: int = FIRST_BATCH,
        buckets: int = BUCKETS,
    ):
        self.spark = titles.sparkSession
        self.titles, self.bids, self.slots = titles, bids, slots
        self.folder, self.since, self.buckets = folder, since, buckets
        self.bid_keys = T.StructType([bids.schema["user_id"], bids.schema["title_id"]])
        self.slot_keys = T.StructType([slots.schema["user_id"], slots.schema["day"]])
        sample = applying.decided(applying.looked_up(self._messages(None), titles, bids, slots))
        self.booking_schema = sample.bookings.schema
        self.reject_schema = sample.verdicts.schema
        _create(self.spark, f"{folder}/taken_bids", self.bid_keys)
        _create(self.spark, f"{folder}/taken_slots", self.slot_keys)
        _create(self.spark, f"{folder}/bookings", self.booking_schema)
        _create(self.spark, f"{folder}/rejects", self.reject_schema)
        _create(self.spark, f"{folder}/unreadable", UNREADABLE)

    def _messages(self, batch: DataFrame | None) -> DataFrame:
        if batch is None:
            batch = self.spark.createDataFrame([], "value string")
        rows = readers.in_arrival_order(readers.reservation_messages(batch))
        return rows.withColumn("user_id", F.col("user_id").try_cast(self.bid_keys["user_id"].dataType))

    def _now(self, table: DataFrame, name: str, keys: T.StructType, before, only: _Keys) -> DataFrame:
        taken = read_changes(self.spark, f"{self.folder}/{name}", keys, before, self.since)
        return with_status(only(table, keys.names), only(taken, keys.names), keys.names, S.BOOKED)

    def bids_now(self, before: int | None = None, only: _Keys = _keep_all) -> DataFrame:
        return self._now(self.bids, "taken_bids", self.bid_keys, before, only)

    def slots_now(self, before: int | None = None, only: _Keys = _keep_all) -> DataFrame:
        return self._now(self.slots, "taken_slots", self.slot_keys, before, only)

    def bookings(self) -> DataFrame:
        return read_changes(self.spark, f"{self.folder}/bookings", self.booking_schema).drop("batch")

    def rejects(self) -> DataFrame:
        return read_changes(self.spark, f"{self.folder}/rejects", self.reject_schema).drop("batch")

    def rebased(self, target: str) -> Reservations:
        """K4: the job on tables that hold all changes so far, written to a new folder.

        To be called between two runs; the same stream goes on.
        """
        upto = _last_batch(self.spark, f"{self.folder}/bookings", self.booking_schema)
        bids = by_bucket(self.bids_now(upto + 1), f"{target}/bids", self.buckets)
        slots = by_bucket(self.slots_now(upto + 1), f"{target}/slots", self.buckets)
        return Reservations(self.titles, bids, slots, self.folder, upto, self.buckets)

    def _step(self, batch: DataFrame, number: int) -> None:
        rows = self._messages(batch).persist()
        only = _of_batch(rows, self.buckets)
        # the part of the tables that the batch is about, read once for all that follows from it
        bids, slots = self.bids_now(number, only), self.slots_now(number, only)
        applied = applying.apply_reservations(rows, self.titles, bids, slots)
        winners = applied.bid_winners.select(*self.bid_keys.names)
        placed = applied.slot_winners.select(*self.slot_keys.names)
        put_changes(winners, f"{self.folder}/taken_bids", number)
        put_changes(placed, f"{self.folder}/taken_slots", number)
        put_changes(applying.rejected(applied), f"{self.folder}/rejects", number)
        lost = readers.unreadable(batch, S.RESERVATION_MESSAGE)
        put_changes(lost, f"{self.folder}/unreadable", number)
        put_changes(applied.bookings, f"{self.folder}/bookings", number)
        rows.unpersist()

    def start(self, lines: DataFrame, trigger: dict = ONCE) -> StreamingQuery:
        return _start(lines, self._step, self.folder, trigger)


def _last_batch(spark: SparkSession, folder: str, schema: T.StructType) -> int:
    """The last batch that left something here."""
    found = read_changes(spark, folder, schema).agg(F.max("batch").alias("last")).first()["last"]
    return FIRST_BATCH if found is None else found


# ---------------------------------------------------------------- M4


class _Requests:
    """M4: requests through the status transitions, against a table that holds what batches
    up to ``since`` led to."""

    key: Sequence[str]
    fields: Sequence[str]
    message: T.StructType
    dates: Sequence[str]

    def __init__(
        self,
        table: DataFrame,
        now,
        folder: str,
        since: int = FIRST_BATCH,
        buckets: int = BUCKETS,
    ):
        self.spark = table.sparkSession
        self.now, self.folder, self.since, self.buckets = now, folder, since, buckets
        self.row_schema = table.select(*self.key, "status", *self.fields).schema
        extra = [name for name in ("bucket",) if name in table.columns]
        self.table = table.select(*self.row_schema.names, *extra)
        self.change_schema = T.StructType(
            [
                T.StructField("seq", T.LongType()),
                T.StructField("op", T.StringType()),
                *self.row_schema.fields,
            ]
        )
        self.result_schema = T.StructType(
            [
                T.StructField("seq", T.LongType()),
                *[self.row_schema[k] for k in self.key],
                T.StructField("ok", T.BooleanType()),
                T.StructField("message", T.StringType()),
                T.StructField("result", T.StringType()),
            ]
        )
        _create(self.spark, f"{folder}/changes", self.change_schema)
        _create(self.spark, f"{folder}/results", self.result_schema)
        _create(self.spark, f"{folder}/unreadable", UNREADABLE)

    def _outcome(self, rows: DataFrame, table: DataFrame) -> R.Outcome:
        raise NotImplementedError

    def _with(self, table: DataFrame, since: int) -> _Requests:
        raise NotImplementedError

    def table_now(self, before: int | None = None, only: _Keys = _keep_all) -> DataFrame:
        changes = read_changes(
            self.spark, f"{self.folder}/changes", self.change_schema, before, self.since
        )
        changes = only(changes, self.key)
        # numbers of a later batch act after those of an earlier one
        order = F.struct("batch", "seq").alias("seq")
        changes = changes.select("op", *self.key, "status", *self.fields, order)
        return R.after_requests(only(self.table, self.key), changes, self.key, self.fields)

    def results(self) -> DataFrame:
        return read_changes(self.spark, f"{self.folder}/results", self.result_schema).drop("batch")

    def rebased(self, target: str) -> _Requests:
        """K4: the job on a table that holds all changes so far, written to a new folder.

        To be called between two runs; the same stream goes on.
        """
        upto = _last_batch(self.spark, f"{self.folder}/results", self.result_schema)
        return self._with(by_bucket(self.table_now(upto + 1), target, self.buckets), upto)

    def _requests(self, batch: DataFrame) -> DataFrame:
        rows = readers.in_arrival_order(readers.messages(batch, self.message))
        rows = rows.withColumns({name: parse_day(name) for name in self.dates})
        return rows.select(
            "seq",
            "op",
            *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in self.row_schema],
        )

    def _step(self, batch: DataFrame, number: int) -> None:
        rows = self._requests(batch).persist()
        table = self.table_now(number, _of_batch(rows, self.buckets)).persist()
        outcome = self._outcome(rows, table)
        changes = outcome.changes.select(*self.change_schema.names)
        put_changes(changes, f"{self.folder}/changes", number)
        lost = readers.unreadable(batch, self.message)
        put_changes(lost, f"{self.folder}/unreadable", number)
        put_changes(
            outcome.results.select(*self.result_schema.names), f"{self.folder}/results", number
        )
        rows.unpersist()
        table.unpersist()

    def start(self, lines: DataFrame, trigger: dict = ONCE) -> StreamingQuery:
        return _start(lines, self._step, self.folder, trigger)


class BidRequests(_Requests):
    """M4 for bids."""

    key = ("user_id", "title_id")
    fields = ("num_tickets", "ticket_bid", "from", "to", "is_preapp")
    message = BID_REQUEST
    dates = ("from", "to")

    def __init__(self, titles: DataFrame, bids: DataFrame, now, folder: str, *more):
        super().__init__(bids, now, folder, *more)
        self.titles = titles

    def _outcome(self, rows: DataFrame, table: DataFrame) -> R.Outcome:
        return R.bid_requests(rows, self.titles, table, self.now)

    def _with(self, table: DataFrame, since: int) -> BidRequests:
        return BidRequests(self.titles, table, self.now, self.folder, since, self.buckets)

    bids_now = _Requests.table_now


class TimeslotRequests(_Requests):
    """M4 for timeslots."""

    key = ("user_id", "day")
    fields = ("is_preapp",)
    message = TIMESLOT_REQUEST
    dates = ("day",)

    def _outcome(self, rows: DataFrame, table: DataFrame) -> R.Outcome:
        return R.timeslot_requests(rows, table, self.now)

    def _with(self, table: DataFrame, since: int) -> TimeslotRequests:
        return TimeslotRequests(table, self.now, self.folder, since, self.buckets)

    slots_now = _Requests.table_now


# ---------------------------------------------------------------- I8


def rebook(
    changes: DataFrame,
    read_bids: Callable[[], DataFrame],
    read_slots: Callable[[], DataFrame],
    publish: Callable[[Bookings, int], None],
    folder: str,
    minimum=S.SERVICE_MINIMUM,
    trigger: dict = EVERY,
) -> StreamingQuery:
    """I8, H1: book again over the tables as they are, when something has changed.

    ``publish`` receives the three outputs of the run: events, booked rows and
    canceled rows, and writes those it wants.
    """

    def step(batch: DataFrame, number: int) -> None:
        publish(book(read_bids(), read_slots(), minimum), number)

    return _start(changes, step, folder, trigger)

