"""Totals and bookings that follow a stream of changes (J1 with A1, I8).

Messages change one bid or one free day: a put sets it, with its status, and replaces what was
there. Tables are the ones given, less the keys that changed, with the last change of each.
Every batch writes its changes, what they add to the group totals, and the run they lead to,
in folders of its own, and reads those of earlier batches only; so a batch that is repeated
counts once, and a job that is made again on its folder goes on where it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from seatpool import schemas as S
from seatpool.functions.columns import parse_day
from seatpool.functions.ordered import latest, sized
from seatpool.operators import incremental as I
from seatpool.operators.joins import interest_by_slot
from seatpool.session import exists, stored
from seatpool.sinks.writers import put_changes, read_changes
from seatpool.sources import readers
from seatpool.streaming.jobs import FIRST_BATCH, ONCE, UNREADABLE, _start

CHANGE = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("title_id", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_bid", T.LongType()),
    ]
)


class GroupTotals:
    """Group totals over bids (user_id, title_id, total_bid) and slots (user_id, day), all of them
    AVAILABLE, and the changes that arrive."""

    def __init__(self, bids: DataFrame, slots: DataFrame, folder: str):
        self.spark, self.folder = bids.sparkSession, folder
        self.bids, self.slots = bids.select("user_id", "title_id", "total_bid"), slots.select("user_id", "day")
        status, seq = T.StructField("status", T.StringType()), T.StructField("seq", T.LongType())
        self.schemas = {
            "bids": T.StructType([*self.bids.schema.fields, status, seq]),
            "slots": T.StructType([*self.slots.schema.fields, status, seq]),
        }
        self.keys = {"bids": ["user_id", "title_id"], "slots": ["user_id", "day"]}
        if not exists(self.spark, f"{folder}/totals/batch={FIRST_BATCH}"):
            for name, schema in self.schemas.items():
                put_changes(self.spark.createDataFrame([], schema), f"{folder}/{name}", FIRST_BATCH)
            put_changes(self.spark.createDataFrame([], UNREADABLE), f"{folder}/unreadable", FIRST_BATCH)
            rows = interest_by_slot(self.bids, self.slots).withColumn("sign", F.lit(1))
            put_changes(I.total_changes(rows), f"{folder}/totals", FIRST_BATCH)
        self.total_schema = self.spark.read.parquet(f"{folder}/totals/batch={FIRST_BATCH}").schema

    def _log(self, name: str, before: int | None) -> DataFrame:
        changes = read_changes(self.spark, f"{self.folder}/{name}", self.schemas[name], before)
        return latest(changes, self.keys[name], ["batch", "seq"]).drop("batch", "seq")

    def _table(self, name: str, before: int | None) -> DataFrame:
        base, changes = getattr(self, name), self._log(name, before)
        changed = changes.select(*self.keys[name])
        count = read_changes(self.spark, f"{self.folder}/{name}", self.schemas[name], before).count()
        kept = base.join(sized(changed, count), self.keys[name], "left_anti")
        return kept.select(*base.columns).unionByName(_available(changes).select(*base.columns))

    def bids_now(self, before: int | None = None) -> DataFrame:
        return self._table("bids", before)

    def slots_now(self, before: int | None = None) -> DataFrame:
        return self._table("slots", before)

    def totals(self, before: int | None = None) -> DataFrame:
        parts = read_changes(self.spark, f"{self.folder}/totals", self.total_schema, before)
        return I.summed_totals(parts)

    def _changes(self, batch: DataFrame) -> dict[str, DataFrame]:
        """The last change of each bid and each day in a batch; without a whole key, or a negative
        or no amount, a change is none."""
        rows = readers.in_arrival_order(readers.messages(batch, CHANGE))
        rows = rows.withColumn("day", parse_day("day"))
        found = {}
        for name, table, amount in (("bids", "bid", "total_bid >= 0"), ("slots", "slot", "true")):
            schema = self.schemas[name]
            own = rows.where(F.col("table") == table).select(
                *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]
            )
            own = own.dropna(subset=[*self.keys[name], "status"])
            own = own.where(f"status <> '{S.AVAILABLE}' OR coalesce({amount}, false)")
            found[name] = stored(latest(own, self.keys[name], ["seq"]), f"changed-{name}")
        return found

    def _signed(self, name: str, new: DataFrame, now: DataFrame, count: int) -> DataFrame:
        keys = self.keys[name]
        old = now.join(sized(new.select(*keys), count), keys, "left_semi")
        after = _available(new).select(*now.columns)
        return stored(I.signed(old.select(*now.columns), after), f"signed-{name}")

    def _step(self, batch: DataFrame, number: int) -> None:
        new = self._changes(batch)
        bids, slots = self.bids_now(number), self.slots_now(number)
        signs = {
            name: self._signed(name, rows, table, rows.count())
            for (name, rows), table in zip(new.items(), (bids, slots))
        }
        rows = I.joined_changes(bids, slots, signs["bids"], signs["slots"])
        for name, changes in new.items():
            put_changes(changes, f"{self.folder}/{name}", number)
        put_changes(readers.unreadable(batch, CHANGE), f"{self.folder}/unreadable", number)
        put_changes(I.total_changes(rows), f"{self.folder}/totals", number)

    def start(self, lines: DataFrame, trigger: dict = ONCE) -> StreamingQuery:
        return _start(lines, self._step, self.folder, trigger)


def _available(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("status") == S.AVAILABLE)


class Rebooking(GroupTotals):
    """I8: after every batch, the bookings over the tables as they are. Events that no change can
    have reached are taken over from the run before."""

    def __init__(self, bids: DataFrame, slots: DataFrame, folder: str, minimum=S.SERVICE_MINIMUM):
        super().__init__(bids, slots, folder)
        self.minimum = minimum
        if not exists(self.spark, f"{folder}/runs/batch={FIRST_BATCH}"):
            run = I.book(self.bids, self.slots, minimum)
            put_changes(run.events, f"{folder}/events", FIRST_BATCH)
            put_changes(run.booked, f"{folder}/booked", FIRST_BATCH)
            self._note(0, run.events.count(), True, FIRST_BATCH)
        self.run_schemas = {
            name: self.spark.read.parquet(f"{folder}/{name}/batch={FIRST_BATCH}").schema
            for name in ("events", "booked", "runs")
        }

    def _note(self, stood: int, events: int, replayed: bool, number: int) -> None:
        row = self.spark.createDataFrame([(stood, events, replayed)], "stood long, events long, replayed boolean")
        put_changes(row, f"{self.folder}/runs", number)

    def runs(self) -> DataFrame:
        """(stood, events, replayed, batch): how much of the run before each run took over."""
        return read_changes(self.spark, f"{self.folder}/runs", self.run_schemas["runs"])

    def _last(self, name: str, before: int | None = None) -> DataFrame:
        runs = read_changes(self.spark, f"{self.folder}/runs", self.run_schemas["runs"], before)
        last = runs.agg(F.max("batch")).first()[0]
        rows = read_changes(self.spark, f"{self.folder}/{name}", self.run_schemas[name])
        return rows.where(F.col("batch") == last).drop("batch")

    def events(self) -> DataFrame:
        return self._last("events")

    def booked(self) -> DataFrame:
        return self._last("booked")

    def result(self):
        return I.with_outcome(self.events(), self.booked(), self.bids_now(), self.slots_now())

    def _step(self, batch: DataFrame, number: int) -> None:
        super()._step(batch, number)
        changes = self.spark.read.schema(self.total_schema).parquet(f"{self.folder}/totals/batch={number}")
        run = I.rebook(
            self._last("events", number), self._last("booked", number),
            self.bids_now(number + 1), self.slots_now(number + 1), self.totals(number), changes, self.minimum,
        )
        put_changes(run.booked, f"{self.folder}/booked", number)
        put_changes(run.events, f"{self.folder}/events", number)
        # the run counts from here on
        self._note(run.stood, run.events.count(), run.replayed, number)
