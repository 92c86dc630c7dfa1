from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seatpool import schemas as S
from seatpool.functions import columns as C
from seatpool.functions.ordered import numbered
from seatpool.operators import expand, metrics
from seatpool.sinks import writers
from seatpool.sources import readers
from seatpool.streaming import jobs
from test_applying import messages, tables, titles

DAY = date(2020, 2, 1)


def test_interest_csv_keeps_the_first_in_file_order(spark, tmp_path):
    folder = tmp_path / "interest"
    folder.mkdir()
    (folder / "a.csv").write_text("user_id,title_id,total_bid\n1,x,5\n1,x,3\n2,x,9\n")
    (folder / "b.csv").write_text("user_id,title_id,total_bid\n2,x,1\n2,y,4\n")
    rows = sorted(map(tuple, readers.interest_csv(spark, str(folder)).collect()))
    assert rows == [("1", "x", 5), ("2", "x", 9), ("2", "y", 4)]


def test_timeslot_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", DAY), ("1", DAY), ("2", DAY)], "user_id string, day date")
    writers.write_csv(rows, str(tmp_path / "slots"))
    text = spark.read.text(str(tmp_path / "slots")).collect()
    assert ("1,2020/02/01",) in [tuple(r) for r in text]
    found = readers.timeslot_csv(spark, str(tmp_path / "slots")).collect()
    assert sorted(map(tuple, found)) == [("1", DAY), ("2", DAY)]


def test_venue_lines_in_every_layout(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text(
        "u1 t1 2024-01-01 10:00 v1 12\n"
        "t2 2024-01-01 12:00 v2 7\n"
        "u2 t1 ts9 v1 3\n"
        "too few tokens\n"
        "u1 t1 2024-01-01 10:00 v1 many\n"
        "\n"
    )
    rows = sorted(map(tuple, readers.venue_bids_text(spark, str(path)).collect()), key=str)
    assert rows == [
        ("u1", "t1", "2024-01-01 10:00", "v1", 12),
        ("u2", "t1", "ts9", "v1", 3),
        (None, "t2", "2024-01-01 12:00", "v2", 7),
    ]


def test_lines_per_file(spark, tmp_path):
    lines = spark.range(25).selectExpr("CAST(id AS STRING) AS value").coalesce(1)
    writers.write_lines(lines, str(tmp_path / "out"), per_file=10)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert [len(f.read_text().splitlines()) for f in files] == [10, 10, 5]
    assert readers.id_list(spark, str(tmp_path / "out")).count() == 25


def test_numbers_as_text(spark):
    rows = spark.createDataFrame(
        [("u", "t", "AVAILABLE", "2", "7.50"), ("v", "t", "AVAILABLE", "two", "7"), ("w", "t", "BOOKED", "1", "1")],
        "user_id string, title_id string, status string, num_tickets string, ticket_bid string",
    )
    assert [r["total_bid"] for r in readers.available_bids(rows).collect()] == [Decimal("15.00")]
    assert [r["user_id"] for r in readers.unreadable_bids(rows).collect()] == ["v"]


def test_messages_round_trip_and_bad_lines(spark):
    events = spark.createDataFrame(
        [("t", DAY, 3, 30)], "title_id string, day date, num_tickets bigint, bids_total bigint"
    )
    lines = writers.event_messages(events)
    assert lines.first()[0] == '{"title_id":"t","day":"2020-02-01","num_tickets":3,"bids_total":30.0}'
    slashes = lines.withColumn("value", F.replace("value", F.lit("2020-02-01"), F.lit("2020/02/01")))
    for text in (lines, slashes):
        assert tuple(readers.event_messages(text).first()) == ("t", DAY, 3, 30.0)
    booked = writers.reservation_messages(events.withColumn("user_id", F.lit("u")))
    assert booked.first()[0] == '{"user_id":"u","day":"2020-02-01","title_id":"t"}'


def test_deliveries_of_several_messages(spark):
    queue = '{"Records":[{"body":"{\\"user_id\\":\\"u\\",\\"day\\":\\"2020-02-01\\",\\"title_id\\":\\"t\\"}"},{"body":"no message"}]}'
    topic = '{"Records":[{"Sns":{"Message":{"user_id":"u","title_id":"t","num_tickets":"2","ticket_bid":"x"}}}]}'
    lines = spark.createDataFrame([(queue,)], "value string")
    found = readers.reservation_messages(readers.delivered(lines), seq=False)
    assert [tuple(r) for r in found.collect()] == [("u", DAY, "t")]
    lines = spark.createDataFrame([(topic,)], "value string")
    record = readers.bid_records(readers.delivered(lines, "Sns.Message"), seq=False).first()
    assert (record["user_id"], record["num_tickets"], record["ticket_bid"]) == ("u", 2, None)
    again = readers.decoded(writers.encoded(lines))
    assert again.first()[0] == topic
    assert len(writers.encoded(lines).first()[0].splitlines()) == 1


def test_clear_table(spark, tmp_path):
    folder = str(tmp_path / "table")
    spark.range(3).selectExpr("CAST(id AS STRING) AS user_id").write.parquet(folder)
    writers.clear_table(spark, S.USERS, folder)
    assert spark.read.parquet(folder).count() == 0


def test_prices_are_exact(spark):
    rows = spark.range(1, 400).selectExpr("id AS n", "id * 7 % 311 AS total")
    prices = rows.withColumn("price", C.ticket_price(F.col("total"), F.col("n"))).collect()
    assert all(r["price"] == -(-5 * r["total"] // (4 * r["n"])) for r in prices)


def test_row_counts_from_multipliers():
    counts = metrics.expected_rows(2000, 30, 0.2, 0.107, 14)
    assert counts == {"user_interest_rows": 12000, "user_timeslot_rows": 2996}
    assert C.sized(0.5) == 0 and C.sized(1.5) == 2


def test_positions_and_validity_split(spark):
    rows = spark.range(101).selectExpr("lpad(id, 3, '0') AS title_id", "'n' AS title_name")
    found, total = numbered(rows.repartition(7), ["title_id"])
    assert total == 101
    assert {r["title_id"]: r["position"] for r in found.collect()} == {
        f"{i:03d}": i for i in range(101)
    }
    split = expand.validity_split(rows, "2024-01-16").groupBy("expired", "from", "to").count()
    assert sorted(tuple(r) for r in split.collect()) == [
        (0, date(2024, 1, 16), date(2024, 1, 30), 51),
        (1, date(2024, 1, 1), date(2024, 1, 15), 50),
    ]


def test_metrics_append_and_summary(spark, tmp_path):
    bids = spark.createDataFrame(
        [("u", "t", 10), ("v", "t", 10), ("v", "s", 4)], "user_id string, title_id string, total_bid bigint"
    )
    slots = spark.createDataFrame([("u", DAY), ("v", DAY)], "user_id string, day date")
    folder = str(tmp_path / "metrics")
    metrics.size_sweep([("all", bids, slots), ("again", bids, slots)], folder, 15)
    rows = metrics.read_metrics(spark, folder)
    assert rows.count() == 2
    summary = metrics.experiment_summary(rows).collect()
    assert len(summary) == 1
    row = summary[0]
    assert (row["total_users"], row["result_num_group"], row["result_total_money"]) == (2, 1.0, 20.0)
    assert (row["user_percent"], row["unique_user_percent"]) == (100.0, 100.0)


# ---------------------------------------------------------------- streams


def arrive(spark, inbox, lines):
    writers.write_messages(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), inbox)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_reservations_do_not_depend_on_batches(spark, tmp_path, batches):
    bids, slots = tables(spark)
    job = jobs.Reservations(titles(spark), bids, slots, str(tmp_path / "state"))
    lines = [r[0] for r in writers.reservation_messages(messages(spark).orderBy("seq"), "seq").collect()]
    inbox = str(tmp_path / "inbox")
    size = -(-len(lines) // batches)
    for start in range(0, len(lines), size):
        arrive(spark, inbox, lines[start : start + size])
        job.start(readers.message_stream(spark, inbox)).awaitTermination()
    keys = sorted(r["user_id_event_id"] for r in job.bookings().collect())
    assert keys == ["u_t1_2024-01-01", "u_t3_2024-01-02"]
    assert job.slots_now().where("status = 'BOOKED'").count() == 2
    assert job.bids_now().where("status = 'BOOKED'").count() == 4


def test_a_repeated_batch_counts_once(spark, tmp_path):
    bids, slots = tables(spark)
    job = jobs.Reservations(titles(spark), bids, slots, str(tmp_path / "state"))
    lines = writers.reservation_messages(messages(spark), "seq")
    job._step(lines, 0)
    job._step(lines, 0)
    assert job.bookings().count() == 2


def test_lost_reservations_leave_a_reason(spark, tmp_path):
    bids, slots = tables(spark)
    bids = jobs.by_bucket(bids, str(tmp_path / "bids"), buckets=4)
    slots = jobs.by_bucket(slots, str(tmp_path / "slots"), buckets=4)
    job = jobs.Reservations(titles(spark), bids, slots, str(tmp_path / "state"), buckets=4)
    inbox = str(tmp_path / "inbox")
    for lines in (
        ['{"user_id":"u","day":"2024-01-01","title_id":"t1"}', "no message"],
        ['{"user_id":"u","day":"2024-01-01","title_id":"t1"}', '{"title_id":"t9"}'],
    ):
        arrive(spark, inbox, lines)
        job.start(readers.message_stream(spark, inbox)).awaitTermination()
    assert [r["user_id_event_id"] for r in job.bookings().collect()] == ["u_t1_2024-01-01"]
    found = sorted((r["title_id"], r["reason"]) for r in job.rejects().collect())
    assert found == [("t1", "bid not available"), ("t9", S.NO_SUCH_SHOW)]
    assert [r["value"] for r in jobs.unreadable(spark, job.folder).collect()] == ["no message"]


def test_events_that_cannot_be_leave_a_reason(spark, tmp_path):
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "events")
    arrive(spark, inbox, [
        '{"title_id":"t1","day":"2024-01-01","num_tickets":1,"bids_total":3.9}',
        '{"title_id":"t9","day":"2024-01-01","num_tickets":1,"bids_total":4.0}',
        '{"title_id":"t1","day":"2024-01-02","num_tickets":0,"bids_total":4.0}',
    ])
    jobs.apply_events(readers.message_stream(spark, inbox), titles(spark), folder).awaitTermination()
    assert [r["ticket_price"] for r in jobs.applied_events(spark, folder).collect()] == [5]
    found = jobs.rejects(spark, folder, jobs.EVENT_REJECTS).collect()
    assert sorted((r["title_id"], r["reason"]) for r in found) == [
        ("t1", S.INVALID_MESSAGE), ("t9", S.NO_SUCH_TITLE),
    ]


def test_a_rebased_job_has_the_same_state(spark, tmp_path):
    bids = spark.createDataFrame(
        [("u", "t1", S.AVAILABLE, 2, Decimal(5), DAY, DAY, True)],
        "user_id string, title_id string, status string, num_tickets int, "
        "ticket_bid decimal(10,2), `from` date, `to` date, is_preapp boolean",
    )
    now = "2024-01-01 12:00:00"
    job = jobs.BidRequests(titles(spark), bids, now, str(tmp_path / "state"))
    put = '{"op":"put","user_id":"u","title_id":"t1","num_tickets":"9","ticket_bid":"50","from":"2024-01-01","to":"2024-01-02","is_preapp":true}'
    cancel = '{"op":"cancel","user_id":"u","title_id":"t1"}'
    inbox = str(tmp_path / "inbox")
    for lines in ([put], [cancel]):
        arrive(spark, inbox, lines)
        job.start(readers.message_stream(spark, inbox)).awaitTermination()
    before = job.bids_now().collect()
    assert [(r["num_tickets"], r["ticket_bid"], r["status"]) for r in before] == [
        (9, Decimal("50.00"), S.CANCELED_BY_USER)
    ]
    again = job.rebased(str(tmp_path / "base"))
    assert again.since > job.since and again.bids_now().collect() == before
    arrive(spark, inbox, [put.replace('"9"', '"3"')])
    again.start(readers.message_stream(spark, inbox)).awaitTermination()
    assert [(r["num_tickets"], r["status"]) for r in again.bids_now().collect()] == [(3, S.AVAILABLE)]
    assert [r["message"] for r in again.results().orderBy("seq").collect()].count("Bid Updated") == 1


def test_rebased_reservations_have_the_same_state(spark, tmp_path):
    bids, slots = tables(spark)
    job = jobs.Reservations(titles(spark), bids, slots, str(tmp_path / "state"))
    job._step(writers.reservation_messages(messages(spark), "seq"), 0)
    again = job.rebased(str(tmp_path / "base"))
    for name in ("bids_now", "slots_now"):
        old, new = (sorted(map(str, getattr(j, name)().collect())) for j in (job, again))
        assert old == new
    again._step(writers.reservation_messages(messages(spark), "seq"), 1)
    assert again.bookings().count() == 2


def test_a_batch_reads_its_buckets_only(spark, tmp_path, capsys):
    bids, slots = tables(spark)
    bids = jobs.by_bucket(bids, str(tmp_path / "bids"), buckets=64)
    job = jobs.Reservations(titles(spark), bids, slots, str(tmp_path / "state"), buckets=64)
    batch = spark.createDataFrame([("u", "t1")], "user_id string, title_id string")
    job.bids_now(5, jobs._of_batch(batch, 64)).explain("formatted")
    filters = [x for x in capsys.readouterr().out.splitlines() if "PartitionFilters" in x]
    assert any("bucket" in x for x in filters)
    assert any("batch" in x and "< 5" in x and "> -1" in x for x in filters)


def test_bid_records_last_one_wins(spark, tmp_path):
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "bids")
    record = '{"seq":%d,"user_id":"u","title_id":"t","status":"%s","num_tickets":"2","ticket_bid":"5.5","from":"2024-01-01","to":"2024-01-09","is_preapp":true}'
    for lines in ([record % (1, "AVAILABLE"), record % (3, "BOOKED")], [record % (2, "EXPIRED")]):
        arrive(spark, inbox, lines)
        jobs.ingest_bids(readers.message_stream(spark, inbox), folder).awaitTermination()
    rows = jobs.ingested_bids(spark, folder).collect()
    # the later batch wins, whatever its numbers
    assert [(r["user_id_status"], r["num_tickets"], r["ticket_bid"]) for r in rows] == [
        ("u_EXPIRED", 2, Decimal("5.50"))
    ]


def test_compacting_keeps_the_last_change(spark, tmp_path):
    schema = "k string, v int, seq bigint"
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for batch, rows in enumerate([[("a", 1, 5), ("b", 1, 6)], [("a", 2, 1)], [("b", 3, 9)]]):
        writers.put_changes(spark.createDataFrame(rows, schema), old, batch)
    types = spark.createDataFrame([], schema).schema
    writers.compact(spark, old, types, ["k"], new, upto=1)
    found = writers.read_latest(spark, new, types, ["k"]).collect()
    assert sorted((r["k"], r["v"]) for r in found) == [("a", 2), ("b", 1)]
    found = writers.read_latest(spark, old, types, ["k"]).collect()
    assert sorted((r["k"], r["v"]) for r in found) == [("a", 2), ("b", 3)]


def test_booking_again_when_something_changed(spark, tmp_path):
    bids = spark.createDataFrame([("u", "t", 30)], "user_id string, title_id string, total_bid bigint")
    slots = spark.createDataFrame([("u", DAY)], "user_id string, day date")
    inbox, published = str(tmp_path / "inbox"), []
    arrive(spark, inbox, ["changed"])
    query = jobs.rebook(
        readers.message_stream(spark, inbox),
        lambda: bids,
        lambda: slots,
        lambda result, number: published.append((number, result.events.count())),
        str(tmp_path / "state"),
        trigger=jobs.ONCE,
    )
    query.awaitTermination()
    assert published == [(0, 1)]
