from __future__ import annotations

import itertools
from datetime import date

import pytest
from pyspark.sql import functions as F

from brute import fold
from seatpool import schemas as S
from seatpool.functions.ordered import in_blocks, running
from seatpool.operators import listings, requests as R

ASKED = (S.AVAILABLE, S.CANCELED_BY_USER)
STARTS = (None, *S.STATUSES)
NOW = "2024-01-03 00:00:00"


def every_sequence(length=4):
    """A key per starting status and sequence of requests; sequence numbers are interleaved."""
    keys = [
        (f"{i:04d}", start, sequence)
        for i, (start, sequence) in enumerate(
            itertools.product(STARTS, itertools.product(ASKED, repeat=length))
        )
    ]
    rows = [
        (step * len(keys) + i, name, new)
        for i, (name, _, sequence) in enumerate(keys)
        for step, new in enumerate(sequence)
    ]
    return keys, rows


@pytest.mark.parametrize("block", [1, 150, R.BLOCK])
def test_bid_sequences_equal_one_at_a_time(spark, block):
    keys, rows = every_sequence()
    titles = spark.createDataFrame(
        [("t", date(2024, 1, 1), date(2024, 1, 9))], "title_id string, `from` date, `to` date"
    )
    bids = spark.createDataFrame(
        [(name, "t", start) for name, start, _ in keys if start],
        "user_id string, title_id string, status string",
    )
    asked = spark.createDataFrame(rows, "seq bigint, user_id string, status string")
    asked = asked.withColumn("title_id", F.lit("t")).withColumn(
        "op", F.when(F.col("status") == S.AVAILABLE, "put").otherwise("cancel")
    )
    outcome = R.bid_requests(asked, titles, bids, NOW, block=block)
    found = {r["seq"]: (r["ok"], r["message"]) for r in outcome.results.collect()}
    assert len(found) == len(rows)
    after = R.after_requests(bids.withColumn("x", F.lit(1)), outcome.changes.withColumn("x", F.lit(2)), ["user_id", "title_id"], ["x"])
    states = {r["user_id"]: r["status"] for r in after.collect()}
    for i, (name, start, sequence) in enumerate(keys):
        verdicts, end = fold(S.BID_TRANSITIONS, start, sequence)
        assert [found[step * len(keys) + i] for step in range(len(sequence))] == verdicts
        assert states.get(name) == end


def test_timeslot_sequences_with_undefined_transitions(spark):
    keys, rows = every_sequence(3)
    day = date(2024, 1, 5)
    slots = spark.createDataFrame(
        [(name, day, start) for name, start, _ in keys if start],
        "user_id string, day date, status string",
    )
    asked = spark.createDataFrame(rows, "seq bigint, user_id string, status string")
    asked = asked.withColumn("day", F.lit(day)).withColumn(
        "op", F.when(F.col("status") == S.AVAILABLE, "put").otherwise("cancel")
    )
    found = {
        r["seq"]: (r["ok"], r["message"])
        for r in R.timeslot_requests(asked, slots, NOW, block=100).results.collect()
    }
    for i, (_, start, sequence) in enumerate(keys):
        verdicts, _ = fold(S.TIMESLOT_TRANSITIONS, start, sequence)
        assert [found[step * len(keys) + i] for step in range(len(sequence))] == verdicts


def test_machines_keep_the_last_request_of_open_states():
    """The property that lets a sequence be followed by running values."""
    for machine in (S.BID_TRANSITIONS, S.TIMESLOT_TRANSITIONS):
        table = {(old, new): ok for old, new, ok, _ in machine}
        assert all(table[(old, new)] for old in ASKED for new in ASKED if old != new)


def test_day_rule(spark):
    days = ["2024-01-02", "2024-01-03", "2025-01-02", "2025-01-03"]
    rows = spark.createDataFrame([(d,) for d in days], "text string").select(
        F.to_date("text").alias("day")
    )
    reasons = [r[0] for r in rows.select(R.day_reason(NOW)).collect()]
    assert reasons == [S.DAY_IN_PAST, None, None, S.DAY_TOO_FAR]


def test_title_rule(spark):
    dates = spark.createDataFrame(
        [(date(2024, 1, 1), date(2024, 1, 3))], "title_from date, title_to date"
    )
    for now, valid in (
        ("2023-12-31 23:59:59", False),
        ("2024-01-01 00:00:00", True),
        ("2024-01-03 00:00:00", True),
        ("2024-01-03 00:00:01", False),
    ):
        assert dates.select(R.title_valid(now)).first()[0] is valid


def test_refusals_and_unknown_title(spark):
    titles = spark.createDataFrame(
        [("old", date(2023, 1, 1), date(2023, 1, 9)), ("new", date(2024, 1, 1), date(2024, 1, 9))],
        "title_id string, `from` date, `to` date",
    )
    bids = spark.createDataFrame([], "user_id string, title_id string, status string")
    asked = spark.createDataFrame(
        [
            (1, "put", "old", None),
            (2, "put", "none", None),
            (3, "put", "new", "BOOKED"),
            (4, "put", "new", None),
            (5, "cancel", "old", None),
        ],
        "seq bigint, op string, title_id string, status string",
    ).withColumn("user_id", F.lit("u"))
    rows = R.bid_requests(asked, titles, bids, NOW).results.collect()
    found = {r["seq"]: (r["ok"], r["message"]) for r in rows}
    assert found == {
        1: (False, S.TITLE_EXPIRED),
        2: (False, S.NO_SUCH_TITLE),
        3: (False, S.BID_STATUS_RULE),
        4: (True, "Bid Updated"),
        5: (False, "Bid Does Not Exists"),
    }
    texts = {r["seq"]: r["result"] for r in rows}
    assert texts[4] == '"success"'
    assert texts[1] == '{"reason":"client_error","errors":["title is expired"]}'


@pytest.mark.parametrize("sparse", [False, True])
def test_running_values_equal_a_plain_window(spark, sparse):
    rows = spark.range(300).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        (F.hash("id") % 10).alias("n"),
        F.when(F.hash("id") % 5 == 0, F.col("id")).alias("mark"),
    )
    if sparse:
        rows = rows.withColumns({"seq": F.col("seq") * 10**15, "mark": F.col("mark") * 10**15})
    blocked = in_blocks(rows, "seq", 16)
    assert blocked.select("block_no").distinct().count() == 19
    found = running(
        blocked, ["key"], "seq",
        totals={"before": F.col("n")}, firsts={"first": F.col("mark")}, previous={"last": "n"},
    )
    rows.createOrReplaceTempView("running_rows")
    plain = spark.sql(
        """SELECT *, sum(n) OVER before AS before, min(mark) OVER before AS first,
                  lag(n) OVER (PARTITION BY key ORDER BY seq) AS last
           FROM running_rows WINDOW before AS (PARTITION BY key ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    )
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_tickets_until_sold_out(spark):
    events = spark.createDataFrame(
        [("t", date(2024, 1, 1), 5)], "title_id string, day date, num_tickets_available bigint"
    )
    asked = spark.createDataFrame(
        [(1, "t", 2), (2, "t", 3), (3, "t", 1), (4, "x", 1)],
        "seq bigint, title_id string, num_tickets int",
    ).withColumn("day", F.lit(date(2024, 1, 1)))
    for block in (1, 100):
        rows = listings.buy_tickets(asked, events, block=block).collect()
        assert {r["seq"]: r["reason"] for r in rows} == {
            1: None, 2: None, 3: "not enough tickets", 4: "no such event",
        }


def test_sales_take_seats(spark):
    events = spark.createDataFrame(
        [("t", date(2024, 1, 1), 5, S.AVAILABLE), ("t", date(2024, 1, 2), 0, S.FULL)],
        "title_id string, day date, num_tickets_available bigint, status string",
    )
    asked = spark.createDataFrame(
        [(1, "u", 2), (2, "v", 3), (3, "w", 1)], "seq bigint, user_id string, num_tickets int"
    ).withColumns({"title_id": F.lit("t"), "day": F.lit(date(2024, 1, 1))})
    answered = listings.buy_tickets(asked, events)
    sold = listings.tickets_sold(answered).collect()
    assert sorted((r["user_id_event_id"], r["num_tickets"], r["status"]) for r in sold) == [
        ("u_t_2024-01-01", 2, S.BOOKED), ("v_t_2024-01-01", 3, S.BOOKED),
    ]
    assert sorted(map(tuple, listings.seats_after(events, answered).collect())) == [
        ("t", date(2024, 1, 1), 0, S.FULL), ("t", date(2024, 1, 2), 0, S.FULL),
    ]
    some = listings.seats_after(events, answered.where("seq = 1"))
    assert ("t", date(2024, 1, 1), 3, S.AVAILABLE) in list(map(tuple, some.collect()))


def test_canceling_twice_changes_nothing(spark):
    columns = "user_id string, title_id string, day date, status string"
    table = spark.createDataFrame(
        [("u", "t", date(2024, 1, 1), S.BOOKED), ("v", "t", date(2024, 1, 1), S.BOOKED)], columns
    )
    asked = table.where("user_id = 'u'").drop("status")
    once = listings.cancel_bookings(table, asked)
    twice = listings.cancel_bookings(once, asked.union(asked))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r["user_id"]: r["status"] for r in twice.collect()} == {"u": S.CANCELED, "v": S.BOOKED}


def test_preferences(spark):
    table = spark.createDataFrame([("u", False, "OR"), ("w", True, "OR")], S.PREFERENCES)
    asked = spark.createDataFrame(
        [(1, "u", True, "OR"), (2, "u", None, None), (3, "v", False, None)],
        "seq bigint, user_id string, is_preapp boolean, or_or_any string",
    )
    after = R.preferences_after(table, asked)
    assert sorted(map(tuple, after.collect())) == [
        ("u", True, "ANY"), ("v", False, "ANY"), ("w", True, "OR"),
    ]
    users = spark.createDataFrame([("u",), ("z",)], "user_id string")
    errors = {r["user_id"]: r["error"] for r in listings.preferences_of(users, after).collect()}
    assert errors == {"u": None, "z": S.NO_SUCH_USER}


def test_every_request_gets_a_verdict(spark, capsys):
    day = date(2024, 1, 1)
    titles = spark.createDataFrame(
        [(1, day, date(2030, 1, 1))], "title_id long, from date, to date"
    )
    bids = spark.createDataFrame([(7, 1, "AVAILABLE")], "user_id long, title_id long, status string")
    rows = [
        (1, "cancel", 7, 1, None), (None, "cancel", 7, 1, None), (3, "cancel", 7, None, None),
        (4, "buy", 7, 1, "AVAILABLE"), (5, None, 7, 1, "AVAILABLE"),
    ]
    requests = spark.createDataFrame(rows, "seq long, op string, user_id long, title_id long, status string")
    found = R.bid_requests(requests, titles, bids, "2024-06-01 00:00:00").results
    assert sorted((r["message"], r["ok"]) for r in found.collect() if not r["ok"]) == sorted(
        [(S.INCOMPLETE_REQUEST, False)] * 2 + [(S.UNKNOWN_OPERATION, False)] * 2
    )
    assert found.count() == 5


def test_running_values_of_a_joined_key_are_dealt_out_by_block(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).selectExpr("id AS seq", "int(id % 2) AS k", "id AS v")
        joined = rows.join(spark.createDataFrame([(0, 1)], "k int, x int"), "k")
        joined = in_blocks(joined, "seq", 10)
        running(joined, ["k"], "seq", totals={"so_far": F.col("v")}).explain("formatted")
        assert "hashpartitioning(k#" in (text := capsys.readouterr().out)
        assert "block_no#" in text.split("hashpartitioning(k#", 1)[1]
        assert "REPARTITION_BY_COL" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tickets_outside_the_contract_are_refused(spark):
    events = spark.createDataFrame([(1, date(2024, 1, 1), 5)], "title_id long, day date, num_tickets_available long")
    rows = [(1, 9, 1, -9), (2, 9, 1, 4), (3, 9, 1, None), (4, 9, None, 1), (5, 9, 1, 1)]
    asked = spark.createDataFrame(rows, "seq long, user_id long, title_id long, num_tickets long").withColumn(
        "day", F.lit("2024-01-01").cast("date")
    )
    found = {r["seq"]: r["granted"] for r in listings.buy_tickets(asked, events).collect()}
    assert found == {1: False, 2: True, 3: False, 4: False, 5: True}
