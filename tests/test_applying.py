from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from seatpool import schemas as S
from seatpool.operators import applying, listings
from seatpool.operators.upsert import change_status, upsert

ONE, TWO = date(2024, 1, 1), date(2024, 1, 2)


def titles(spark):
    rows = [(t, f"name {t}", ONE, TWO, 0, year, 200) for t, year in (("t1", 2020), ("t2", None), ("t3", 2021))]
    return spark.createDataFrame(rows, S.TITLES)


def test_show_events(spark):
    messages = spark.createDataFrame(
        [
            ("t1", ONE, 3, 3),
            ("t1", TWO, 4, 16),
            ("t3", ONE, 200, 2000),
            ("t3", TWO, 250, 2500),
            ("t2", ONE, 1, 4),
            ("t9", ONE, 1, 1),
        ],
        "title_id string, day date, num_tickets bigint, bids_total bigint",
    )
    rows = {r["title_id_day"]: r for r in applying.show_events(messages, titles(spark)).collect()}
    found = {
        k: (r["status"], r["num_tickets_available"], r["ticket_price"], r["year"])
        for k, r in rows.items()
    }
    assert found == {
        "t1_2024-01-01": ("AVAILABLE", 197, 2, "2020"),
        "t1_2024-01-02": ("AVAILABLE", 196, 5, "2020"),
        "t3_2024-01-01": ("FULL", 0, 13, "2021"),
        "t3_2024-01-02": ("FULL", -50, 13, "2021"),
        "t2_2024-01-01": ("AVAILABLE", 199, 5, ""),
    }
    missing = applying.unknown_titles(messages, titles(spark)).collect()
    assert [(r["title_id"], r["reason"]) for r in missing] == [("t9", S.NO_SUCH_TITLE)]


def tables(spark):
    bids = spark.createDataFrame(
        [
            ("u", "t1", "AVAILABLE"),
            ("u", "t2", "AVAILABLE"),
            ("u", "t3", "AVAILABLE"),
            ("v", "t1", "BOOKED"),
        ],
        "user_id string, title_id string, status string",
    ).selectExpr(
        "*", "2 AS num_tickets", "CAST(5 AS DECIMAL(10,2)) AS ticket_bid", "true AS is_preapp",
        "concat_ws('_', user_id, status) AS user_id_status",
    )
    slots = spark.createDataFrame(
        [("u", ONE, "AVAILABLE"), ("u", TWO, "AVAILABLE"), ("v", ONE, "AVAILABLE")],
        "user_id string, day date, status string",
    )
    return bids, slots


def messages(spark):
    return spark.createDataFrame(
        [
            (1, "u", ONE, "t1"),
            (2, "u", ONE, "t2"),
            (3, "u", TWO, "t2"),
            (4, "u", TWO, "t3"),
            (5, "v", ONE, "t1"),
            (6, "v", ONE, "t9"),
            (7, "v", ONE, "t2"),
        ],
        "seq bigint, user_id string, day date, title_id string",
    )


def test_reservations(spark):
    bids, slots = tables(spark)
    applied = applying.apply_reservations(messages(spark), titles(spark), bids, slots)
    booked = {r["user_id_event_id"]: r["title_name"] for r in applied.bookings.collect()}
    assert booked == {"u_t1_2024-01-01": "name t1", "u_t3_2024-01-02": "name t3"}
    reasons = {r["seq"]: r["reason"] for r in applying.rejected(applied).collect()}
    assert reasons == {
        2: "timeslot taken",
        3: "bid taken",
        5: "bid not available",
        6: S.NO_SUCH_SHOW,
        7: S.NO_SUCH_BID,
    }
    after = applying.bids_after(bids, applied).collect()
    assert {(r["user_id"], r["title_id"]): (r["user_id_status"], r["orphan"]) for r in after} == {
        ("u", "t1"): ("u_BOOKED", False),
        ("u", "t2"): ("u_BOOKED", True),
        ("u", "t3"): ("u_BOOKED", False),
        ("v", "t1"): ("v_BOOKED", False),
    }
    slots_now = applying.slots_after(slots, applied).collect()
    assert {(r["user_id"], r["day"]): r["status"] for r in slots_now} == {
        ("u", ONE): "BOOKED", ("u", TWO): "BOOKED", ("v", ONE): "AVAILABLE",
    }


def test_applying_again_changes_nothing(spark):
    bids, slots = tables(spark)
    first = applying.apply_reservations(messages(spark), titles(spark), bids, slots)
    bids_now = applying.bids_after(bids, first).drop("orphan")
    slots_now = applying.slots_after(slots, first)
    again = applying.apply_reservations(messages(spark), titles(spark), bids_now, slots_now)
    assert again.bookings.count() == 0


def test_upsert_and_conditional_change(spark):
    table = spark.createDataFrame([("a", "AVAILABLE"), ("b", "BOOKED")], "k string, status string")
    changes = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 2), ("c", "z", 1)], "k string, status string, seq bigint"
    )
    assert sorted(map(tuple, upsert(table, changes, ["k"], ["seq"]).collect())) == [
        ("a", "y"), ("b", "BOOKED"), ("c", "z"),
    ]
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    rows = change_status(table, asked, ["k"], "BOOKED", "AVAILABLE").collect()
    assert {r["k"]: (r["changed"], r["old_status"]) for r in rows} == {
        "a": (True, "AVAILABLE"), "b": (False, "BOOKED"), "c": (False, None),
    }


def test_listing_is_complete_or_paged_per_user(spark):
    rows = spark.range(500).selectExpr("id % 2 AS user_id", "lpad(id, 4, '0') AS k")
    capped = listings.page(rows, "k", ["user_id"], limit=100).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in capped} == {0: 100, 1: 100}
    assert listings.page(rows, "k", limit=100).count() == 100
    assert listings.page(rows, "k").count() == rows.count()
    first = listings.page(rows, "k", limit=100).agg({"k": "max"}).first()[0]
    assert listings.page(rows, "k", after=first).where(rows["k"] <= first).count() == 0


def test_prices_of_fractional_totals(spark):
    from decimal import Decimal

    messages = spark.createDataFrame(
        [("t1", Decimal("3.90"), 1), ("t1", Decimal("4.00"), 5), ("t1", Decimal("0.01"), 1)],
        "title_id string, bids_total decimal(10,2), num_tickets long",
    ).withColumn("day", F.lit("2024-01-01").cast("date"))
    titles = spark.createDataFrame(
        [("t1", "T", None, None, 1999)], "title_id string, title_name string, from date, to date, year int"
    )
    prices = [r["ticket_price"] for r in applying.show_events(messages, titles).collect()]
    assert sorted(prices) == [1, 1, 5]
