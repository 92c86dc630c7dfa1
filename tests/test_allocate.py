from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest

from brute import greedy
from seatpool.functions import ordered
from seatpool.operators import allocate as A

DAY = date(2020, 2, 1)


def day(number: int) -> date:
    return DAY + timedelta(days=number - 1)


def frames(spark, interest, free, bid="bigint"):
    bids = spark.createDataFrame(interest, f"user_id string, title_id string, total_bid {bid}")
    return bids, spark.createDataFrame(free, "user_id string, day date")


def joined(interest, free):
    return [
        {"user_id": u, "title_id": t, "value": v, "day": d}
        for u, t, v in interest
        for w, d in free
        if u == w
    ]


def events_of(result):
    return sorted(tuple(r) for r in result.events.collect())


def same_as_brute(result, interest, free, minimum, strict=True):
    rows = joined(interest, free)
    events, status, cause = greedy(rows, ("day", "title_id"), ("day", "title_id"), minimum, strict)
    assert events_of(result) == events
    expected = sorted(
        (r["user_id"], r["day"], r["title_id"], r["value"], status[i], cause.get(i, 0))
        for i, r in enumerate(rows)
    )
    found = sorted(
        (r["user_id"], r["day"], r["title_id"], r["total_bid"], r["status"], r["cause_rank"] or 0)
        for r in result.outcome.collect()
    )
    assert found == expected
    booked = sorted((r["user_id"], r["day"], r["title_id"], r["event_rank"]) for r in result.booked.collect())
    assert booked == [(u, d, t, c) for u, d, t, _, s, c in expected if s == "B"]


# the small hand-made case: nine bids of 1, eight free days
INTEREST = [
    (u, t, 1)
    for u, t in ["11", "12", "21", "22", "33", "43", "44", "54", "14"]
]
FREE = [
    (u, day(d))
    for u, d in [("1", 2), ("1", 1), ("2", 2), ("2", 3), ("3", 1), ("4", 1), ("4", 2), ("5", 1)]
]


@pytest.mark.parametrize(
    "minimum, strict, expected",
    [
        (2, True, [(1, day(1), "4", 3, 3)]),
        (1, True, [(1, day(1), "4", 3, 3), (2, day(2), "1", 2, 2)]),
        (2, False, [(1, day(1), "4", 3, 3), (2, day(2), "1", 2, 2)]),
        (
            0,
            True,
            [
                (1, day(1), "4", 3, 3),
                (2, day(2), "1", 2, 2),
                (3, day(1), "3", 1, 1),
                (4, day(2), "3", 1, 1),
                (5, day(3), "2", 1, 1),
            ],
        ),
    ],
)
def test_small_case(spark, minimum, strict, expected):
    result = A.book(*frames(spark, INTEREST, FREE), minimum, strict)
    assert events_of(result) == expected
    same_as_brute(result, INTEREST, FREE, minimum, strict)


def test_status_counts_and_stats(spark):
    result = A.book(*frames(spark, INTEREST, FREE), 1)
    counts = {r["status"]: r["count"] for r in result.statuses().groupBy("status").count().collect()}
    assert counts == {"B": 5, "C": 8, "A": 3}
    assert tuple(result.stats().first()) == (2, 5, 5, 4)
    causes = {(r["user_id"], r["day"], r["title_id"]): r["cause_rank"] for r in result.with_causes().collect()}
    assert causes[("2", day(3), "1")] == 2 and causes[("4", day(1), "3")] == 1


def test_ties_are_independent_and_limits(spark):
    interest = [("u1", "t1", 5), ("u1", "t2", 5), ("u2", "t1", 5), ("u3", "t2", 5)]
    free = [("u1", day(1)), ("u1", day(2)), ("u2", day(1)), ("u3", day(2))]
    for minimum, strict, count in ((5, True, 2), (9, True, 2), (10, True, 0), (10, False, 2)):
        result = A.book(*frames(spark, interest, free), minimum, strict)
        assert result.events.count() == count
        same_as_brute(result, interest, free, minimum, strict)


def test_no_input_and_no_overlap(spark):
    for interest, free in (([], []), ([("u", "t", 9)], []), ([("u", "t", 9)], [("v", day(1))])):
        result = A.book(*frames(spark, interest, free), 0)
        assert result.events.count() == 0
        assert tuple(result.stats().first()) == (0, 0, 0, 0)


def many_cases(seed, cases, low=0, high=4):
    """Random inputs over users, titles and days of their own, so that they do not interact."""
    rng = random.Random(seed)
    interest, free = [], []
    for case in range(cases):
        users, titles, days = rng.randint(1, 6), rng.randint(1, 5), rng.randint(1, 4)
        for u in range(users):
            name = f"c{case:03d}u{u}"
            for t in range(titles):
                if rng.random() < 0.7:
                    interest.append((name, f"c{case:03d}t{t}", rng.randint(low, high)))
            for d in range(days):
                if rng.random() < 0.7:
                    free.append((name, day(case * 5 + d + 1)))
    return interest, free


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"rounds_per_write": 1},
        {"per_row": 2},
        {"sequential": True, "cases": 4},
    ],
    ids=["rounds", "write every round", "split users", "sequential"],
)
def test_rounds_equal_the_sequential_rule(spark, options):
    options = dict(options)
    interest, free = many_cases(7, options.pop("cases", 40))
    result = A.book(*frames(spark, interest, free), 2, **options)
    same_as_brute(result, interest, free, 2)


@pytest.mark.parametrize("options", [{}, {"per_row": 2}], ids=["rounds", "split users"])
def test_more_winners_than_a_scan_names_are_a_table(spark, monkeypatch, options):
    interest, free = many_cases(11, 30)
    monkeypatch.setattr(A, "WINNERS_IN_SCAN", 5)
    monkeypatch.setattr(A, "ROUNDS_WITHOUT_VOTES", 2)
    same_as_brute(A.book(*frames(spark, interest, free), 1, **options), interest, free, 1)


def test_both_winner_tests_without_broadcasts(spark, monkeypatch):
    interest, free = many_cases(12, 20)
    monkeypatch.setattr(A, "WINNERS_IN_SCAN", 0)
    monkeypatch.setattr(A, "ROUNDS_WITHOUT_VOTES", 2)
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    same_as_brute(A.book(*frames(spark, interest, free), 1), interest, free, 1)


def test_only_the_first_and_last_state_keep_open_users(spark, monkeypatch, tmp_path):
    interest, free = many_cases(13, 10)
    monkeypatch.setattr(A, "new_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    A.book(*frames(spark, interest, free), 1, rounds_per_write=1)
    cuts = len(list(tmp_path.glob("booking/cut=*")))
    left = {int(p.parent.name.removeprefix("cut=")) for p in tmp_path.glob("booking/cut=*/open=1")}
    assert cuts > 3 and left <= {1, cuts}


def test_the_sequential_form_takes_negative_bids(spark):
    interest, free = many_cases(3, 6, low=-3)
    same_as_brute(A.book(*frames(spark, interest, free), 1, sequential=True), interest, free, 1)


def test_rounds_leave_out_negative_bids_and_list_them(spark):
    interest, free = many_cases(3, 6, low=-3)
    bids, slots = frames(spark, interest, free)
    kept = [row for row in interest if row[2] >= 0]
    assert len(kept) < len(interest)
    same_as_brute(A.book(bids, slots, 1), kept, free, 1)
    left = A.unbookable(bids, ["user_id", "title_id"])
    assert sorted(tuple(r)[:3] for r in left.collect()) == sorted(r for r in interest if r[2] < 0)


def test_decimal_bids(spark):
    interest, free = many_cases(5, 10)
    interest = [(u, t, Decimal(v) / 4) for u, t, v in interest]
    result = A.book(*frames(spark, interest, free, "decimal(10,2)"), Decimal("0.75"))
    same_as_brute(result, interest, free, Decimal("0.75"))


def test_inexact_bids_are_refused(spark):
    with pytest.raises(TypeError):
        A.book(*frames(spark, [("u", "t", 1.5)], [("u", day(1))], "double"), 1)


def test_validity_of_the_bid(spark):
    bids = spark.createDataFrame(
        [("u", "t", 5, day(2), day(3)), ("v", "t", 5, day(1), day(9))],
        "user_id string, title_id string, total_bid bigint, `from` date, `to` date",
    )
    slots = spark.createDataFrame(
        [("u", day(1)), ("v", day(1)), ("u", day(3)), ("v", day(3))], "user_id string, day date"
    )
    assert events_of(A.book(bids, slots, 5)) == [(1, day(1), "t", 10, 2)]
    assert events_of(A.book(bids, slots, 5, respect_validity=True)) == [(1, day(3), "t", 10, 2)]


def valid_rows(interest, free):
    """One row per user, day and title: the sum of the bids that hold on the day."""
    sums = {}
    for u, t, v, since, until in interest:
        for w, d in free:
            if u == w and since is not None and until is not None and since <= d <= until:
                n = sums.setdefault((u, d, t), [0, 0])
                n[0] += v
                n[1] += 1
    return [{"user_id": u, "day": d, "title_id": t, "value": v, "n": n} for (u, d, t), (v, n) in sums.items()]


@pytest.mark.parametrize(
    "options", [{}, {"per_row": 2}, {"sequential": True, "cases": 4}, {"many": True}],
    ids=["rounds", "split users", "sequential", "winners as a table"],
)
def test_bids_with_periods_equal_the_sequential_rule(spark, monkeypatch, options):
    options = dict(options)
    rng = random.Random(19)
    plain, free = many_cases(19, options.pop("cases", 30))
    if options.pop("many", False):
        monkeypatch.setattr(A, "WINNERS_IN_SCAN", 3)
    interest = []
    for u, t, v in plain:
        for k in range(rng.choice((1, 1, 2, 3))):
            since = day(int(u[1:4]) * 5 + rng.randint(-1, 4))
            until = since + timedelta(days=rng.randint(-1, 4))
            interest.append((u, t, v + k, since if rng.random() > 0.05 else None, until if rng.random() > 0.05 else None))
    bids = spark.createDataFrame(interest, "user_id string, title_id string, total_bid bigint, `from` date, `to` date")
    slots = spark.createDataFrame(free, "user_id string, day date")
    result = A.book(bids, slots, 2, respect_validity=True, **options)
    rows = valid_rows(interest, free)
    events, status, cause = greedy(rows, ("day", "title_id"), ("day", "title_id"), 2)
    tickets = {}
    for i, row in enumerate(rows):
        if status[i] == "B":
            tickets[cause[i]] = tickets.get(cause[i], 0) + row["n"]
    assert events_of(result) == [(*e[:-1], tickets[e[0]]) for e in events]
    found = sorted((r["user_id"], r["day"], r["title_id"], r["total_bid"], r["tickets"], r["status"], r["cause_rank"] or 0) for r in result.outcome.collect())
    assert found == sorted((r["user_id"], r["day"], r["title_id"], r["value"], r["n"], status[i], cause.get(i, 0)) for i, r in enumerate(rows))


def test_periods_add_up_where_bids_overlap(spark):
    at = "2020-02-0{} {}:00:00".format
    bids = spark.createDataFrame(
        [("u", "t", 5, at(1, "00"), at(4, "00")), ("u", "t", 2, at(2, "06"), at(3, "23")), ("u", "t", 1, at(5, "00"), at(5, "00")),
         ("u", "s", 9, at(3, "01"), at(3, "09")), ("u", "s", 9, None, at(3, "00")), ("u", "s", 9, at(4, "00"), at(2, "00"))],
        "user_id string, title_id string, total_bid bigint, a string, b string",
    ).selectExpr("user_id", "title_id", "total_bid", "CAST(a AS TIMESTAMP) AS `from`", "CAST(b AS TIMESTAMP) AS `to`")
    base = (day(1) - date(1, 1, 1)).days
    found = sorted((r["title_id"], r["first_no"] - base + 1, r["last_no"] - base + 1, r["total_bid"], r["tickets"]) for r in A.periods(bids).collect())
    assert found == [("t", 1, 2, 5, 1), ("t", 3, 3, 7, 2), ("t", 4, 4, 5, 1), ("t", 5, 5, 1, 1)]


def test_periods_are_stored_instead_of_their_days(spark, monkeypatch):
    written = []
    monkeypatch.setattr(A, "stored", lambda rows, purpose: written.append((purpose, rows.columns, rows.count())) or rows)
    bids = spark.createDataFrame([("u", "t", 5, day(1), day(28)), ("v", "t", 5, day(1), day(28))], "user_id string, title_id string, total_bid bigint, `from` date, `to` date")
    slots = spark.createDataFrame([(u, day(d)) for u in "uv" for d in range(1, 29)], "user_id string, day date")
    assert events_of(A.book(bids, slots, 5, respect_validity=True)) == [(1, day(1), "t", 10, 2)]
    assert ("bids", ["user_id", "title_id", "total_bid", "tickets", "first_no", "last_no"], 2) in written
    assert all("day" not in columns for _, columns, _ in written)


@pytest.mark.parametrize("per_row", [A.OPTIONS_PER_ROW, 2])
def test_venues_equal_the_sequential_rule(spark, per_row):
    rng = random.Random(23)
    rows = []
    for case in range(30):
        for _ in range(rng.randint(1, 25)):
            rows.append(
                (
                    f"c{case}u{rng.randint(0, 4)}",
                    f"c{case}t{rng.randint(0, 2)}",
                    f"2024-01-{case + 1:02d} {2 * rng.randint(0, 2):02d}:00",
                    f"v{rng.randint(0, 1)}",
                    rng.randint(0, 5),
                )
            )
    schema = "user_id string, title_id string, timeslot string, venue_id string, total_bid bigint"
    result = A.book_venues(spark.createDataFrame(rows, schema), 6, per_row=per_row)
    plain = [
        {"user_id": u, "title_id": t, "timeslot": s, "venue_id": v, "value": b}
        for u, t, s, v, b in rows
    ]
    group = ("timeslot", "title_id", "venue_id")
    events, status, _ = greedy(plain, group, ("timeslot", "title_id"), 6, strict=False)
    assert events_of(result) == events
    found = {
        tuple(r[c] for c in ("user_id", *group)): r["status"] for r in result.outcome.collect()
    }
    expected = {
        tuple(r[c] for c in ("user_id", *group)): status[i] for i, r in enumerate(plain)
    }
    assert found == expected


def test_invariants_on_the_test_tables(spark, sf_dir):
    from seatpool.plans import queries

    result = queries.booking(spark, sf_dir, minimum=100)
    events = events_of(result)
    assert events and all(e[3] > 100 for e in events)
    totals = [e[3] for e in events]
    assert totals == sorted(totals, reverse=True)
    rows = result.booked.collect()
    assert len({(r["user_id"], r["day"]) for r in rows}) == len(rows)
    assert len({(r["user_id"], r["title_id"]) for r in rows}) == len(rows)
    assert sum(e[4] for e in events) == len(rows)


def test_repeated_and_null_bids(spark):
    bids = spark.createDataFrame(
        [(1, 1, 30), (1, 1, 20), (2, 1, 10), (None, 1, 99), (3, None, 9), (3, 1, None)],
        "user_id long, title_id long, total_bid long",
    )
    slots = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-01")], "user_id long, day string")
    slots = slots.withColumn("day", slots["day"].cast("date"))
    events = A.book(bids, slots, minimum=20).events.collect()
    assert [(r["bids_total"], r["num_tickets"]) for r in events] == [(60, 2)]
    left = A.unbookable(bids, ["user_id", "title_id"]).collect()
    assert [r["reason"] for r in left] == ["incomplete bid"] * 3


def test_split_negative_bids_do_not_hide_in_a_sum(spark):
    bids = spark.createDataFrame([(1, 1, -3), (1, 1, 30)], "user_id long, title_id long, total_bid long")
    slots = spark.createDataFrame([(1, "2024-01-01")], "user_id long, day string")
    slots = slots.withColumn("day", slots["day"].cast("date"))
    for sequential, total in ((False, 30), (True, 27)):
        events = A.book(bids, slots, minimum=1, sequential=sequential).events.collect()
        assert [r["bids_total"] for r in events] == [total]


def test_votes_meet_per_user_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    rows = {(f"u{rng.randrange(60)}", f"{rng.randrange(6)}", f"t{rng.randrange(5)}", f"v{rng.randrange(2)}") for _ in range(400)}
    rows = [(u, t, s, v, rng.randrange(1, 9)) for u, s, t, v in sorted(rows)]
    table = spark.createDataFrame(rows, "user_id string, title_id string, timeslot string, venue_id string, total_bid bigint")
    plans, winners = [], A._winners

    def watched(state, run, by_votes):
        found = winners(state, run, by_votes)
        if by_votes:
            plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(A, "_winners", watched)
    result = A.book_venues(table, 5)
    assert result.events.count() > 5
    assert plans and not any("hashpartitioning(user_id" in plan for plan in plans)


@pytest.mark.parametrize("on_driver", [True, False], ids=["few groups", "many groups"])
def test_rounds_take_every_closed_row_from_the_totals_once(spark, monkeypatch, on_driver):
    """Work of all rounds together goes by rows, not by rounds times rows."""
    interest, free = many_cases(21, 12)
    taken, closed = [], A._closed_totals
    if not on_driver:
        monkeypatch.setattr(A, "WINNERS_IN_SCAN", 0)

    def watched(run, hits):
        found = closed(run, hits)
        taken.append(sum(r["members"] for r in found.collect()))
        return found

    monkeypatch.setattr(A, "_closed_totals", watched)
    # below all totals, so that no rows are set aside before the first round
    result = A.book(*frames(spark, interest, free), -1)
    same_as_brute(result, interest, free, -1)
    assert len(taken) > 1 and all(taken)
    assert sum(taken) == result.outcome.where("status <> 'A'").count()


def test_causes_are_looked_up_without_functions_of_arrays(spark):
    result = A.book(*frames(spark, INTEREST, FREE), 0)
    plan = result.outcome._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_days_of_periods_are_found_without_functions_of_arrays(spark):
    """The rows of open users are expanded in every round that votes."""
    titles = spark.createDataFrame([("t", 0)], "title_id string, position bigint")
    layout = A._calendar_with_periods(A.Shape(("day", "title_id"), ("day", "title_id"), "total_bid"), titles, 1, 2)
    state = spark.sql(
        """SELECT 'u' AS user_id, array(1L, 2L, 9L) AS days, array(
             named_struct('title_no', 0L, 'value', 5L, 'tickets', 1L, 'first_no', 2L, 'last_no', 4L),
             named_struct('title_no', 0L, 'value', 6L, 'tickets', 2L, 'first_no', 9L, 'last_no', 9L)) AS bids
           UNION ALL SELECT 'v', array(), array() UNION ALL SELECT 'w', array(7L), array()"""
    )
    rows = A._rows(state, layout)
    assert sorted(tuple(r) for r in rows.collect()) == [("u", 2, 2, 0, 5, 1), ("u", 9, 9, 0, 6, 2)]
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
