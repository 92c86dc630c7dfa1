from __future__ import annotations

import json
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest

from brute import greedy
from seatpool import schemas as S
from seatpool.functions import ordered
from seatpool.operators import allocate as A, expand, incremental as I, metrics, requests as R
from seatpool.session import stored
from seatpool.sinks import writers
from seatpool.sources import readers
from seatpool.streaming import rebooking

FIRST = date(2024, 1, 1)
BIDS = "user_id string, title_id string, total_bid long"
SLOTS = "user_id string, day date"


def day(n: int) -> date:
    return FIRST + timedelta(days=n)


def tables(spark, bids, slots):
    return (
        spark.createDataFrame([(*k, v) for k, v in bids.items()], BIDS),
        spark.createDataFrame(sorted(slots), SLOTS),
    )


def rows_of(bids, slots):
    return [
        {"user_id": u, "title_id": t, "value": v, "day": d}
        for (u, t), v in bids.items() for w, d in slots if u == w
    ]


def brute_events(bids, slots, minimum):
    return greedy(rows_of(bids, slots), ("day", "title_id"), ("day", "title_id"), minimum)[0]


def brute_totals(bids, slots):
    found = Counter(), Counter()
    for r in rows_of(bids, slots):
        found[0][r["day"], r["title_id"]] += r["value"]
        found[1][r["day"], r["title_id"]] += 1
    return sorted((*g, found[0][g], n) for g, n in found[1].items())


def some_tables(rng, users=12, titles=5, days=4, highest=30):
    bids = {
        (f"u{u}", f"t{t}"): rng.randrange(highest)
        for u in range(users) for t in range(titles) if rng.random() < 0.5
    }
    slots = {(f"u{u}", day(d)) for u in range(users) for d in range(days) if rng.random() < 0.5}
    return bids, slots


def change(rng, bids, slots, count):
    """Raised, new and canceled bids; new and canceled days."""
    for _ in range(count):
        user, title, on = f"u{rng.randrange(14)}", f"t{rng.randrange(6)}", day(rng.randrange(5))
        kind = rng.randrange(4)
        if kind == 0:
            bids[user, title] = rng.randrange(60)
        elif kind == 1:
            bids.pop((user, title), None)
        elif kind == 2:
            slots.add((user, on))
        else:
            slots.discard((user, on))
        yield kind, user, title, on


def delta(spark, before, after, names):
    return stored(I.signed(*[t.select(*names) for t in (before, after)]), "delta")


@pytest.mark.parametrize("seed", range(6))
def test_rebooking_equals_a_full_run(spark, seed):
    rng = random.Random(seed)
    bids, slots = some_tables(rng)
    minimum = rng.choice([0, 20, 45])
    old_bids, old_slots = tables(spark, bids, slots)
    totals, events, booked = I.first_run(old_bids, old_slots, minimum)
    for _ in change(rng, bids, slots, 1 + seed % 3):
        pass
    new_bids, new_slots = tables(spark, bids, slots)
    changes = I.total_changes(I.joined_changes(
        old_bids, old_slots, delta(spark, old_bids, new_bids, new_bids.columns),
        delta(spark, old_slots, new_slots, new_slots.columns),
    ))
    now = I.summed_totals(totals.unionByName(changes))
    assert sorted(map(tuple, now.select("day", "title_id", "bids_total", "num_tickets").collect())) == brute_totals(bids, slots)
    run = I.rebook(events, booked, new_bids, new_slots, totals, changes, minimum)
    found = sorted(map(tuple, run.events.select("event_rank", "day", "title_id", "bids_total", "num_tickets").collect()))
    expected = brute_events(bids, slots, minimum)
    assert found == expected
    assert 0 <= run.stood <= len(expected)
    rows = rows_of(bids, slots)
    _, status, cause = greedy(rows, ("day", "title_id"), ("day", "title_id"), minimum)
    result = I.with_outcome(run.events, run.booked, new_bids, new_slots)
    answers = sorted((r.user_id, r.day, r.title_id, r.status, r.cause_rank or 0) for r in result.outcome.collect())
    assert answers == sorted((r["user_id"], r["day"], r["title_id"], status[i], cause.get(i, 0)) for i, r in enumerate(rows))


def ladder(n=12):
    """Groups that do not disturb each other, of totals 100, 90, ..."""
    bids = {(f"u{i}", f"t{i}"): 10 * (n - i) for i in range(n)}
    return bids, {(f"u{i}", day(i)) for i in range(n)}


def test_only_what_a_change_can_reach_is_booked_again(spark, monkeypatch):
    bids, slots = ladder()
    old_bids, old_slots = tables(spark, bids, slots)
    totals, events, booked = I.first_run(old_bids, old_slots, 0)
    bids["u9", "t9"] += 5  # from 30 to 35, behind eight groups of 40 and more
    new_bids, _ = tables(spark, bids, slots)
    none = spark.createDataFrame([], SLOTS + ", sign int")
    changes = I.total_changes(I.joined_changes(
        old_bids, old_slots, delta(spark, old_bids, new_bids, new_bids.columns), none))
    seen = []
    monkeypatch.setattr(I, "book", lambda b, s, *more, **o: seen.append((b.count(), s.count())) or A.book(b, s, *more, **o))
    run = I.rebook(events, booked, new_bids, old_slots, totals, changes, 0)
    assert run.stood == 9 and seen == [(3, 3)]
    assert [tuple(r)[0] for r in run.events.orderBy("event_rank").collect()] == list(range(1, 13))
    # a change that cannot be booked leaves the run as it is
    bids["u0", "t11"] = 1
    more, _ = tables(spark, bids, slots)
    changes = I.total_changes(I.joined_changes(new_bids, old_slots, delta(spark, new_bids, more, more.columns), none))
    run = I.rebook(run.events, run.booked, more, old_slots, totals, changes, 30)
    assert not run.replayed and len(seen) == 1


def test_first_reach_takes_the_larger_total_and_breaks_ties(spark):
    totals = spark.createDataFrame([(day(1), "a", 50, 2), (day(0), "b", 50, 1), (day(0), "c", 9, 1)], "day date, title_id string, bids_total long, num_tickets long")
    change = lambda *rows: spark.createDataFrame(list(rows), totals.schema)
    first = lambda c, m=0, strict=True: (lambda r: r and tuple(r))(I.first_reach(totals, c, m, strict))
    assert first(change((day(1), "a", -50, -2), (day(0), "b", -1, 0))) == (50, day(0), "b")
    assert first(change((day(0), "c", 60, 1), (day(1), "a", 1, 0))) == (69, day(0), "c")
    assert first(change((day(3), "z", 7, 1))) == (7, day(3), "z")
    assert first(change((day(0), "c", -9, -1)), 9) is None
    assert first(change((day(0), "c", -9, -1)), 9, False) == (9, day(0), "c")


def test_changes_do_not_shuffle_the_tables(spark, capsys):
    bids, slots = ladder()
    old = tables(spark, bids, slots)
    changed = spark.createDataFrame([("u1", "t1", 5, 1)], BIDS + ", sign int")
    none = spark.createDataFrame([], SLOTS + ", sign int")
    I.joined_changes(*old, changed, none).explain()
    text = capsys.readouterr().out
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_stream_follows_changes(spark, tmp_path, batches):
    rng = random.Random(batches)
    bids, slots = some_tables(rng)
    base = [stored(t, "base") for t in tables(spark, bids, slots)]
    job = rebooking.Rebooking(*base, str(tmp_path / "job"), 25)
    lines = []
    for seq, (kind, user, title, on) in enumerate(change(rng, bids, slots, 14)):
        of_bid = kind < 2
        lines.append({
            "seq": seq, "table": "bid" if of_bid else "slot", "user_id": user, "title_id": title if of_bid else None,
            "day": None if of_bid else on.isoformat(), "status": S.AVAILABLE if kind in (0, 2) else S.CANCELED_BY_USER,
            "total_bid": bids.get((user, title)) if kind == 0 else None,
        })
        if kind == 0:
            lines[-1]["total_bid"] = bids[user, title]
    # no change: no key, no amount, a negative one, no JSON
    lines += [{"seq": 90, "table": "bid", "user_id": "u1", "status": S.AVAILABLE}, {"seq": 91, "table": "bid", "user_id": "u1", "title_id": "t1", "status": S.AVAILABLE},
              {"seq": 92, "table": "bid", "user_id": "u1", "title_id": "t1", "status": S.AVAILABLE, "total_bid": -4}]
    text = [json.dumps(line) for line in lines] + ["no message"]
    inbox = str(tmp_path / "inbox")
    stream = None
    for i in range(batches):
        own = text[i::batches] if batches == 1 else text[i * len(text) // batches : (i + 1) * len(text) // batches]
        writers.write_messages(spark.createDataFrame([(t,) for t in own], "value string").coalesce(1), inbox)
        stream = stream or readers.message_stream(spark, inbox)
        # a job made again on its folder goes on where it was
        job = rebooking.Rebooking(*base, str(tmp_path / "job"), 25)
        job.start(stream).awaitTermination()
    assert sorted((r.user_id, r.title_id, r.total_bid) for r in job.bids_now().collect()) == sorted((*k, v) for k, v in bids.items())
    assert sorted((r.user_id, r.day) for r in job.slots_now().collect()) == sorted(slots)
    assert sorted(map(tuple, job.totals().select("day", "title_id", "bids_total", "num_tickets").collect())) == brute_totals(bids, slots)
    found = sorted(map(tuple, job.events().select("event_rank", "day", "title_id", "bids_total", "num_tickets").collect()))
    assert found == brute_events(bids, slots, 25)
    assert job.runs().count() == batches + 1
    assert readers and spark.read.parquet(str(tmp_path / "job" / "unreadable")).where("value IS NOT NULL").count() == 1


def test_a_repeated_batch_counts_once(spark, tmp_path):
    bids, slots = ladder(4)
    job = rebooking.Rebooking(*[stored(t, "base") for t in tables(spark, bids, slots)], str(tmp_path), 0)
    line = json.dumps({"seq": 1, "table": "bid", "user_id": "u3", "title_id": "t3", "status": S.AVAILABLE, "total_bid": 99})
    batch = spark.createDataFrame([(line,)], "value string")
    for _ in range(2):
        job._step(batch, 0)
    bids["u3", "t3"] = 99
    assert sorted(map(tuple, job.totals().select("day", "title_id", "bids_total", "num_tickets").collect())) == brute_totals(bids, slots)
    assert [r.bids_total for r in job.events().orderBy("event_rank").collect()] == [99, 40, 30, 20]


# ---------------------------------------------------------------- requests at their own time


def moment(d, hour=0, micro=0):
    return datetime(2024, 1, d, hour, 0, 0, micro)


PERIODS = [("a", date(2024, 1, 3), date(2024, 1, 5)), ("a", date(2024, 1, 5), date(2024, 1, 9)), ("a", date(2024, 1, 20), date(2024, 1, 21)),
           ("b", date(2023, 1, 1), date(2030, 1, 1)), ("c", date(2024, 1, 9), date(2024, 1, 2)), ("d", None, date(2024, 1, 9))]


@pytest.mark.parametrize("days", [1, 4, 32, 5000])
def test_titles_are_judged_at_the_time_of_the_request(spark, days):
    asked = [(t, moment(*m)) for t in ("a", "b", "c", "d", "e", None) for m in ((2, 23), (3,), (4,), (5,), (5, 7), (9,), (9, 0, 1), (12,), (20,), (21,), (22,))]
    asked += [("a", None), ("a", moment(4)), ("a", datetime(1960, 5, 5)), ("b", datetime(2029, 12, 31))]
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "seq long, title_id string, at timestamp")
    periods = spark.createDataFrame(PERIODS, "title_id string, from date, to date")
    found = {r.seq: (r.title_known, r.title_valid) for r in R.at_their_time(requests, periods, days).collect()}
    start = lambda d: datetime(d.year, d.month, d.day)
    expected = {
        i: (t in "abcd" if t else False, any(t == p and at and a and start(a) <= at <= start(b) for p, a, b in PERIODS))
        for i, (t, at) in enumerate(asked)
    }
    assert found == expected


def test_no_nested_loop_above_the_size_limit(spark, monkeypatch, capsys):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests = spark.createDataFrame([(1, "a", moment(4))], "seq long, title_id string, at timestamp")
        rows = R.at_their_time(requests, spark.createDataFrame(PERIODS, "title_id string, from date, to date"))
        rows.explain()
        text = capsys.readouterr().out
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text
        assert [r.title_valid for r in rows.collect()] == [True]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_days_are_judged_at_the_time_and_zone_of_the_request(spark):
    rows = [(1, "put", "u", date(2024, 1, 4), None, moment(4, 23)), (2, "put", "u", date(2024, 1, 3), None, moment(4, 1)),
            (3, "put", "v", date(2025, 1, 4), None, moment(5)), (4, "put", "v", date(2025, 1, 6), None, moment(5)), (5, "put", "w", date(2024, 1, 5), None, None)]
    requests = spark.createDataFrame(rows, "seq long, op string, user_id string, day date, status string, at timestamp")
    slots = spark.createDataFrame([], "user_id string, day date, status string")
    utc = {r.seq: r.message for r in R.timeslot_requests(requests, slots, None, zone="UTC").results.collect()}
    assert [utc[i] == S.DAY_IN_PAST for i in range(1, 6)] == [False, True, False, False, False]
    assert utc[4] == S.DAY_TOO_FAR and utc[5] == S.INCOMPLETE_REQUEST
    west = {r.seq: r.message for r in R.timeslot_requests(requests, slots, None, zone="America/New_York").results.collect()}
    assert west[2] != S.DAY_IN_PAST and west[1] != S.DAY_IN_PAST


# ---------------------------------------------------------------- sizes, files, sketches


def test_a_sweep_equals_single_runs(spark):
    rng = random.Random(5)
    bids, slots = some_tables(rng, users=20, titles=4)
    sizes, all_bids, all_slots = [3, 7, 20, 50], *tables(spark, bids, slots)
    found = {r.total_users: r.asDict() for r in metrics.nested_sweep(all_bids, all_slots, sizes, 20).collect()}
    users = sorted({u for u, _ in bids} | {u for u, _ in slots})
    for size in sizes:
        own = set(users[:size])
        b, s = {k: v for k, v in bids.items() if k[0] in own}, {k for k in slots if k[0] in own}
        events, status, _ = greedy(rows_of(b, s), ("day", "title_id"), ("day", "title_id"), 20)
        booked = [r["user_id"] for i, r in enumerate(rows_of(b, s)) if status[i] == "B"]
        assert found[size] == {
            "total_users": size, "user_interest_rows": len(b), "user_timeslot_rows": len(s), "result_num_group": len(events),
            "result_total_money": sum(e[3] for e in events), "result_total_users": len(booked), "result_unique_users": len(set(booked)),
        }
    empty = metrics.nested_sweep(all_bids.limit(0), all_slots.limit(0), [1, 2], 20).collect()
    assert [(r.total_users, r.result_num_group) for r in sorted(empty)] == [(1, 0), (2, 0)]


def test_numbered_files_hold_their_lines_in_order(spark, tmp_path):
    rows = spark.range(0, 1037).selectExpr("lpad(string(id * 7919 % 1037), 6, '0') AS value").repartition(5)
    writers.write_numbered_lines(rows, ["value"], str(tmp_path / "files"), per_file=100)
    found = {}
    for path in sorted((tmp_path / "files").glob("file_no=*")):
        (part,) = path.glob("part-*")
        found[int(path.name.split("=")[1])] = part.read_text().splitlines()
    assert sorted(found) == list(range(11)) and [len(found[i]) for i in range(11)] == [100] * 10 + [37]
    assert [line for i in range(11) for line in found[i]] == [f"{i:06}" for i in range(1037)]


def test_expansion_to_size(spark):
    users = spark.range(10).selectExpr("id AS user_id", "id AS user_no")
    titles = spark.range(20).selectExpr("string(id) AS title_id")
    venues = spark.range(3).selectExpr("id AS venue_id")
    found = expand.expand_to_size(users, titles, venues, "2024-01-01", 0.2, 0.143).collect()
    assert len(found) == 10 * 4 * 2 and len({r.title_id for r in found}) == 20
    assert expand.expand_to_size(users, titles, venues, "2024-01-01", 0.0, 0.143).collect() == []
    assert expand.expand_to_size(users.limit(0), titles, venues, "2024-01-01", 0.2, 0.143).collect() == []


def test_sketches_of_runs_merge(spark):
    rows = [(f"r{r}", u) for r in range(4) for u in range(r * 1000, r * 1000 + 2500)] + [("empty", None), ("r0", None), ("r0", 5)]
    table = spark.createDataFrame(rows, "run string, user_id long")
    sketches = stored(metrics.run_sketches(table), "sketches")
    for chosen in (["r0"], ["r0", "r2"], ["r0", "r1", "r2", "r3"], ["empty"], ["none"]):
        exact = len({u for r, u in rows if r in chosen and u is not None})
        estimate = metrics.users_over(sketches.where(sketches.run.isin(chosen))).first().unique_users
        assert abs(estimate - exact) <= 0.03 * exact
    exact = {(r.run, r.other): r.users for r in metrics.exact_users_of_pairs(table).collect()}
    for r in metrics.users_of_pairs(sketches).collect():
        assert abs(r.estimate - exact.get((r.run, r.other), 0)) <= 0.03 * exact.get((r.run, r.other), 0)
    booked = spark.createDataFrame([(u,) for u in range(3000)], "user_id long")
    assert metrics.booked_users(booked).first().unique_users == 3000
    assert abs(metrics.booked_users(booked, approximate=True).first().unique_users - 3000) <= 300
