"""Profiles and run metrics."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seatpool import schemas as S
from seatpool.functions.columns import percent, sized
from seatpool.functions.ordered import numbered, sized as broadcast_if_small
from seatpool.operators.allocate import Bookings, book
from seatpool.session import stored


def input_profile(bids: DataFrame, slots: DataFrame) -> DataFrame:
    """Distinct users and titles, and row counts, in one row."""
    interest = bids.agg(
        F.countDistinct("user_id").alias("total_users"),
        F.countDistinct("title_id").alias("total_titles"),
        F.count("*").alias("user_interest_rows"),
        F.min("total_bid").alias("min_bid"),
        F.max("total_bid").alias("max_bid"),
    )
    days = slots.agg(F.count("*").alias("user_timeslot_rows"))
    return interest.join(F.broadcast(days), F.lit(True))  # one row each


def booked_users(booked: DataFrame, approximate: bool = False) -> DataFrame:
    """A5: distinct booked users; approximate where an estimate will do."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return booked.agg(count("user_id").alias("unique_users"))


def expected_rows(
    total_users: int,
    total_titles: int,
    interest_multiplier: float,
    slot_multiplier_per_day: float,
    days: int,
) -> dict[str, int]:
    """Row counts that multipliers stand for."""
    return {
        "user_interest_rows": sized(total_titles, interest_multiplier, total_users),
        "user_timeslot_rows": sized(total_users, slot_multiplier_per_day, days),
    }


def run_metrics(
    name: str, bids: DataFrame, slots: DataFrame, minimum=S.SWEEP_MINIMUM, **options
) -> tuple[DataFrame, Bookings]:
    """one run and its metrics row."""
    started = time.time()
    bookings = book(bids, slots, minimum, **options)
    processed = time.time()
    row = input_profile(bids, slots).join(F.broadcast(bookings.stats()), F.lit(True))
    finished = time.time()
    values = {
        "test_name": F.lit(name),
        "start_time": F.lit(int(started)),
        "end_time": F.lit(int(finished)),
        "total_duration": F.lit(int(finished - started)),
        "gen_input_duration": F.lit(0.0),
        "read_input_duration": F.lit(0.0),
        "process_duration": F.lit(processed - started),
        "max_num_ticket": F.lit(1),
        "min_group_bid": F.lit(minimum),
        "result_num_group": F.col("events_found"),
        "result_total_users": F.col("rows_booked"),
        "result_total_money": F.col("total_bids"),
        "result_unique_users": F.col("unique_users"),
    }
    columns = [
        values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in S.RUN_METRICS
    ]
    return row.select(*columns), bookings


def append_metrics(metrics: DataFrame, folder: str) -> None:
    """K6: one more row under the same header."""
    metrics.write.mode("append").option("header", True).csv(folder)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """S9."""
    return spark.read.schema(S.RUN_METRICS).option("header", True).csv(folder)


def size_sweep(
    populations: Iterable[tuple[str, DataFrame, DataFrame]], folder: str, minimum
) -> None:
    """A run per population, one metrics row each."""
    for name, bids, slots in populations:
        metrics, _ = run_metrics(name, bids, slots, minimum)
        append_metrics(metrics, folder)


def experiment_summary(metrics: DataFrame) -> DataFrame:
    """Mean metrics by population size, and shares of users booked."""
    numbers = [f.name for f in S.RUN_METRICS if f.name not in ("test_name", "total_users")]
    means = metrics.groupBy("total_users").agg(*[F.avg(n).alias(n) for n in numbers])
    return means.withColumn(
        "user_percent", percent(F.col("result_total_users"), F.col("total_users"))
    ).withColumn(
        "unique_user_percent", percent(F.col("result_unique_users"), F.col("total_users"))
    )


def nested_sweep(
    bids: DataFrame, slots: DataFrame, sizes: Iterable[int], minimum=S.SWEEP_MINIMUM, **options
) -> DataFrame:
    """X4 in one run: for every size, the booking of the first so many users, one row each.

    A user takes part once per population they belong to, as a user of its own that bids on
    titles of its own; populations thus never disturb each other, and all of them share the
    rounds. Users are numbered in the order of their ids.
    """
    spark, sizes = bids.sparkSession, sorted(set(sizes))
    users = bids.select("user_id").unionByName(slots.select("user_id")).where("user_id IS NOT NULL")
    users, count = numbered(users.distinct(), ["user_id"])
    listed = F.array(*[F.lit(size) for size in sizes]).cast("array<bigint>")
    part = F.explode(F.filter(listed, lambda size: F.col("position") < size)).alias("size")
    users = broadcast_if_small(users.select("user_id", part), count * len(sizes))
    own = lambda name: F.struct("size", name).alias(name)
    mine = stored(bids.join(users, "user_id").select("size", "user_id", "title_id", "total_bid"), "sweep-bids")
    free = stored(slots.join(users, "user_id").select("size", "user_id", "day"), "sweep-days")
    run = book(mine.select(own("user_id"), own("title_id"), "total_bid"), free.select(own("user_id"), "day"), minimum, **options)
    size = F.col("title_id.size").alias("size")
    parts = [
        mine.groupBy("size").agg(F.count("*").alias("user_interest_rows")),
        free.groupBy("size").agg(F.count("*").alias("user_timeslot_rows")),
        run.events.groupBy(size).agg(
            F.count("*").alias("result_num_group"), F.sum("bids_total").alias("result_total_money")
        ),
        run.booked.groupBy(size).agg(
            F.count("*").alias("result_total_users"), F.countDistinct("user_id").alias("result_unique_users")
        ),
    ]
    rows = spark.createDataFrame([(n,) for n in sizes], "size bigint")
    for found in parts:
        # a row per size
        rows = rows.join(F.broadcast(found), "size", "left")
    numbers = [n for n in rows.columns if n != "size"]
    filled = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers]
    return rows.select(F.col("size").alias("total_users"), *filled)


# ---------------------------------------------------------------- distinct users over runs

# Bits of a sketch: a relative error of some 0.8 %.
SKETCH_BITS = 14


def run_sketches(rows: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """A5, mergeable: per ``run`` a sketch of its users, of bounded size, to be stored with the
    run's metrics. A run without users, or with null users alone, has an empty sketch."""
    text = F.col("user_id").cast("string")
    return rows.groupBy("run").agg(F.hll_sketch_agg(text, bits).alias("users"))


def users_over(sketches: DataFrame) -> DataFrame:
    """Distinct users over all the runs given, out of their sketches alone."""
    merged = F.hll_union_agg("users").alias("users")
    return sketches.agg(merged).select(F.coalesce(F.hll_sketch_estimate("users"), F.lit(0)).alias("unique_users"))


def users_of_pairs(sketches: DataFrame) -> DataFrame:
    """``estimate`` for every two runs, ``run`` <= ``other``. There is a sketch per run, so pairs
    are few; the rows behind them are not read again."""
    one = sketches.select("run", F.col("users").alias("mine"))
    two = sketches.select(F.col("run").alias("other"), "users")
    both = one.join(F.broadcast(two), F.col("run") <= F.col("other"))
    return both.select("run", "other", F.hll_sketch_estimate(F.hll_union("mine", "users")).alias("estimate"))


def exact_users_of_pairs(rows: DataFrame) -> DataFrame:
    """The same counted: ``users`` of rows (run, user_id), each user once per pair."""
    runs = F.broadcast(rows.select(F.col("run").alias("with_run")).distinct())
    pairs = rows.where("user_id IS NOT NULL").join(runs, F.lit(True)).select(
        F.least("run", "with_run").alias("run"), F.greatest("run", "with_run").alias("other"), "user_id"
    )
    return pairs.groupBy("run", "other").agg(F.countDistinct("user_id").alias("users"))
