"""Lookups by index against listings that read the whole table, and how much they read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seatpool import schemas as S
from seatpool.operators import indexes as I, listings
from seatpool.session import new_folder

BIDS = I.BIDS_BY_USER_AND_STATUS


def bids(spark, users, per_user=3):
    """Bids of users; user 7 holds a third of all."""
    rows = spark.range(users * per_user).withColumn(
        "user_id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % users).cast("string")
    )
    status = F.when(F.col("id") % 5 == 0, S.CANCELED).otherwise(S.AVAILABLE)
    return rows.select(
        F.concat_ws("_", "user_id", F.col("id")).alias("user_id_title_id"),
        "user_id",
        F.col("id").cast("string").alias("title_id"),
        status.alias("status"),
        F.lit(1).alias("num_tickets"),
        F.lit(2).alias("ticket_bid"),
        F.lit("2024-01-01").alias("from"),
        F.lit(True).alias("is_preapp"),
        F.concat_ws("_", "user_id", status).alias("user_id_status"),
        F.lit("wide").alias("not_in_index"),
    )


def askers(spark, *users):
    return spark.createDataFrame([(u,) for u in users], "user_id string")


def leaves(plan):
    """Scans of an executed plan, those of finished stages too."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return leaves(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return leaves(plan.plan())
    children = plan.children()
    found = [scan for i in range(children.size()) for scan in leaves(children.apply(i))]
    return found or [plan]


def rows_read(found):
    """Rows that come out of the scans of Parquet files once ``found`` has run."""
    plan = found._jdf.queryExecution().executedPlan()
    return sum(scan.metrics().apply("numOutputRows").value() for scan in leaves(plan) if "Scan" in scan.nodeName())


def same(found, expected):
    return sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("in_scan", [0, 2000])
def test_lookup_equals_the_listing_of_the_whole_table(spark, in_scan):
    rows, folder = bids(spark, 200), new_folder(spark, "indexes")
    I.write_indexed(rows, folder, 1, [BIDS], per_file=100, per_group=20)
    for users in ((), ("7",), ("3", "3", None, "nobody"), tuple(map(str, range(0, 200, 3)))):
        asked = askers(spark, *users)
        found = I.under(spark, folder, BIDS, I.keys_of(asked), in_scan)
        assert found.columns == list(BIDS.columns)
        assert same(listings.active_bids(found), listings.active_bids(rows, asked))
        assert same(listings.active_bids(found, limit=2, after="15"), listings.active_bids(rows, asked, limit=2, after="15"))


def test_lookup_reads_few_row_groups(spark):
    """15 users of 20,000, in over 200 row groups."""
    rows, folder = bids(spark, 20_000, 10).coalesce(4), new_folder(spark, "indexes")
    I.write_indexed(rows, folder, 1, [BIDS], per_file=25_000, per_group=1_000)
    asked = askers(spark, *[str(u * 997) for u in range(1, 16)])
    found = I.under(spark, folder, BIDS, I.keys_of(asked))
    listed = listings.active_bids(found)
    assert listed.count() and same(listed, listings.active_bids(rows, asked))
    found.collect()
    assert rows_read(found) < 0.1 * rows.count()


def test_hot_key_is_spread_over_files(spark):
    rows, folder = bids(spark, 2_000), new_folder(spark, "indexes")
    I.write_indexed(rows, folder, 1, [BIDS], per_file=500)
    files = spark.read.parquet(f"{folder}/by-user_id_status/generation-1").groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] < 1_500


def test_index_that_is_older_than_the_table_is_not_used(spark):
    rows, folder = bids(spark, 50), new_folder(spark, "indexes")
    keys = I.keys_of(askers(spark, "7", "8"))
    with pytest.raises(ValueError):
        I.under(spark, folder, BIDS, keys)
    I.write_indexed(rows, folder, 1, [BIDS])
    newer = rows.where("title_id <> '8'").withColumn("num_tickets", F.lit(9))
    I.write_indexed(newer, folder, 2, [])
    assert I.generation(spark, folder) == 2
    found = I.under(spark, folder, BIDS, keys)
    expected = newer.join(keys, "user_id_status", "left_semi").select(*BIDS.columns)
    assert same(found, expected)
    I.write_indexed(newer, folder, 3, [BIDS])
    assert "by-user_id_status" in I.under(spark, folder, BIDS, keys).inputFiles()[0]
    assert same(I.under(spark, folder, BIDS, keys), expected)
    # A generation that was not written to its end is not the last one.
    newer.where("false").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/table/generation-4")
    assert I.generation(spark, folder) == 3


def test_empty_table_and_null_keys(spark):
    rows, folder = bids(spark, 10), new_folder(spark, "indexes")
    I.write_indexed(rows.limit(0), folder, 1, [BIDS])
    assert I.under(spark, folder, BIDS, I.keys_of(askers(spark, "7"))).collect() == []
    unkeyed = rows.withColumn("user_id_status", F.when(F.col("user_id") != "7", F.col("user_id_status")))
    I.write_indexed(unkeyed, folder, 2, [BIDS])
    assert I.under(spark, folder, BIDS, I.keys_of(askers(spark, "7", None))).collect() == []
