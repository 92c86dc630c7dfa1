"""The domain tables as read from the TPC-H-like test tables.

Every function reads whole tables and returns a lazy DataFrame. Column pruning
and the status filters reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seatpool import schemas as S
from seatpool.functions.columns import composite_key, format_hour, hours_after

FIRST_DAY = "2024-01-01"
NOW = "2024-01-03 00:00:00"

# order status to bid status, best first
STATUS_ORDER = (("O", S.AVAILABLE), ("P", S.BOOKED), ("F", S.EXPIRED))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_of(moment: Column) -> Column:
    """A day in the first fortnight of 2024, by day of year."""
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.dayofyear(moment) % 14).cast("int"))


def status_of(order_status: Column) -> Column:
    result = F.lit(None).cast("string")
    for code, status in STATUS_ORDER:
        result = F.when(order_status == code, status).otherwise(result)
    return result


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).join(
        parts, items.l_partkey == parts.p_partkey
    )


def interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AVAILABLE bids, one row per user and title."""
    return (
        _lines(spark, sf_dir)
        .where("o_orderstatus = 'O'")
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("title_id"))
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("total_bid"),
            F.count("*").cast("int").alias("num_tickets"),
        )
    )


def bids_with_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AVAILABLE bids, one row per order line, each with days of its own between which it holds;
    those of a user for a title overlap, meet or lie apart."""
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 12).cast("int"))
    return _lines(spark, sf_dir).where("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("user_id"),
        F.col("p_brand").alias("title_id"),
        F.col("l_quantity").cast("bigint").alias("total_bid"),
        first.alias("from"),
        F.date_add(first, F.col("l_linenumber").cast("int") - 1).alias("to"),
    )


def free_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AVAILABLE timeslots, one row per user and day."""
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderstatus = 'O'")
        .select(F.col("o_custkey").alias("user_id"), day_of(F.col("o_orderdate")).alias("day"))
        .distinct()
    )


def _ranked() -> Column:
    return F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)


def _status_of_rank(rank: Column) -> Column:
    return F.when(rank == 1, S.AVAILABLE).when(rank == 2, S.BOOKED).otherwise(S.EXPIRED)


def brand_number(title: Column) -> Column:
    return F.substring_index(title, "#", -1).cast("int")


def valid_from(title: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (brand_number(title) % 5).cast("int"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = brand_number(F.col("title_id"))
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("title_id"))
        .agg(F.min("p_name").alias("title_name"))
        .select(
            "title_id",
            "title_name",
            valid_from(F.col("title_id")).alias("from"),
            F.date_add(valid_from(F.col("title_id")), 14).alias("to"),
            F.when(number > 12, 1).otherwise(0).alias("expired"),
            F.when(number % 10 != 0, 2020 + number % 5).alias("year"),
            F.lit(S.EVENT_CAPACITY).alias("tickets_available"),
        )
    )


def raw_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bid per order line, numbers as text, several per user and title."""
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("user_id"),
        F.col("p_brand").alias("title_id"),
        status_of(F.col("o_orderstatus")).alias("status"),
        F.col("l_linenumber").cast("string").alias("num_tickets"),
        F.col("l_quantity").cast("decimal(10,2)").cast("string").alias("ticket_bid"),
        F.col("l_quantity").cast("bigint").alias("total_bid"),
        "l_orderkey",
        "l_linenumber",
    )


def user_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bid per user and title: the order lines of the best status present."""
    rank = _ranked()
    aggregates = [F.min(rank).alias("rank")]
    for number in (1, 2, 3):
        quantity = F.when(rank == number, F.col("l_quantity"))
        aggregates += [
            F.sum(quantity.cast("bigint")).alias(f"total_{number}"),
            F.count(quantity).cast("int").alias(f"lines_{number}"),
            F.max(quantity).cast("decimal(10,2)").alias(f"best_{number}"),
        ]
    rows = (
        _lines(spark, sf_dir)
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("title_id"))
        .agg(*aggregates)
    )

    def chosen(name: str) -> Column:
        return (
            F.when(F.col("rank") == 1, F.col(f"{name}_1"))
            .when(F.col("rank") == 2, F.col(f"{name}_2"))
            .otherwise(F.col(f"{name}_3"))
        )

    return rows.select(
        composite_key("user_id", "title_id").alias("user_id_title_id"),
        "user_id",
        "title_id",
        _status_of_rank(F.col("rank")).alias("status"),
        chosen("lines").alias("num_tickets"),
        chosen("best").alias("ticket_bid"),
        chosen("total").alias("total_bid"),
        valid_from(F.col("title_id")).alias("from"),
        F.date_add(valid_from(F.col("title_id")), 14).alias("to"),
        (chosen("total") % 2 == 0).alias("is_preapp"),
    ).withColumn("user_id_status", composite_key("user_id", "status"))


def user_timeslots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timeslot per user and day, with the best status present."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"), day_of(F.col("o_orderdate")).alias("day"))
        .agg(F.min(_ranked()).alias("rank"))
        .select(
            composite_key("user_id", "day").alias("user_id_day"),
            "user_id",
            "day",
            _status_of_rank(F.col("rank")).alias("status"),
            ((F.col("user_id") + F.dayofmonth("day")) % 2 == 0).alias("is_preapp"),
        )
    )


def venue_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AVAILABLE bids on a title at a venue and a full hour, one per order line."""
    hour = (F.col("l_linenumber") % 7 * 2).cast("int")
    return (
        _lines(spark, sf_dir)
        .where("o_orderstatus = 'O'")
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("p_brand").alias("title_id"),
            format_hour(hours_after(day_of(F.col("o_orderdate")), hour)).alias("timeslot"),
            (F.col("l_suppkey") % 5).cast("string").alias("venue_id"),
            F.col("l_quantity").cast("bigint").alias("total_bid"),
        )
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of users about a title and a day."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
        F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("title_id"),
        day_of(F.col("ts")).alias("day"),
    )


def reservation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _requests(spark, sf_dir)
        .where("event_type = 'purchase'")
        .select("seq", "user_id", "day", "title_id")
    )


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cancel = F.col("event_type") == "error"
    return (
        _requests(spark, sf_dir)
        .where(F.col("event_type").isin("purchase", "click", "error"))
        .withColumn("op", F.when(cancel, "cancel").otherwise("put"))
        .withColumn("status", F.when(cancel, S.CANCELED_BY_USER))
    )


def bid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and cancels of bids; what is null is left to the defaults."""
    return _changes(spark, sf_dir).select(
        "seq",
        "op",
        "user_id",
        "title_id",
        "status",
        F.when(F.col("k") % 3 != 0, F.col("k") % 7 + 1).cast("int").alias("num_tickets"),
        F.col("value").cast("decimal(10,2)").alias("ticket_bid"),
        F.col("day").alias("from"),
        F.date_add("day", 7).alias("to"),
        F.when(F.col("k") % 4 == 0, F.lit(False)).alias("is_preapp"),
    )


def timeslot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select(
        "seq",
        "op",
        "user_id",
        "day",
        "status",
        F.when(F.col("k") % 4 == 0, F.lit(False)).alias("is_preapp"),
    )


def preference_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _requests(spark, sf_dir)
        .where("event_type = 'signup'")
        .select(
            "seq",
            "user_id",
            F.when(F.col("k") % 2 == 0, F.lit(False)).alias("is_preapp"),
            F.when(F.col("k") % 3 == 0, F.lit("OR")).alias("or_or_any"),
        )
    )


def contract_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids as outsiders send them, some outside the declared ranges."""
    return _requests(spark, sf_dir).select(
        "seq",
        F.concat(F.lit("member"), F.col("user_id").cast("string")).alias("user_id"),
        (F.col("k") * 6).alias("num_tickets"),
        F.col("value").cast("decimal(10,2)").alias("ticket_bid"),
    )


def ticket_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _requests(spark, sf_dir)
        .where("event_type = 'click'")
        .select("seq", "user_id", "title_id", "day", (F.col("k") % 4 + 1).alias("num_tickets"))
    )


def cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _requests(spark, sf_dir).where("event_type = 'error'").select("user_id", "title_id", "day")
    )


def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids that are made or raised, days that are declared free, and cancels of both."""
    cancel, on_bid = F.col("event_type") == "error", F.col("k") % 2 == 0
    of_bid = (F.col("event_type") == "purchase") | (cancel & on_bid)
    return _changes(spark, sf_dir).select(
        "seq",
        F.when(of_bid, "bid").otherwise("slot").alias("table"),
        "user_id",
        F.when(of_bid, F.col("title_id")).alias("title_id"),
        F.when(~of_bid, F.col("day")).alias("day"),
        F.coalesce("status", F.lit(S.AVAILABLE)).alias("status"),
        F.when(of_bid & ~cancel, (F.col("k") % 40 * 10 + 10).cast("bigint")).alias("total_bid"),
    )


def title_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods in which a title is on offer: two with a gap, and for some a third that overlaps
    both ends of the gap."""
    number = brand_number(F.col("title_id"))
    start = valid_from(F.col("title_id"))
    third = F.struct(F.date_add(start, 4).alias("from"), F.date_add(start, 11).alias("to"))
    periods = F.array(
        F.struct(start.alias("from"), F.date_add(start, 6).alias("to")),
        F.struct(F.date_add(start, 10).alias("from"), F.date_add(start, 20).alias("to")),
        F.when(number % 3 == 0, third),
    )
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("title_id")).distinct()
    rows = brands.where(number % 8 != 7).select("title_id", F.explode(periods).alias("period"))
    return rows.where("period IS NOT NULL").select("title_id", "period.from", "period.to")


def with_moments(spark: SparkSession, sf_dir: str, requests: DataFrame) -> DataFrame:
    """Requests with the moment ``at`` they were made."""
    moments = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return requests.join(moments, "seq")


def dated_timeslot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeslot requests for a day from some days before to a year after the moment they are made."""
    rows = with_moments(spark, sf_dir, timeslot_requests(spark, sf_dir))
    return rows.withColumn("day", F.date_add(F.to_date("at"), (F.col("seq") % 25 * 16 - 16).cast("int")))
