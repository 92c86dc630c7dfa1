"""Sources (S1 to S9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from seatpool import schemas as S
from seatpool.functions.columns import parse_day
from seatpool.functions.ordered import first_by

# Above all sequence numbers that senders give.
FIRST_ARRIVAL = 2**62


def _csv_in_file_order(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(
        *rows.columns,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            # grows along the lines of one block
            F.monotonically_increasing_id().alias("line"),
        ).alias("file_order"),
    )


def interest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Interest rows, the first per user and title in file order."""
    rows = _csv_in_file_order(spark, path, S.INTEREST_CSV)
    return first_by(rows, ["user_id", "title_id"], ["file_order"]).drop("file_order")


def timeslot_csv(spark: SparkSession, path: str) -> DataFrame:
    """Free days; duplicates are the same row, so any of them will do."""
    rows = spark.read.schema(S.TIMESLOT_CSV).option("header", True).csv(path)
    return rows.withColumn("day", parse_day("day", S.SLASH_DAY)).distinct()


def available_bids(bids: DataFrame) -> DataFrame:
    """AVAILABLE bids with their total.

    Numbers may be stored as text; rows that are no numbers are listed by
    ``unreadable_bids``.
    """
    total = _tickets() * _ticket_bid()
    return (
        bids.where(F.col("status") == S.AVAILABLE)
        .select("user_id", "title_id", "num_tickets", "ticket_bid", total.alias("total_bid"))
        .where("total_bid IS NOT NULL")
    )


def unreadable_bids(bids: DataFrame) -> DataFrame:
    """AVAILABLE bids whose numbers cannot be read."""
    unread = _tickets().isNull() | _ticket_bid().isNull()
    return bids.where((F.col("status") == S.AVAILABLE) & unread)


def _tickets() -> Column:
    return F.col("num_tickets").try_cast("int")


def _ticket_bid() -> Column:
    return F.col("ticket_bid").try_cast("decimal(10,2)")


def available_timeslots(slots: DataFrame) -> DataFrame:
    """AVAILABLE timeslots as user and day."""
    return slots.where(F.col("status") == S.AVAILABLE).select("user_id", "day")


# Venue lines come as `user title timeslot venue bid` with a timeslot of one
# token or of a day and an hour, or without the user and with a day and an hour.
_DAY_HOUR = r"\d{4}-\d{2}-\d{2} \d{2}:00"
_WITH_USER = rf"^(\S+) (\S+) ({_DAY_HOUR}|\S+) (\S+) (-?\d+)$"
_WITHOUT_USER = rf"^(\S+) ({_DAY_HOUR}) (\S+) (-?\d+)$"


def venue_bids_text(spark: SparkSession, path: str) -> DataFrame:
    """Venue bids from text lines; other lines are dropped."""
    line = F.col("value")
    bare = line.rlike(_WITHOUT_USER)

    def token(with_user: int, without_user: int | None) -> Column:
        user_form = F.regexp_extract(line, _WITH_USER, with_user)
        if without_user is None:
            return F.when(bare, None).otherwise(user_form)
        return F.when(bare, F.regexp_extract(line, _WITHOUT_USER, without_user)).otherwise(user_form)

    return (
        spark.read.text(path)
        .where(bare | line.rlike(_WITH_USER))
        .select(
            token(1, None).alias("user_id"),
            token(2, 1).alias("title_id"),
            token(3, 2).alias("timeslot"),
            token(4, 3).alias("venue_id"),
            token(5, 4).try_cast("bigint").alias("total_bid"),
        )
        .where("total_bid IS NOT NULL")
    )


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """The first token of every line."""
    first = F.split("value", " ")[0]
    return spark.read.text(path).select(first.alias("id")).where("id != ''")


def messages(lines: DataFrame, schema: T.StructType, seq: bool = True) -> DataFrame:
    """JSON messages, one per line in ``value``; lines that do not parse are dropped.

    Works the same on a static and on a streaming DataFrame.
    """
    parsed = lines.select(_parsed(schema, seq).alias("m"))
    return parsed.where("m IS NOT NULL AND m.unparsed IS NULL").select("m.*").drop("unparsed")


def unreadable(lines: DataFrame, schema: T.StructType, seq: bool = True) -> DataFrame:
    """The lines that ``messages`` drops."""
    parsed = lines.select("value", _parsed(schema, seq).alias("m"))
    return parsed.where("m IS NULL OR m.unparsed IS NOT NULL").select("value")


def _parsed(schema: T.StructType, seq: bool) -> Column:
    fields = [T.StructField("seq", T.LongType())] if seq else []
    bad = T.StructField("unparsed", T.StringType())
    schema = T.StructType([*fields, *schema.fields, bad])
    return F.from_json("value", schema, {"columnNameOfCorruptRecord": bad.name})


def in_arrival_order(rows: DataFrame) -> DataFrame:
    """Messages without a sequence number come after those with one, as they arrived."""
    arrived = F.lit(FIRST_ARRIVAL) + F.monotonically_increasing_id()
    return rows.withColumn("seq", F.coalesce("seq", arrived))


def delivered(lines: DataFrame, content: str = "body") -> DataFrame:
    """Messages out of deliveries ``{"Records": [{content: message}, ...]}``.

    ``content`` may be a path of two names, such as ``Sns.Message``. A message
    may be an object or its text.
    """
    kind = T.StringType()
    for name in reversed(content.split(".")):
        kind = T.StructType([T.StructField(name, kind)])
    schema = T.StructType([T.StructField("Records", T.ArrayType(kind))])
    records = lines.select(F.from_json("value", schema)["Records"].alias("records"))
    return records.select(F.explode(f"records.{content}").alias("value"))


def decoded(lines: DataFrame) -> DataFrame:
    """Lines of base64 as text."""
    return lines.select(F.unbase64("value").cast("string").alias("value"))


def event_messages(lines: DataFrame, seq: bool = False) -> DataFrame:
    """S6 for events: days as dates, whichever of the two formats they came in."""
    return _with_day(messages(lines, S.EVENT_MESSAGE, seq))


def reservation_messages(lines: DataFrame, seq: bool = True) -> DataFrame:
    """S6 for reservations."""
    return _with_day(messages(lines, S.RESERVATION_MESSAGE, seq))


def _with_day(parsed: DataFrame) -> DataFrame:
    day = F.coalesce(parse_day("day", S.ISO_DAY), parse_day("day", S.SLASH_DAY))
    return parsed.withColumn("day", day)


def bid_records(lines: DataFrame, seq: bool = True) -> DataFrame:
    """Bid changes; numbers come as text and are read, days become dates."""
    rows = messages(lines, S.BID_RECORD, seq)
    return rows.withColumns(
        {
            "num_tickets": _tickets(),
            "ticket_bid": _ticket_bid(),
            "from": parse_day("from"),
            "to": parse_day("to"),
        }
    )


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int = S.POLL_SIZE):
    """Lines of message files as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
