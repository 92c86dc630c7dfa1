"""Sinks (K1 to K8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seatpool import schemas as S
from seatpool.functions.columns import format_day
from seatpool.functions.ordered import latest, numbered


def as_json(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON message per row, in ``value``; days in ISO form."""
    fields = [
        format_day(c).alias(c) if rows.schema[c].dataType == T.DateType() else F.col(c)
        for c in columns
    ]
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))


def event_messages(events: DataFrame, *extra: str) -> DataFrame:
    """K1: a message per booked group; the total goes out as a floating number."""
    rows = events.withColumn("bids_total", F.col("bids_total").cast("double"))
    return as_json(rows, [*extra, "title_id", "day", "num_tickets", "bids_total"])


def reservation_messages(booked: DataFrame, *extra: str) -> DataFrame:
    """K2: a message per booked row."""
    return as_json(booked, [*extra, "user_id", "day", "title_id"])


def encoded(lines: DataFrame) -> DataFrame:
    """F8: messages as base64 on one line, the form of a stream record."""
    text = F.base64(F.col("value").cast("binary"))
    return lines.select(F.translate(text, "\r\n", "").alias("value"))


def write_messages(lines: DataFrame, folder: str) -> None:
    lines.write.mode("append").text(folder)


def write_canceled(canceled: DataFrame, folder: str) -> None:
    """K3: rows closed by a booking, where someone wants them."""
    canceled.write.mode("overwrite").parquet(folder)


def write_lines(lines: DataFrame, folder: str, per_file: int = 0) -> None:
    """K5: text, a file per task; or in files of a bounded number of lines, as
    ``schemas.LINES_PER_FILE``."""
    lines.write.option("maxRecordsPerFile", per_file).text(folder)


def write_numbered_lines(
    lines: DataFrame, order: Sequence[str], folder: str, per_file: int = S.LINES_PER_FILE
) -> None:
    """K5: lines (``value``) in the given order over numbered files of ``per_file`` lines each, but
    for the last. Numbers come from a sort by range; a file's lines meet in one task and are in
    order there."""
    placed, _ = numbered(lines, order)
    placed = placed.withColumn("file_no", F.expr(f"position DIV {per_file}"))
    placed = placed.repartition("file_no").sortWithinPartitions("file_no", "position")
    placed.select("file_no", "value").write.partitionBy("file_no").text(folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    """K7: header and rows, days with slashes."""
    days = {
        f.name: format_day(f.name, S.SLASH_DAY) for f in rows.schema if f.dataType == T.DateType()
    }
    rows = rows.withColumns(days) if days else rows
    rows.write.option("header", True).csv(folder)


def clear_table(spark: SparkSession, schema: T.StructType, folder: str) -> None:
    """K8: the table without rows."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)


def put_changes(changes: DataFrame, folder: str, batch: int) -> None:
    """K4, write side: the changes of one batch, in a folder of the batch.

    Plain Parquet has no merge, and a table is too large to be rewritten per
    batch. Writing a batch again replaces its own folder, so a batch that is
    repeated after a failure counts once.
    """
    changes.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def read_changes(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    before: int | None = None,
    since: int | None = None,
) -> DataFrame:
    """The changes so far, or those of batches after ``since`` and below ``before``, with their
    batch; none if nothing was written yet. Folders of other batches are not read."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(full).option("ignoreMissingFiles", True).parquet(folder)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows if since is None else rows.where(F.col("batch") > since)


def read_latest(
    spark: SparkSession, folder: str, schema: T.StructType, key: Sequence[str], seq: str = "seq"
) -> DataFrame:
    """K4, read side: the last change per key."""
    return latest(read_changes(spark, folder, schema), key, ["batch", seq]).drop("batch")


def compact(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    key: Sequence[str],
    target: str,
    upto: int,
    seq: str = "seq",
) -> None:
    """K4: the last change per key of all batches up to one, as one batch of a new folder.

    For changes that replace whole rows. Jobs whose changes set a status or some fields only
    start anew from a written table instead (``rebased``).

    Readers move to the new folder, and later batches are put there. It keeps
    what a read has to merge in proportion to the table, not to its history.
    """
    rows = read_changes(spark, folder, schema, upto + 1)
    put_changes(latest(rows, key, ["batch", seq]).drop("batch"), target, upto)
