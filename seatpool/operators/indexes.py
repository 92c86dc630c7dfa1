"""Covering indexes: the columns a listing needs, laid out by its lookup key.

A table and its indexes are written as generations side by side. An index is used only if it is
of the generation of the table; otherwise the lookup reads the table itself, which gives the
same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from seatpool import schemas as S
from seatpool.session import exists

#: Rows of a file of an index.
ROWS_PER_FILE = 2_000_000
#: Rows of a row group, the least that a lookup can leave out.
ROWS_PER_GROUP = 20_000
#: Lookups of at most so many keys name them in the scan; beyond it they are joined.
KEYS_IN_SCAN = 2_000


@dataclass(frozen=True)
class Index:
    """Columns of a table by a lookup key; rows of one key lie in the order of ``order``."""

    name: str
    key: str
    order: str
    columns: tuple[str, ...]


BIDS_BY_USER_AND_STATUS = Index(
    "user_id_status",
    "user_id_status",
    "user_id_title_id",
    ("user_id", "user_id_title_id", "user_id_status", "title_id", "num_tickets", "ticket_bid", "from", "status", "is_preapp"),
)
TIMESLOTS_BY_USER = Index(
    "user_id", "user_id", "user_id_day", ("user_id_day", "user_id", "day", "status", "is_preapp")
)
TIMESLOTS_BY_STATUS = Index(
    "status", "status", "user_id_day", ("user_id_day", "status", "day", "is_preapp")
)
TITLES_BY_EXPIRED = Index(
    "expired", "expired", "title_id", ("title_id", "expired", "title_name")
)
EVENTS_BY_STATUS = Index(
    "status",
    "status",
    "title_id_day",
    ("title_id_day", "status", "title_name", "day", "ticket_price", "num_tickets_available"),
)


def write_indexed(
    rows: DataFrame,
    folder: str,
    generation: int,
    indexes: Sequence[Index],
    per_file: int = ROWS_PER_FILE,
    per_group: int = ROWS_PER_GROUP,
) -> None:
    """The table as one more generation, then its indexes, made of what was written.

    Writing a generation again replaces it. A reader takes the last generation that is complete.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(_path(folder, "table", generation))
    written = _read(spark, _path(folder, "table", generation))
    count = written.count()
    for index in indexes:
        write_index(written, folder, generation, index, max(1, -(-count // per_file)), per_group)


def write_index(
    rows: DataFrame, folder: str, generation: int, index: Index, files: int, per_group: int = ROWS_PER_GROUP
) -> None:
    """Ranges of (key, order), so that a key with a third of the rows is spread over files; each
    is sorted, and row groups carry a bloom filter of the key besides their bounds."""
    ranged = rows.select(*index.columns).repartitionByRange(files, index.key, index.order)
    (
        ranged.sortWithinPartitions(index.key, index.order)
        .write.mode("overwrite")
        .option("parquet.block.row.count.limit", per_group)
        .option(f"parquet.bloom.filter.enabled#{index.key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{index.key}", per_group)
        .parquet(_path(folder, f"by-{index.name}", generation))
    )


def under(
    spark: SparkSession, folder: str, index: Index, keys: DataFrame, in_scan: int = KEYS_IN_SCAN
) -> DataFrame:
    """Rows, in the columns of the index, under any of the ``keys`` (a column named as the key);
    null is no key. From the table itself if the index is older than the table or missing."""
    last = generation(spark, folder)
    if last is None:
        raise ValueError(f"no complete table in {folder}")
    path = _path(folder, f"by-{index.name}", last)
    if not exists(spark, f"{path}/_SUCCESS"):
        path = _path(folder, "table", last)
    rows = _read(spark, path).select(*index.columns)
    return restricted(rows, index.key, keys, in_scan)


def restricted(rows: DataFrame, key: str, keys: DataFrame, in_scan: int = KEYS_IN_SCAN) -> DataFrame:
    """Rows whose key is among ``keys``. A bounded number of keys is named in the filter, which
    reaches bounds and bloom filters of row groups; more are joined. The rows are the same."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    named = [row[0] for row in wanted.limit(in_scan + 1).collect()]
    if len(named) <= in_scan:
        return rows.where(F.col(key).isin(named))
    return rows.join(wanted, key, "left_semi").select(*rows.columns)


def generation(spark: SparkSession, folder: str) -> int | None:
    """The last generation of the table that is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/table")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = [status.getPath() for status in files.listStatus(path)]
    numbers = sorted((int(p.getName().removeprefix("generation-")) for p in found), reverse=True)
    return next((n for n in numbers if exists(spark, f"{_path(folder, 'table', n)}/_SUCCESS")), None)


def keys_of(users: DataFrame, status: str = S.AVAILABLE) -> DataFrame:
    """Keys of ``BIDS_BY_USER_AND_STATUS`` for users and a status."""
    user = F.col("user_id").cast("string")
    key = F.when(user.isNotNull(), F.concat_ws("_", user, F.lit(status)))
    return users.select(key.alias("user_id_status"))


def statuses(spark: SparkSession, *values: str) -> DataFrame:
    """Keys of an index by status."""
    return spark.createDataFrame([(value,) for value in values], "status string")


def _path(folder: str, part: str, number: int) -> str:
    return f"{folder}/{part}/generation-{number}"


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
