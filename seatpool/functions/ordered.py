"""Running values along a sequence, without gathering a whole key in one task.

A key may hold a large share of all rows. Rows are cut into blocks along the
sequence; a block holds at most ``block`` rows of a key. What earlier blocks hand
over is computed on one row per key and block, and joined back to the rows of
the block. Blocks are cut by sequence number where the numbers lie close
together, and by rank where they do not, so that there are never many more
blocks than rows / ``block``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seatpool.session import stored

BLOCK = 100_000

# Blocks cut by number may be so many times as many as blocks cut by rank.
SPARSE = 4

# Row counts, known beforehand, up to which a side is broadcast: some 50 MB for the widest.
BROADCAST_ROWS = 500_000


def in_blocks(rows: DataFrame, seq: str, block: int = BLOCK) -> DataFrame:
    """Add ``block_no``, which grows along ``seq``; rows without a number are in no known block."""
    found = rows.agg(
        F.count(seq).alias("n"), F.min(seq).alias("low"), F.max(seq).alias("high")
    ).first()
    if found["n"] and (found["high"] - found["low"]) // block > SPARSE * (found["n"] // block + 1):
        ranked, _ = numbered(rows, [seq])
        place = F.floor(F.col("position") / block).cast("bigint")
        return ranked.withColumn("block_no", place).drop("position")
    # whole division, which is exact for the largest numbers too
    return rows.withColumn("block_no", F.expr(f"CAST(`{seq}` AS BIGINT) DIV {block}"))


def running(
    rows: DataFrame,
    key: Sequence[str],
    seq: str,
    *,
    totals: dict[str, Column] | None = None,
    firsts: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Add values of the rows before each row of the same key, for rows ``in_blocks``.

    ``totals`` adds the sum of a column over earlier rows (null if there are
    none), ``firsts`` the least non-null value of a column over earlier rows,
    and ``previous`` the value of a column on the row just before.
    """
    totals, firsts, previous = totals or {}, firsts or {}, previous or {}
    # Rows that come from a join by key lie in one task per key; that would also satisfy the
    # window below, so they are dealt out by block here.
    rows = rows.repartition(*key, "block_no")
    per_block = rows.groupBy(*key, "block_no").agg(
        *[F.sum(column).alias(f"sum_{name}") for name, column in totals.items()],
        *[F.min(column).alias(f"min_{name}") for name, column in firsts.items()],
        *[
            F.max_by(F.struct(F.col(column).alias("value")), seq).alias(f"last_{name}")
            for name, column in previous.items()
        ],
    )
    blocks = Window.partitionBy(*key).orderBy("block_no")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(
        *key,
        "block_no",
        *[F.sum(f"sum_{name}").over(earlier).alias(f"carry_{name}") for name in totals],
        *[F.min(f"min_{name}").over(earlier).alias(f"carry_{name}") for name in firsts],
        *[F.lag(f"last_{name}").over(blocks).alias(f"carry_{name}") for name in previous],
    )
    within = Window.partitionBy(*key, "block_no").orderBy(seq)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        *[F.sum(column).over(before).alias(f"local_{name}") for name, column in totals.items()],
        *[F.min(column).over(before).alias(f"local_{name}") for name, column in firsts.items()],
        *[
            F.lag(F.struct(F.col(column).alias("value"))).over(within).alias(f"local_{name}")
            for name, column in previous.items()
        ],
    )
    joined = local.join(per_block, [*key, "block_no"])
    added = [
        F.when(
            F.coalesce(f"local_{name}", f"carry_{name}").isNotNull(),
            F.coalesce(f"local_{name}", F.lit(0)) + F.coalesce(f"carry_{name}", F.lit(0)),
        ).alias(name)
        for name in totals
    ]
    added += [F.least(f"local_{name}", f"carry_{name}").alias(name) for name in firsts]
    added += [
        F.coalesce(f"local_{name}", f"carry_{name}")["value"].alias(name) for name in previous
    ]
    kept = [name for name in rows.columns if name != "block_no"]
    return joined.select(*kept, *added)


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """U1, read side: the last row per key. Combined per task before the shuffle."""
    others = [name for name in rows.columns if name not in key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("last")
    return rows.groupBy(*key).agg(last).select(*key, "last.*").select(*rows.columns)


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in an explicit order."""
    others = [name for name in rows.columns if name not in key]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("first")
    return rows.groupBy(*key).agg(first).select(*key, "first.*").select(*rows.columns)


def numbered(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Add ``position``, 0, 1, ... in the given order; also the number of rows.

    Rows are sorted by range over the cluster, and only one count per partition
    comes to the driver. The sorted rows are stored first, since partition
    borders are sampled and must not move between uses.
    """
    ranged = rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id())
    ranged = stored(ranged, "numbered")
    counts = ranged.groupBy("range_no").count().orderBy("range_no").collect()
    offsets, total = [F.lit(-1), F.lit(0)], 0
    for row in counts:
        offsets += [F.lit(row["range_no"]), F.lit(total)]
        total += row["count"]
    within = Window.partitionBy("range_no").orderBy(*order)
    before = F.create_map(*offsets)[F.col("range_no")]
    position = (before + F.row_number().over(within) - 1).cast("bigint")
    return ranged.withColumn("position", position).drop("range_no"), total


def sized(rows: DataFrame, count: int) -> DataFrame:
    """A side of a join whose row count is known: broadcast if that is small enough."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows
