"""What the operators share: tables, words, intermediate tables, connected components."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seatpool.session import discard, new_folder, stored_in

# White space and words, the same in Spark's, Python's and DuckDB's patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the cluster sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(identifier: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as empty text."""
    column = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def text_hash(text: str | Column) -> Column:
    """Tells rows of one id apart by their text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(column, F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows named by (doc_id, text_hash) in ``dropped``, ids may be null."""
    gone = dropped.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (text_hash(docs[text_col]) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest
    node reachable; roots themselves have no row.

    Large-star and small-star steps in turns until nothing changes. The least
    neighbour of each node is combined per task before the shuffle and written;
    the join that hands it to the edges of a node can then be split by AQE, so a
    node with many edges is no task of its own. Nothing but a count and a check
    sum comes to the driver. Each table is removed when the one made of it is written.
    """
    spark = edges.sparkSession
    work = new_folder(spark, "components")
    edges = stored_in(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        f"{work}/edges-0",
    )
    before, step = _state(edges), 0
    while before[0]:
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored_in(
            both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")),
            f"{work}/least-{step}",
        )
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored_in(large.filter("a <> b").distinct(), f"{work}/large-star-{step}")
        discard(spark, f"{work}/edges-{step - 1}")
        small_least = stored_in(edges.groupBy("a").agg(F.min("b").alias("m")), f"{work}/small-least-{step}")
        joined = edges.join(small_least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small_least.select("a", F.col("m").alias("b"))
        )
        edges = stored_in(small.filter("a <> b").distinct(), f"{work}/edges-{step}")
        for old in ("least", "large-star", "small-least"):
            discard(spark, f"{work}/{old}-{step}")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("check"),
    ).first()
    return row["n"], row["check"]


def workers_find_package(spark: SparkSession) -> None:
    """Python workers on this machine import the package from where the driver has it. On a
    cluster that has it installed, or gets it by --py-files, the entry does no harm."""
    root = str(Path(__file__).resolve().parents[2])
    found = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, found]))
