"""Mixing of sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window, functions as F

from seatpool.functions.ordered import sized
from seatpool.llm.common import WORD, text_hash
from seatpool.session import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of a block. Sources miss their targets by half a block at most.
BLOCK_WORDS = 64
_CELLS = 1024
_SLOTS_IN_CHUNK = 65_536
_GOLDEN = 0.6180339887498949
_LONGEST = 3_000_000_000  # products of two numbers below it fit a long
_SEED = 7


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source of (source, size): source_no, source, source_size, target.

    Sources in code point order, null last, weigh 5, 2, 1 in turns and share 150 % of all
    sizes; a target ends at twice the size of its source, and the excess goes to the others by
    weight until none is above. That is the level at which weights times level, cut at the
    caps, add up to the whole: caps in order of cap by weight are full as long as the level
    that is left for the others exceeds them. Windows run over one row per source.
    """
    rows = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    rows = rows.withColumn("source_no", number).withColumn(
        "weight", F.element_at(weights, (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    )
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(MOST)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    rows = rows.withColumn(
        "level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    )
    free = F.col("cap") > F.col("weight") * F.col("level")
    rows = rows.withColumn("common", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))).over(every)["level"])
    return rows.select(
        "source_no",
        "source",
        "source_size",
        F.when(F.col("common").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("weight") * F.col("common")))
        .alias("target"),
    )


def needed(aims: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``aims`` with ``blocks`` of a source and ``slots`` it needs, by the words that blocks hold.

    Whole epochs first, then as many blocks as come nearest to the rest of the target; the last
    block of a source may hold fewer words than others.
    """
    size = F.col("source_size")
    blocks = F.ceil(size / block_words)
    epochs = F.floor(F.col("target") / size)
    rest = F.col("target") - epochs * size
    few = F.floor(rest / block_words)
    more = rest - few * block_words > F.least((few + 1) * block_words, size) - rest
    return aims.filter("target > 0").select(
        "source_no", blocks.alias("blocks"), (epochs * blocks + few + more.cast("int")).cast("long").alias("slots")
    )


def schedule(aims: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The order of the mix: slot, source_no, epoch, block.

    Slot i of n looks at point frac(i * g / n) of the cumulative slots of the sources, where g/n
    is next to the golden ratio and g has no factor in common with n. So every one of the n
    points comes once, each source gets just the slots it needs, and its slots lie evenly. Slots
    of a source are numbered in their order; the n-th takes the n-th block of the source's
    shuffled words, and begins again after the last. Numbers are counted per chunk of slots and
    carried on, so no source is one task.
    """
    spark = aims.sparkSession
    rows = needed(aims, block_words).filter("slots > 0")
    total, sources = rows.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    step = max(1, round(total * _GOLDEN))
    while gcd(step, total) > 1:
        step += 1
    width = max(1, -(-total // _CELLS))
    low = F.coalesce(F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.withColumn("low", low).withColumn("high", F.col("low") + F.col("slots")).select(
        "source_no", "low", "high", "blocks",
        F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"),
    )
    number = F.col("id") if total < _LONGEST else F.col("id").cast("decimal(19,0)")
    factor = F.lit(step) if total < _LONGEST else F.lit(step).cast("decimal(19,0)")
    slots = spark.range(total).select(F.col("id").alias("slot"), (number * factor % F.lit(max(1, total))).cast("long").alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / width))
    drawn = slots.join(sized(cells, _CELLS + 2 * sources), "cell").filter("point >= low AND point < high")
    drawn = drawn.select("slot", "source_no", "blocks", F.floor(F.col("slot") / _SLOTS_IN_CHUNK).alias("chunk"))
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
    own = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    rank = F.col("carried") + F.col("own")
    return (
        drawn.withColumn("own", own).join(carried, ["source_no", "chunk"])
        .select("slot", "source_no", F.floor(rank / F.col("blocks")).alias("epoch"), (rank % F.col("blocks")).alias("block"))
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, part,
    slots, source, text_hash.

    The words of a source, its documents shuffled by a hash of the id, are one line cut into
    blocks of equal size; the schedule says how often each block is taken. ``taken`` counts
    the words of a document in taken blocks, repeats included: ``copies`` whole times and,
    where the last epoch ends within a document, its first ``part`` words. ``slots`` are the
    places in the mix of the block with its first word, at most two. A null text has
    size 0; documents of size 0 are never taken. A null source is a source of its own.
    Repeated rows are documents of their own; equal places go by id and text. Texts of any
    length are counted whole; an empty table gives an empty mix. Other columns are not read.
    """
    spark = docs.sparkSession
    sizes = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            text_hash(text_col).alias("text_hash"),
        ),
        "sizes",
    )
    aims = stored(targets(sizes).coalesce(1), "targets")
    takes = schedule(aims, block_words).groupBy("source_no", "block").agg(
        F.count("*").alias("times"), F.sort_array(F.collect_list("slot")).alias("slots")
    )

    sources = aims.count()
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(_SEED))
    lines = sizes.join(sized(aims, sources), sizes["source"].eqNullSafe(aims["source"])).select(
        "doc_id", sizes["source"], "size", "text_hash", "source_no", "source_size", "target", place.alias("place"),
        F.shiftrightunsigned(place, 54).alias("bucket"),
    )
    lines = stored(lines, "lines")
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        lines.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
        .select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carried"))
    )
    within = Window.partitionBy("source_no", "bucket").orderBy("place", "doc_id", "text_hash", "size")
    before = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        lines.withColumn("before", before).withColumn("row_no", F.row_number().over(within))
        .join(carried, ["source_no", "bucket"]).withColumn("start", F.col("carried") + F.col("before"))
    )
    end = F.col("start") + F.col("size")
    spans = placed.withColumn(
        "block",
        F.explode_outer(F.when(F.col("size") > 0, F.sequence(
            F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)
        ))),
    )
    words = F.least(end, (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    times = F.coalesce("times", F.lit(0))
    row = ["source_no", "bucket", "row_no", "doc_id", "source", "size", "source_size", "target", "text_hash"]
    return (
        spans.join(takes, ["source_no", "block"], "left")
        .groupBy(*row)
        .agg(
            F.coalesce(F.sum(words * times), F.lit(0)).cast("long").alias("taken"),
            F.min(F.when(F.col("block").isNotNull(), times).otherwise(0)).cast("long").alias("copies"),
            F.coalesce(F.min(F.when(F.col("times") > 0, F.struct("block", "slots")))["slots"], F.array().cast("array<bigint>")).alias("slots"),
        )
        .select(
            "doc_id", "size", "source_size", "target", "taken", "copies",
            (F.col("taken") - F.col("copies") * F.col("size")).alias("part"), "slots", "source", "text_hash",
        )
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them, with all their columns, in the order of the mix.

    A row per copy, at the slot of the block with its first word; no document is cut. The one
    document of a source within which its last epoch ends counts as a whole copy if at least half
    of it is taken, so a source's words differ from those of ``mix`` by half a document at most.
    """
    copies = F.col("copies") + (F.col("part") * 2 >= F.col("size")).cast("int")
    taken = mix(docs, id_col, text_col, source_col).filter("taken > 0").select(
        F.struct(F.col("doc_id").alias("id"), "source", F.col("text_hash").alias("hash")).alias("key"),
        F.struct((-F.col("taken")).alias("less"), F.slice("slots", 1, copies.cast("int")).alias("slots")).alias("choice"),
    )
    # Written by itself, so that the shuffles of the mix are gone before texts are shuffled.
    choices = stored(taken.groupBy("key").agg(F.sort_array(F.collect_list("choice")).alias("choices")), "choices")
    # One key of whole values and of one type on both sides, down to which fields may be null, so that
    # the window, the join and the choices lie by the same column and texts are shuffled once before
    # they are put in order. The choices lie small in their file and are much larger in memory: they
    # are merged, not broadcast.
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_hash(text_col).alias("hash"))
    rows = docs.select(F.struct("*").alias("doc"), key.cast(choices.schema["key"].dataType).alias("key"))
    # Rows alike in id, source and text are told apart by a number.
    rows = rows.withColumn("a_no", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    placed = rows.join(choices.hint("merge"), "key").select("doc", F.explode(F.get("choices", F.col("a_no") - 1)["slots"]).alias("slot"))
    return placed.orderBy("slot").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
