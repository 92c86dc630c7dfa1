"""Exact dedup by content sort."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from seatpool.llm.common import SPACE, tasks
from seatpool.session import stored

#: Characters of the text by which ranges are cut; the digest decides beyond them, so that
#: sampled splitters stay small however long the texts are.
HEAD = 16

_space = re.compile(SPACE)


def _normalised(text: str) -> str:
    return _space.sub(" ", text)


def _neighbours(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pass sorted rows on with the number of their run of equal texts, and add one row per
    run with its smallest id and size. Holds one text at a time beside the batch."""
    part = TaskContext.get().partitionId()
    run, size, keep, digest, text = -1, 0, None, None, None

    def summary(rows: list[tuple], last: bool) -> None:
        if run >= 0:
            rows.append((run, keep, size, _normalised(text) if run == 0 or last else None))

    def closed(rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        found = dict(zip(("run", "keep", "size", "edge_text"), map(list, zip(*rows)) if rows else [[]] * 4))
        found |= {"part": [part] * n, "lead": [None] * n, "sha": [None] * n, "text": [None] * n, "doc": [None] * n}
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    for batch in batches:
        ids, shas = batch.column("doc_id").to_pylist(), batch.column("sha").to_pylist()
        texts = batch.column("text")
        runs, leads, ended = [], [], []
        for i, sha in enumerate(shas):
            same = sha == digest and _normalised(texts[i].as_py() or "") == _normalised(text)
            if not same:
                summary(ended, False)
                run, size, keep, digest, text = run + 1, 0, ids[i], sha, texts[i].as_py() or ""
            size += 1
            runs.append(run)
            leads.append(not same)
        n = len(ids)
        lead = pa.array(leads, pa.bool_())
        found = {
            "part": pa.array([part] * n, pa.int32()), "run": pa.array(runs, pa.int64()),
            "lead": lead, "keep": pa.array(ids, schema.field("keep").type),
            "size": pa.nulls(n, pa.int64()), "sha": pa.array(shas, pa.string()),
            "edge_text": pa.nulls(n, pa.string()),
        }
        if "doc" in schema.names:
            # only the first row of a run is ever asked for its columns
            found |= {c: pc.if_else(lead, batch.column(c), pa.scalar(None, batch.column(c).type)) for c in ("text", "doc")}
        yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) for f in schema], schema=schema)
        yield closed(ended)
    if run >= 0:
        last: list[tuple] = []
        summary(last, True)
        yield closed(last)


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` in content order, with runs of equal texts; written once. The first row of
    a run has its text, and the columns ``carry``, if they are asked for.

    Ranges are cut by sampled splitters over (first characters, digest, id). The id in the
    splitters lets one large group of copies span many tasks.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.substring(norm, 1, HEAD).alias("head"),
        F.sha2(norm, 256).alias("sha"),
        *([F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry]).alias("doc")] if carry is not None else []),
    )
    order = ["head", "sha", F.col("doc_id").asc_nulls_last()]
    ordered = rows.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType
    result = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()),
        T.StructField("lead", T.BooleanType()), T.StructField("keep", kind),
        T.StructField("size", T.LongType()), T.StructField("sha", T.StringType()),
        T.StructField("edge_text", T.StringType()),
    ])
    if carry is not None:
        result = result.add("text", T.StringType()).add("doc", _nullable(rows.schema["doc"].dataType))

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(result)
        return _neighbours(batches, schema)

    return stored(ordered.drop("head").mapInArrow(work, result), "sorted-runs")


def _nullable(kind: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in kind])


def _spans(runs: DataFrame) -> DataFrame:
    """Runs at the borders of tasks, merged by comparing their whole texts: (part, run) with
    the id and size of the whole run and the task in which it begins. At most two rows a task."""
    edges = runs.filter(F.col("size").isNotNull() & F.col("edge_text").isNotNull())
    whole = edges.groupBy("edge_text").agg(
        F.min("keep").alias("whole_keep"), F.sum("size").alias("whole_size"), F.min("part").alias("first_part")
    )
    return edges.select("part", "run", "edge_text").join(whole, "edge_text").drop("edge_text")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each stretch of white space is one space. Null texts
    are empty texts. The smallest id stays; of repeated rows with that id one stays. Rows
    without id stay only where their whole group has none. An empty table gives no rows;
    other columns are not read.
    """
    runs = sorted_runs(docs, id_col, text_col)
    rows = runs.filter("size IS NULL").select("part", "run", F.col("keep").alias("doc_id"), "lead", "sha")
    groups = runs.filter("size IS NOT NULL").select("part", "run", "keep", "size")
    joined = rows.join(groups, ["part", "run"]).join(F.broadcast(_spans(runs)), ["part", "run"], "left")
    return joined.select(
        "doc_id",
        F.coalesce("whole_keep", "keep").alias("keep_id"),
        F.coalesce("whole_size", "size").alias("group_size"),
        (F.col("lead") & F.coalesce(F.col("part") == F.col("first_part"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in ``exact_dedup``."""
    # The text is there once: for the comparison, and as the column it came from.
    runs = sorted_runs(docs, id_col, text_col, [c for c in docs.columns if c != text_col])
    leads = runs.filter("size IS NULL AND lead")
    kept = leads.join(F.broadcast(_spans(runs)), ["part", "run"], "left").filter(
        F.coalesce(F.col("part") == F.col("first_part"), F.lit(True))
    )
    column = lambda c: F.col("text") if c == text_col else F.col("doc").getField(c)
    return kept.select(*[column(c).alias(c) for c in docs.columns])
