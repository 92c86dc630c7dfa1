"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from seatpool.llm.common import components, text_hash, without
from seatpool.session import stored

SHINGLE = 4
MAX_BITS = 4
_SEED = 42
_CHUNK = 65_536

_digest = partial(xxhash.xxh64_digest, seed=_SEED)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes.

    Bytes are lower-cased and split as ASCII, which is what the word pattern asks for.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    sums = np.zeros(64, dtype=np.int64)
    for start in range(0, count, _CHUNK):
        part = words[start : start + _CHUNK + shingle - 1]
        if len(words) < shingle:
            joined = [b" ".join(words)]
        else:
            joined = map(b" ".join, zip(*[part[i:] for i in range(shingle)]))
        digests = np.frombuffer(b"".join(map(_digest, joined)), dtype=np.uint8)
        sums += np.unpackbits(digests).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp), fp the fingerprint as a signed long; written once."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), fps], ["doc_id", "text_hash", "fp"]
            )

    schema = T.StructType([rows.schema["doc_id"], rows.schema["text_hash"], T.StructField("fp", T.LongType())])
    return stored(rows.mapInArrow(work, schema), "fingerprints")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of distinct fingerprints ``fp`` that differ in at most 4 bits, each once.

    The halves of the fingerprint are the segments. Two fingerprints within 4 bits differ in
    at most 2 bits of the first half or at most 1 of the second. Balls of radius 1 around
    both first halves meet if these differ in up to 2 bits; a ball of radius 1 around one
    second half meets the other itself. Every match is verified over all 64 bits inside the
    join, and taken at one of the keys by which the pair meets. Both sides hold many rows per
    fingerprint, which Spark does not count when it sizes them, so they are never broadcast.
    """
    first = F.shiftrightunsigned("fp", 32)
    second = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    ball = "transform(sequence(-1, 31), i -> if(i < 0, {0}, {0} ^ shiftleft(1L, i)))"
    halves = fps.select("fp", first.alias("h0"), second.alias("h1"))
    asking = halves.select(
        F.expr(f"explode(concat({ball.format('h0')}, transform({ball.format('h1')}, v -> v | shiftleft(1L, 32))))").alias("key"),
        F.col("fp").alias("x"),
    )
    asked = halves.select(
        F.expr(f"explode(array_append({ball.format('h0')}, h1 | shiftleft(1L, 32)))").alias("key"),
        F.col("fp").alias("y"),
    )
    differ = "bit_count(shiftrightunsigned(x ^ y, 32))"
    flip = "(shiftrightunsigned({0}, 32) ^ key)"
    by_first = (
        f"(key < 4294967296L AND CASE {differ} WHEN 0 THEN {flip.format('x')} = 0 "
        f"WHEN 1 THEN {flip.format('x')} = 0 "
        f"WHEN 2 THEN {flip.format('x')} <> 0 AND {flip.format('x')} < {flip.format('y')} ELSE false END)"
    )
    by_second = f"(key >= 4294967296L AND {differ} > 2)"
    return asking.join(asked.hint("merge"), "key").filter(
        F.expr(f"x < y AND bit_count(x ^ y) <= {MAX_BITS} AND ({by_first} OR {by_second})")
    ).select("x", "y")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, text_hash.

    Null and empty texts have fingerprint zero and link as any other. Equal fingerprints
    link; each is looked up once, however many rows share it. component_id is the smallest
    doc_id reachable by links. Rows without id are linked with nothing and have no
    component. Repeated rows are repeated in the result. Other columns are not read.
    """
    rows = fingerprints(docs, id_col, text_col, shingle)
    distinct = stored(
        rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints"
    )
    pairs = stored(links(distinct), "near-pairs")
    named = pairs.join(distinct.select(F.col("fp").alias("x"), F.col("rep").alias("a")), "x")
    named = named.join(distinct.select(F.col("fp").alias("y"), F.col("rep").alias("b")), "y")
    roots = components(named.select("a", "b"))
    classes = stored(
        distinct.join(roots, distinct["rep"] == roots["node"], "left").select(
            "fp", F.coalesce("root", "rep").alias("component_id")
        ),
        "classes",
    )
    return rows.join(classes.hint("merge"), "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        "text_hash",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows whose group holds a smaller id."""
    found = stored(near_duplicates(docs, id_col, text_col, shingle).filter("component_id < doc_id"), "near-copies")
    return without(docs, found, id_col, text_col)
