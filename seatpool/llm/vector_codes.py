"""Vector code compression: product codebooks by Lloyd rounds over resident members.

Every vector is cut into parts, and a part belongs to one entry of the codebook of its
position. Parts lie with their owner, a task's share of rows by (position, entry, salt). A
round sums the members where they lie, and only the sums meet. The new codebook, some
thousand numbers, goes back out; owners assign their members anew, keep those that stay
without any shuffle, and only parts that change entry move to another owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seatpool.functions.ordered import sized
from seatpool.llm.common import tasks
from seatpool.session import discard, new_folder, stored, stored_in

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Every (position, entry) is dealt over so many owners at least, and over more where one
#: entry could hold more than OWNED parts for each of them.
SALTS = 16
OWNED = 250_000
_LARGEST = 2**63 - 1
_CHUNK = 8192

#: (vector length, position) to the entries of its codebook, one per row
Books = dict[tuple[int, int], np.ndarray]

_MEMBERS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("position", T.IntegerType()),
    T.StructField("entry", T.IntegerType()), T.StructField("salt", T.IntegerType()), T.StructField("part", T.ArrayType(T.LongType())),
])


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers; beyond them, the nearest one."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * SCALE)
    return np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower index, and its squared distance.

    Doubles are exact while all terms stay below 2**52; other rows go by Python's integers.
    """
    entries, errors = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
    # As doubles: their own rounding does not matter this far below the limit.
    reach = np.maximum(np.abs(parts.astype(np.float64)).max(axis=1, initial=0), np.abs(book.astype(np.float64)).max(initial=0))
    exact = 4 * parts.shape[1] * reach * reach < 2.0**51
    b = book.astype(np.float64)
    for i in range(0, len(parts), _CHUNK):
        rows = np.flatnonzero(exact[i : i + _CHUNK]) + i
        p = parts[rows].astype(np.float64)
        far = (p * p).sum(axis=1)[:, None] - 2 * (p @ b.T) + (b * b).sum(axis=1)
        entries[rows] = far.argmin(axis=1)
        errors[rows] = far.min(axis=1, initial=np.inf).astype(np.int64) if len(rows) else 0
    wide = book.astype(object)
    for i in np.flatnonzero(~exact):
        far = ((wide - parts[i].astype(object)) ** 2).sum(axis=1).tolist()
        entries[i] = min(range(len(far)), key=far.__getitem__)
        errors[i] = min(far[entries[i]], _LARGEST)
    return entries, errors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _kept(rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """Usable vectors, each row with a number of its own; written once."""
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & fine
    kept = rows.filter(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
        vector.alias("v"), F.size(vector).alias("size"),
    )
    return stored(kept, "vectors-to-code")


def _first_books(kept: DataFrame, parts: int, entries: int) -> Books:
    """The parts of the vectors with the smallest ids; a codebook's size of vectors per length."""
    order = Window.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= entries)
    vectors: dict[int, list] = {}
    for row in first.select("size", "place", "v").orderBy("size", "place").collect():
        vectors.setdefault(row["size"], []).append(row["v"])
    books = {}
    for size, found in vectors.items():
        ints = whole(np.array(found, dtype=np.float64))
        for position, book in enumerate(np.split(ints, parts, axis=1)):
            books[size, position] = np.ascontiguousarray(book)
    return books


def _dealt(kept: DataFrame, books: Books, parts: int, salts: int) -> DataFrame:
    """Every part with the entry nearest to it, not yet moved to its owner."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                rows = batch.column("row").to_numpy()[own]
                ints = whole(_matrix(batch.column("v").take(pa.array(own)), size))
                width = size // parts
                for position in range(parts):
                    part = np.ascontiguousarray(ints[:, position * width : (position + 1) * width])
                    entry, _ = nearest(part, books[size, position])
                    yield _members(rows, size, position, entry, (rows % salts), part)

    return kept.select("row", "size", "v").mapInArrow(work, _MEMBERS)


def _members(rows, size, position, entry, salt, part) -> pa.RecordBatch:
    n, width = part.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    columns = [
        pa.array(rows), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, position, np.int32)),
        pa.array(entry), pa.array(salt.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(part.ravel())),
    ]
    return pa.RecordBatch.from_arrays(columns, _MEMBERS.names)


def _to_owners(parts: DataFrame) -> DataFrame:
    return parts.repartition(tasks(parts.sparkSession), "size", "position", "entry", "salt")


def _per_book(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by vector length and position, with their parts as a matrix."""
    sizes, positions = batch.column("size").to_numpy(), batch.column("position").to_numpy()
    for size, position in sorted(set(zip(sizes.tolist(), positions.tolist()))):
        own = batch.take(pa.array(np.flatnonzero((sizes == size) & (positions == position))))
        yield size, position, own, _matrix(own.column("part"), len(own.column("part").flatten()) // own.num_rows)


def _updated(members: DataFrame, books: Books) -> Books:
    """Each entry becomes the floored mean of its members. A task adds up those it holds, in
    two halves of 32 bits, so that no sum overflows; Spark adds up the tasks' sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for size, position, own, parts in _per_book(batch):
                entries = own.column("entry").to_numpy()
                order = np.argsort(entries, kind="stable")
                found, starts, counts = np.unique(entries[order], return_index=True, return_counts=True)
                high = np.add.reduceat(parts[order] >> 32, starts, axis=0)
                low = np.add.reduceat(parts[order] & 0xFFFFFFFF, starts, axis=0)
                for entry, h, l, n in zip(found.tolist(), high, low, counts.tolist()):
                    held = sums.setdefault((size, position, entry), [0, 0, 0])
                    held[0], held[1], held[2] = held[0] + h, held[1] + l, held[2] + n
        rows = [(*key, at, int(h), int(l), n) for key, (high, low, n) in sums.items() for at, (h, l) in enumerate(zip(high, low))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] * 4 + [pa.int64()] * 3)],
                                             ["size", "position", "entry", "at", "high", "low", "n"])

    partial = members.mapInArrow(work, "size int, position int, entry int, at int, high long, low long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = partial.groupBy("size", "position", "entry", "at").agg(wide("high"), wide("low"), F.sum("n").alias("n"))
    new = {key: book.copy() for key, book in books.items()}
    # As many rows as the codebooks have components.
    for r in sums.collect():
        new[r["size"], r["position"]][r["entry"], r["at"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["n"]
    return new


def _moved(members: DataFrame, books: Books, folder: str, step: int) -> DataFrame:
    """Members after a new assignment: those that stay are written where they are, those that
    change entry are shuffled to their new owners."""
    schema = T.StructType([*_MEMBERS.fields, T.StructField("moved", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, position, own, parts in _per_book(batch):
                entry, _ = nearest(parts, books[size, position])
                moved = pa.array(entry != own.column("entry").to_numpy())
                at = own.schema.get_field_index("entry")
                yield own.set_column(at, "entry", pa.array(entry)).append_column("moved", moved)

    spark = members.sparkSession
    members.mapInArrow(work, schema).write.partitionBy("moved").parquet(f"{folder}/assigned-{step}")
    assigned = spark.read.schema(schema).parquet(f"{folder}/assigned-{step}")
    movers = stored_in(_to_owners(assigned.filter("moved").drop("moved")), f"{folder}/movers-{step}")
    return assigned.filter("NOT moved").drop("moved").unionByName(movers)


def _coded(members: DataFrame, books: Books) -> DataFrame:
    """(row, position, entry, error) by the final codebooks."""
    schema = "row long, position int, entry int, error long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, position, own, parts in _per_book(batch):
                entry, error = nearest(parts, books[size, position])
                yield pa.RecordBatch.from_arrays(
                    [own.column("row"), own.column("position"), pa.array(entry), pa.array(error)], ["row", "position", "entry", "error"]
                )

    return members.mapInArrow(work, schema)


def _digest(books: Books, size: int, parts: int) -> str:
    numbers = (str(x) for position in range(parts) for entry in books[size, position].tolist() for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Usable are vectors that are not null or empty, hold no null or non-finite component, and
    can be cut into ``parts`` equal parts; others give no row. Vectors of another length have
    codebooks of their own. Codebooks start with the vectors of the smallest ids, missing ids
    last, repeated ids in the order of their vectors; fewer vectors than ``entries`` give
    smaller codebooks. Repeated rows are repeated in the result. Scaled components beyond
    64-bit integers count as the nearest of them, and so do errors. ``label_error`` sums the
    errors of equal labels, missing ones together. An empty table gives no rows; other
    columns are not read.
    """
    spark = rows.sparkSession
    work = new_folder(spark, "vector-codes")
    kept = _kept(rows, id_col, vector_col, label_col, parts)
    salts = max(SALTS, -(-kept.count() // OWNED))
    books = _first_books(kept, parts, entries)
    members = stored_in(_to_owners(_dealt(kept, books, parts, salts)), f"{work}/members-0")
    for step in range(rounds):
        books = _updated(members, books)
        if step + 1 < rounds:
            members = _moved(members, books, work, step + 1)
            for old in ("members-0",) if not step else (f"assigned-{step}", f"movers-{step}"):
                discard(spark, f"{work}/{old}")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: F.lpad(F.lower(F.hex(x["entry"])), 2, "0"))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_LARGEST)).cast("long")
    codes = _coded(members, books).groupBy("row").agg(F.array_join(digits, "").alias("code"), total.alias("error"))
    coded = stored(kept.select("row", "size", "vec_id", "label").join(codes, "row"), "vector-codes")
    discard(spark, work)
    sums = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_LARGEST)).cast("long")
    labels = stored(coded.groupBy(F.col("label").alias("of")).agg(sums.alias("label_error")), "label-errors")
    named = F.lit(None).cast("string")
    for size in sorted({size for size, _ in books}):
        named = F.when(F.col("size") == size, F.lit(_digest(books, size, parts))).otherwise(named)
    return coded.join(sized(labels, labels.count()), F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", named.alias("codebooks_sha256")
    )
