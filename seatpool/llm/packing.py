"""Best-fit packing by non-negative least squares over few-document length patterns."""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seatpool.llm.common import tasks
from seatpool.session import stored

SEQUENCE = 2048
END_ID = 0
#: Tokens that patterns may leave free, fitted one after another: what fills best goes first.
SLACK = (0, 8, 32, 128, 512)
#: Three-document patterns of one fit, about: counts per pattern must stay well above one.
LISTED = 16_384
#: Fits with one slack, each with other patterns where not all are listed.
PHASES = 4
#: A fit ends when this many rounds lower the residual by less than this share of it.
PATIENCE, TOLERANCE = 20, 1e-3
#: Words whose ids a task remembers, at most.
REMEMBERED = 100_000

# Below this code point the two libraries split texts alike (tests compare them); texts
# with others go through `tokenizers` itself.
_other = re.compile("[^\x00-ʯ]")
# Where a text cannot be cut at its spaces without changing how it is split.
_uneven = re.compile(r"\s | \s|^ | $")


class _Ids(dict):
    """Ids of a word with the space before it, as little-endian 32-bit numbers."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids as bytes, for the byte-level vocabulary at ``path``.

    Ids are those of ``tokenizers`` without special tokens. `tiktoken` with the same
    vocabulary gives the same ids several times faster, and each frequent word, with the space
    before it, is encoded once per task. The second function forgets those words.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = _Ids(fast.encode_ordinary)

    def encode(text: str) -> bytes:
        if not text.isascii() and _other.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _uneven.search(text):
            return np.array(fast.encode_ordinary(text), dtype="<u4").tobytes()
        first, *words = text.split(" ")
        return np.array(fast.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(map(known.__getitem__, words))

    return encode, known.clear


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; written once.

    A document longer than ``size`` is cut so that all pieces but the first are full.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    end = END_ID.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, forget = encoder(path)
        for batch in batches:
            found = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for row, text in enumerate(batch.column("text")):
                ids = memoryview(encode(text.as_py() or "") + end)
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    stop = start + ((total - start) % size or size)
                    for name, value in zip(found, (row, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        found[name].append(value)
                    start, piece = stop, piece + 1
            ids = batch.column("doc_id").take(pa.array(found.pop("row"), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(found["piece"], pa.int32()), *[pa.array(found[c], pa.int64()) for c in ("start", "length", "ids_crc32")]],
                schema.names,
            )
        forget()

    return stored(rows.mapInArrow(work, schema), "pieces")


# The plan works on the histogram alone: at most ``size`` lengths, whatever the corpus.


def patterns(present: np.ndarray, size: int, slack: int = 0, phase: int = 0, listed: int = LISTED) -> np.ndarray:
    """Patterns of one to three of the present lengths that leave at most ``slack`` of a
    sequence free, as rows padded with 0. The last length is the longest that fits.

    If there are more than ``listed`` pairs of first lengths, every so many of them are listed,
    beginning at ``phase``; all phases together list them all.
    """
    present = np.sort(present)
    single = present[:, None]

    def filled(rows: np.ndarray) -> np.ndarray:
        room = size - rows.sum(axis=1)
        at = np.searchsorted(present, room, side="right") - 1
        last = np.where(at >= 0, present[np.maximum(at, 0)], 0)
        fits = (last >= rows[:, -1]) & (room - last <= slack)
        return np.pad(np.column_stack([rows, last])[fits], ((0, 0), (0, 2 - rows.shape[1])))

    found = [np.pad(single[present >= size - slack], ((0, 0), (0, 2))), filled(single)]
    ends = np.searchsorted(present, (size - present) // 2, side="right")
    many = np.maximum(ends - np.arange(len(present)), 0)
    step = max(1, -(-int(many.sum()) // listed))
    for i, count in enumerate(many):
        second = present[i + (i + phase) % step : i + count : step]
        if len(second):
            found.append(filled(np.column_stack([np.full(len(second), present[i]), second])))
    return np.concatenate(found)


def least_squares(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the patterns that fit the histogram: |A x - counts| least, by
    multiplicative updates, which stay non-negative and need no step size. They go on until the
    residual of those lengths that patterns hold falls no more."""
    used = rows > 0

    def spread(values: np.ndarray) -> np.ndarray:  # A' v
        return (values[rows] * used).sum(axis=1)

    def fill(x: np.ndarray) -> np.ndarray:  # A x
        return np.bincount(rows[used], weights=np.broadcast_to(x[:, None], rows.shape)[used], minlength=len(counts))

    held = np.zeros(len(counts), dtype=bool)
    held[rows[used]] = True
    aim = spread(counts.astype(float))
    x = aim / np.maximum(spread(fill(np.ones(len(rows)))), 1e-12)
    best = np.inf
    while len(rows):
        for _ in range(PATIENCE):
            x *= aim / np.maximum(spread(fill(x)), 1e-12)
        residual = float(np.square((fill(x) - counts)[held]).sum())
        if residual < 0.25 * held.sum() or residual > best * (1 - TOLERANCE):
            break
        best = residual
    return x


@dataclass
class Plan:
    """Places by length: the ``n``-th piece of a length finds its interval by bisection."""

    key: np.ndarray  # length and first number of the interval in one integer
    base: np.ndarray  # sequence of the first piece of the interval
    offset: np.ndarray
    sequences: int


_RANKS = 1 << 48


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Repeat counts of patterns for all pieces of the histogram.

    Patterns that fill a sequence are fitted first, then such as leave a little free, to what is
    left. Fitted counts are rounded to whole numbers, the best fitted first, as far as pieces are
    left; a fit is repeated with other patterns while it places something. What is over is packed
    best-fit: the longest piece left, then again and again the longest that fits, as often as the
    pattern can be repeated.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    chosen: list[tuple[list[tuple[int, int]], int]] = []
    for slack in SLACK:
        for phase in range(PHASES):
            rows = patterns(np.flatnonzero(left), size, min(slack, size // 4), phase)
            fitted = least_squares(rows, left)
            placed = 0
            for i in np.argsort(-fitted, kind="stable"):
                often = int(round(fitted[i]))
                if often < 1:
                    break
                lengths, uses = np.unique(rows[i][rows[i] > 0], return_counts=True)
                often = min(often, int((left[lengths] // uses).min()))
                if often:
                    left[lengths] -= often * uses
                    placed += often
                    chosen.append((list(zip(lengths.tolist(), uses.tolist())), often))
            if not placed:
                break
    remaining = [int(v) for v in np.flatnonzero(left)]
    while remaining:
        room, pattern, at = size, [], len(remaining)
        while room and (at := bisect.bisect_right(remaining, room, 0, at)):
            length = remaining[at - 1]
            uses = min(int(left[length]), room // length)
            pattern.append((length, uses))
            room -= uses * length
            at -= 1
        often = min(int(left[length]) // uses for length, uses in pattern)
        for length, uses in pattern:
            left[length] -= often * uses
        chosen.append((pattern, often))
        remaining = [v for v in remaining if left[v]]
    return _places(chosen)


def _places(chosen: list[tuple[list[tuple[int, int]], int]]) -> Plan:
    length_at, offset_at, base_at, often_at = [], [], [], []
    base = 0
    for pattern, often in chosen:
        offset = 0
        for length, uses in pattern:
            for _ in range(uses):
                length_at.append(length)
                offset_at.append(offset)
                base_at.append(base)
                often_at.append(often)
                offset += length
        base += often
    lengths, often = np.array(length_at, dtype=np.int64), np.array(often_at, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    lengths, often = lengths[order], often[order]
    upto = np.cumsum(often) - often
    first = np.searchsorted(lengths, lengths)  # index of the first interval of each length
    start = upto - (upto[first] if len(upto) else upto)
    return Plan(
        lengths * _RANKS + start, np.array(base_at, dtype=np.int64)[order], np.array(offset_at, dtype=np.int64)[order], base
    )


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty, and an empty text is the end id alone. Rows without id and repeated
    rows are packed as any other. No rows give no sequences. Other columns are not read.

    Pieces of a length are numbered per salt and the counts of earlier salts added, so that a
    length which a third of all pieces have is no task of its own. Only the histogram, of at
    most ``size`` lengths, comes to the driver; the plan that goes back is bounded by it too.
    """
    found = pieces(docs, path, id_col, text_col, size)
    histogram = {row["length"]: row["count"] for row in found.groupBy("length").count().collect()}
    places = plan(histogram, size)

    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(tasks(docs.sparkSession)))
    salted = found.withColumn("salt", salt)
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        salted.groupBy("length", "salt").count()
        .select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("carried"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(within) - 1).join(carried, ["length", "salt"])
    ranked = ranked.select(*found.columns, (F.col("carried") + F.col("own")).alias("rank"))
    names = found.columns
    schema = T.StructType([*found.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("length").to_numpy() * _RANKS + batch.column("rank").to_numpy()
            at = np.searchsorted(places.key, wanted, side="right") - 1
            sequence = places.base[at] + (wanted - places.key[at])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(places.offset[at])], schema.names
            )

    return ranked.mapInArrow(work, schema)
