"""Embedding near-dedup by tiles of vectors in PCA order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seatpool.functions.ordered import numbered
from seatpool.llm.common import components
from seatpool.session import stored

COSINE = 0.9
TILE = 2048
#: Dimensions accumulated between two looks at the bound.
STEP = 16
_SLACK = 1e-9  # rounding of the rotation; matches are decided on the vectors as given
_PAIRS = 1 << 16


def _directions(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Principal directions of the unit vectors, as columns, strongest first.

    Each task sums products into one matrix; its elements are added up over the tasks by
    Spark, and dimensions squared numbers come to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), dimensions))
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions**2), pa.int32()), pa.array(total.ravel())], ["at", "value"])

    sums = vectors.mapInArrow(work, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    matrix = np.zeros(dimensions**2)
    for row in sums:
        matrix[row["at"]] = row["value"]
    _, columns = np.linalg.eigh(matrix.reshape(dimensions, dimensions))
    return np.ascontiguousarray(columns[:, ::-1])


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matches(a: np.ndarray, b: np.ndarray, directions: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two tiles whose cosine reaches ``cosine``; i < j if the tiles are the same.

    Products are summed over the leading principal dimensions first; what the others can add
    is at most the product of the norms of the two suffixes. It stops when no pair can reach
    the threshold, or few can; those left are decided by the full cosine in doubles.
    """
    left, right = _unit(a) @ directions, _unit(b) @ directions
    suffix = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0.0))
    norms_left, norms_right = suffix(left), suffix(right)
    size, total = left.shape[1], np.zeros((len(a), len(b)))
    few = max(64, total.size >> 8)
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    i = j = np.empty(0, dtype=np.int64)
    for start in range(0, size, STEP):
        stop = min(start + STEP, size)
        total += left[:, start:stop] @ right[:, start:stop].T
        rest = np.outer(norms_left[:, stop], norms_right[:, stop]) if stop < size else 0.0
        able = total + rest >= cosine - _SLACK
        if same:
            able &= np.tri(len(a), dtype=bool).T & ~np.eye(len(a), dtype=bool)
        left_over = int(np.count_nonzero(able))
        if left_over <= few or stop == size:
            i, j = np.nonzero(able)
            break
    hits = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), _PAIRS):
        x, y = i[at : at + _PAIRS], j[at : at + _PAIRS]
        hits[at : at + _PAIRS] = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= cosine
    return i[hits], j[hits]


def smallest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node connected to it by the pairs."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tile: int = TILE
) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Vectors of one length link if their cosine is at least ``cosine``; between lengths there
    are no links, and each length has directions and tiles of its own. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without id, link with nothing.
    Copies of one vector are compared once and counted by their number; copies link with each
    other. Rows that share an id are one node of the components. component_id is the smallest
    vec_id reachable, itself included; a row without id has none and is kept.
    """
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(id_col).isNotNull() & vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)
    # A vector whose squares all vanish, or overflow, has no direction in doubles.
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    usable = usable & (square > 0) & (square < F.lit(float("inf")))
    named = rows.select(F.col(id_col).alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), F.col(vector_col)).alias("v"))
    named = stored(named, "vectors")
    groups = stored(
        named.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors"
    )
    lengths = groups.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    found = rows.sparkSession.createDataFrame([], "rep long, links long, root long, d int")
    for d in [row["d"] for row in lengths if row["n"] > 1]:
        found = found.unionByName(_links(groups.filter(F.size("v") == d), d, cosine, tile).withColumn("d", F.lit(d)))
    counts = found.groupBy(F.col("rep").alias("of"), "d").agg(F.sum("links").alias("links"))
    roots = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = (groups["rep"] == counts["of"]) & (F.size(groups["v"]) == counts["d"])
    classes = groups.join(counts, linked, "left").join(roots, groups["rep"] == roots["node"], "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("root")
    )
    classes = stored(classes, "vector-classes")
    component = F.coalesce("root", "vec_id")
    return named.join(classes, "v", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _links(groups: DataFrame, dimensions: int, cosine: float, tile: int) -> DataFrame:
    """(rep, links, root): per pair of tiles, how many other rows each vector links to there,
    and the smallest vector it is connected to within the pair. Written once.

    Vectors are put in order of their leading principal coordinate and cut into tiles. Unit
    vectors with the cosine lie within sqrt(2 - 2 cosine) of each other, in each coordinate
    too; pairs of tiles further apart than that are never made. Each pair is one task's work
    of bounded size.
    """
    directions = _directions(groups, dimensions)
    lead = directions[:, 0].tolist()
    weights = F.array(*[F.lit(x) for x in lead])
    doubles = F.col("v").cast("array<double>")
    dot = F.aggregate(F.zip_with(doubles, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    placed, count = numbered(groups.select("rep", "copies", "v", (dot / norm).alias("lead")), ["lead", "rep"])
    tiled = stored(placed.withColumn("tile", F.floor(F.col("position") / tile).cast("int")).drop("position"), "tiled")
    tiles = max(1, -(-count // tile))
    reach = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    ranges = stored(tiled.groupBy("tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high")), "tile-ranges")
    pairs = ranges.select(F.col("tile").alias("a"), F.col("high").alias("a_high"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("b"))
    pairs = pairs.join(ranges.select(F.col("tile").alias("b"), "low"), "b").filter(F.col("low") - F.col("a_high") <= reach).select("a", "b")
    pairs = stored(pairs, "tile-pairs")
    sides = pairs.select("a", "b", F.col("a").alias("tile"), F.lit(0).alias("side")).unionByName(
        pairs.filter("a <> b").select("a", "b", F.col("b").alias("tile"), F.lit(1).alias("side"))
    )
    spread = tiled.select("tile", "rep", "copies", "v").join(sides, "tile").select("a", "b", "side", "rep", "copies", "v")

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        matrix = _matrix(table["v"].combine_chunks(), dimensions)
        reps, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        order = np.lexsort((reps, side))
        side, matrix, reps, copies = side[order], matrix[order], reps[order], copies[order]
        first = int(np.count_nonzero(side == 0))
        same = key[0].as_py() == key[1].as_py()
        if same:
            i, j = matches(matrix, matrix, directions, cosine, True)
        else:
            i, j = matches(matrix[:first], matrix[first:], directions, cosine, False)
            j = j + first
        links = np.bincount(i, weights=copies[j], minlength=len(reps)) + np.bincount(j, weights=copies[i], minlength=len(reps))
        # Nodes by rank of their id, so that the smallest node is the smallest id.
        by_id = np.argsort(reps, kind="stable")
        rank = np.empty(len(reps), dtype=np.int64)
        rank[by_id] = np.arange(len(reps))
        root = reps[by_id][smallest(rank[i], rank[j], len(reps))[rank]]
        has = links > 0
        return pa.table({"rep": pa.array(reps[has], pa.int64()), "links": pa.array(links[has].astype(np.int64)), "root": pa.array(root[has], pa.int64())})

    return stored(spread.groupBy("a", "b").applyInArrow(work, "rep long, links long, root long"), "tile-links")
