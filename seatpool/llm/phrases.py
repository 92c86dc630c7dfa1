"""Phrase collocation mining: suffixes routed by their leading words, counted by multikey quicksort.

Words become numbers, texts become arrays of numbers, and every place in them is a pointer
to a suffix of at most DEPTH words. Suffixes are routed to buckets by their leading word, so
that all suffixes that share it meet in one bucket. There a three-way quicksort on one word
after another splits the pointers into smaller, equal and larger ones; the size of an equal
partition is the count of its phrase, and a partition below the least count is abandoned.
A leading word with more than HOT suffixes routes by two words, and so on up to DEPTH.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from seatpool.functions.ordered import sized
from seatpool.llm.common import tasks
from seatpool.session import discard, new_folder, stored_in

DEPTH = 5
LEAST = 100
TOP = 2000
#: Frequent words that are known to every task by a short number. Where there are more, the
#: others go by a hash, and the few that share one get a number too: counts stay exact.
KNOWN = 200_000
#: Suffixes that share their leading words and are sorted in one task's memory, at most: above it
#: they route by one word more. Below it they do so if they are more than WIDE of all words, in
#: tables of any size, so that no task has more than one part in 200.
HOT = 1_000_000
WIDE = 0.005
#: In very large tables phrases are hot above this share of all words instead, so that no more
#: than 1 / HOT_SHARE of a length are known to the driver.
HOT_SHARE = 1e-6
#: So many routed suffixes a bucket, about; a bucket is sorted in one task's memory.
BUCKET = 500_000
#: Pointers sorted at a time before the shuffle, and words in one stored row, about.
CHUNK = 150_000
#: Distinct words a task counts before it hands them on.
COUNTED = 100_000
#: Distinct phrases of a language that a task adds up before it hands them on.
HELD = 300_000
UND = "und"
_HASHED = 1 << 62

# Ends of pieces, A-Z in lower case, in UTF-8: none of these bytes is part of another character.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"."
_TABLE = bytes(_END[0] if c in _ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text in order, with b"." at the end of each piece."""
    return text.translate(_TABLE).replace(_END, b" . ").split()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(lang_col), F.lit(UND)).alias("lang"), text.alias("text")).filter(F.length("text") > 0)


def words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts, combined before the shuffle."""

    def row(lang: str, counted: Counter) -> pa.RecordBatch:
        counted.pop(_END, None)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.binary()).cast(pa.string()),
             pa.array(list(counted.values()), pa.int64())],
            ["lang", "word", "n"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = found.setdefault(lang, Counter())
                own.update(tokens(text.as_py()))
                if len(own) >= COUNTED:
                    yield row(lang, found.pop(lang))
            for lang, own in found.items():
                yield row(lang, own)

    return texts.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(_HASHED - 1)).bitwiseOR(F.lit(_HASHED))


def _python_hashed(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) & (_HASHED - 1) | _HASHED


def _known(counted: DataFrame, least: int, known: int) -> tuple[DataFrame, dict[str, dict[bytes, int]], bool]:
    """Words with their numbers (lang, word, n, id), the numbers that tasks must be given, and
    whether words without one are all below the least count. At most ``known`` words come to
    the driver, and those of the rest that share a hash within a language: of a billion words,
    less than one pair."""
    frequent = counted.filter(F.col("n") >= least)
    complete = frequent.count() <= known
    top = frequent.orderBy(F.desc("n"), "lang", "word").limit(known).select("lang", "word").collect()
    numbers: dict[str, dict[bytes, int]] = {}
    for at, row in enumerate(top):
        numbers.setdefault(row["lang"], {})[row["word"].encode()] = at + 1
    spark = counted.sparkSession
    rows = [(lang, word.decode(), at) for lang, own in numbers.items() for word, at in own.items()]
    if complete:
        # at most ``known`` rows
        listed = F.broadcast(spark.createDataFrame(rows, "lang string, word string, id long"))
        return frequent.join(listed, ["lang", "word"]), numbers, True
    listed = F.broadcast(spark.createDataFrame(rows, "lang string, word string, id long"))
    rest = counted.join(listed, ["lang", "word"], "left_anti").withColumn("id", _hashed(F.col("word")))
    shared = rest.groupBy("lang", "id").agg(F.count("*").alias("words")).filter("words > 1").select("lang", "id")
    clash = rest.join(shared, ["lang", "id"], "left_semi").select("lang", "word").orderBy("lang", "word").collect()
    for at, row in enumerate(clash):
        number = known + 1 + at
        numbers.setdefault(row["lang"], {})[row["word"].encode()] = number
        rows.append((row["lang"], row["word"], number))
    listed = F.broadcast(spark.createDataFrame(rows, "lang string, word string, id long"))
    named = counted.join(listed, ["lang", "word"], "left")
    return named.withColumn("id", F.coalesce("id", _hashed(F.col("word")))), numbers, False


def _coded(words: list[bytes], known: dict[bytes, int], complete: bool) -> np.ndarray:
    """Numbers of words and ends; a word without one ends a piece too, or goes by its hash."""
    get = known.get
    if complete:
        ids = [get(w, 0) for w in words]
    else:
        ids = [0 if w == _END else n if (n := get(w)) else _python_hashed(w) for w in words]
    found = np.array(ids, np.int64)
    # one end between pieces is enough
    return found[(found != 0) | (np.concatenate([found[1:], [1]]) != 0)]


def _packed(numbers: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes a number, how many there are, and all of them compressed."""
    narrow = numbers.astype(np.int32) if numbers.max(initial=0) < 2**31 else np.ascontiguousarray(numbers)
    return narrow.itemsize, narrow.size, pa.compress(narrow.tobytes(), "zstd", asbytes=True)


def _unpacked(width: int, size: int, data: bytes) -> np.ndarray:
    raw = pa.decompress(data, size * width, "zstd")
    return np.frombuffer(raw, np.int32 if width == 4 else np.int64)


def _unpacked_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    for i in range(batch.num_rows):
        width, size, data = (batch.column(c)[i].as_py() for c in ("width", "size", "ids"))
        yield batch.column("lang")[i].as_py(), _unpacked(width, size, data).astype(np.int64)


def encoded(texts: DataFrame, numbers: dict[str, dict[bytes, int]], complete: bool, folder: str) -> DataFrame:
    """(lang, width, size, ids): the words of many texts as numbers, 0 at the end of each piece,
    compressed; written once."""
    shared = texts.sparkSession.sparkContext.broadcast(numbers)

    def row(lang: str, held: list[np.ndarray]) -> pa.RecordBatch:
        width, size, data = _packed(np.concatenate(held))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([width], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())],
            ["lang", "width", "size", "ids"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            sizes: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                ids = _coded([*tokens(text.as_py()), _END], known.get(lang, {}), complete)
                held.setdefault(lang, []).append(ids)
                sizes[lang] += len(ids)
                if sizes[lang] >= CHUNK:
                    yield row(lang, held.pop(lang))
                    sizes[lang] = 0
            for lang, arrays in held.items():
                yield row(lang, arrays)

    found = stored_in(texts.mapInArrow(work, "lang string, width int, size long, ids binary"), folder)
    shared.destroy()
    return found


def suffixes(ids: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """The suffixes of at least two words at every place, cut after ``depth`` words and at the
    ends of pieces, as rows padded with 0; a chunk of places at a time."""
    for start in range(0, len(ids), CHUNK):
        part = ids[start : start + CHUNK + depth - 1]
        places = min(CHUNK, len(ids) - start)
        padded = np.concatenate([part, np.zeros(depth, np.int64)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[:places]
        rows = rows[(rows[:, 0] != 0) & (rows[:, 1] != 0)]
        alive = np.logical_and.accumulate(rows != 0, axis=1)
        yield np.where(alive, rows, 0)


def _packed_words(rows: np.ndarray) -> np.ndarray:
    """The words of each row, three to a number where all are small; sorts like the rows."""
    if rows.max(initial=0) >= 1 << 21:
        return rows
    return np.stack([
        sum(rows[:, i] << 21 * (min(3, rows.shape[1] - k) - 1 - i + k) for i in range(k, min(k + 3, rows.shape[1])))
        for k in range(0, rows.shape[1], 3)
    ], axis=1)


def _distinct(rows: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each occurs; ``n`` times for each if given."""
    if not len(rows):
        return rows, np.empty(0, np.int64)
    keys = _packed_words(rows)
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(rows))) if n is None else np.add.reduceat(n[order], starts)
    return rows[order[starts]], sizes


def routing_depth(rows: np.ndarray, hot: list[pd.DataFrame]) -> np.ndarray:
    """How many leading words route each suffix: one more than its longest hot beginning."""
    depth = np.ones(len(rows), np.int64)
    at = np.arange(len(rows))
    for k, phrases in enumerate(hot, 1):
        if not len(phrases) or not len(at):
            break
        own = pd.DataFrame(rows[at, :k], columns=[f"w{i}" for i in range(k)])
        at = at[own.merge(phrases, how="left", on=list(own.columns), indicator=True)["_merge"].to_numpy() == "both"]
        depth[at] = k + 1
    return depth


def _hot(rows: DataFrame, words_n: DataFrame, depth: int, hot: int) -> tuple[dict[str, list[pd.DataFrame]], list]:
    """Per language and length the phrases with more than ``hot`` suffixes, as tables and as rows
    (lang, ids, n). One pass over the words for each length at which there are any; at most
    1 / HOT_SHARE rows of a length come to the driver."""
    tables: dict[str, list[pd.DataFrame]] = {}
    counted: list = []
    level = words_n.filter(F.col("n") > hot).select("lang", F.array("id").alias("ids"), "n").collect()
    for k in range(1, depth):
        for lang, own in _grouped(level).items():
            table = pd.DataFrame(np.array(own, np.int64).reshape(-1, k), columns=[f"w{i}" for i in range(k)])
            tables.setdefault(lang, []).append(table)
        counted += level
        longer = {lang: own for lang, own in tables.items() if len(own) == k}
        if not longer or k + 1 == depth:
            break
        level = _longer(rows, longer, k + 1, depth).filter(F.col("n") > hot).collect()
    return tables, counted


def _grouped(rows: list) -> dict[str, list]:
    found: dict[str, list] = {}
    for row in rows:
        found.setdefault(row["lang"], []).append(row["ids"])
    return found


def _longer(rows: DataFrame, hot: dict[str, list[pd.DataFrame]], k: int, depth: int) -> DataFrame:
    """(lang, ids, n) of the phrases of ``k`` words whose first k - 1 words are hot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, ids in _unpacked_rows(batch):
                for found in suffixes(ids, depth) if lang in hot else ():
                    found = found[(routing_depth(found, hot[lang]) >= k) & (found[:, k - 1] != 0)]
                    own = _distinct(np.ascontiguousarray(found[:, :k]))
                    if lang in held:
                        own = _distinct(*map(np.concatenate, zip(held.pop(lang), own)))
                    if len(own[0]) >= HELD:
                        yield _counted(lang, *own)
                    else:
                        held[lang] = own
        for lang, own in held.items():
            yield _counted(lang, *own)

    return rows.mapInArrow(work, "lang string, ids array<long>, n long").groupBy("lang", "ids").agg(F.sum("n").alias("n"))


def _counted(lang: str, phrases: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    width = phrases.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(phrases) + 1, dtype=np.int32) * width), pa.array(phrases.ravel().astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), lists, pa.array(n.astype(np.int64))], ["lang", "ids", "n"])


def _mixed(rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A hash of the words that route each row."""
    found = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            step = (found ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            found = np.where(k < depth, step ^ (step >> np.uint64(29)), found)
    return found >> np.uint64(8)


def routed(rows: DataFrame, hot: dict[str, list[pd.DataFrame]], buckets: int, depth: int) -> DataFrame:
    """(lang, bucket, width, size, block): the distinct suffixes of each chunk by bucket, in order, with
    their numbers of occurrences; compressed, a column of words after the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids in _unpacked_rows(batch):
                for found in suffixes(ids, depth):
                    found, n = _distinct(found)
                    by = routing_depth(found, hot.get(lang, []))
                    # Suffixes that end before the words that route them only begin hot phrases,
                    # which are counted already.
                    whole = found[np.arange(len(found)), by - 1] != 0
                    bucket = (_mixed(found, by) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    order = order[whole[order]]
                    numbers, starts = np.unique(bucket[order], return_index=True)
                    columns = np.concatenate([found.T, [n], [by]])[:, order]
                    edges = [*starts.tolist(), len(order)]
                    blocks = [_packed(columns[:, i:j]) for i, j in zip(edges, edges[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(blocks), pa.string()), pa.array(numbers), pa.array([b[0] for b in blocks], pa.int32()),
                         pa.array([b[1] for b in blocks], pa.int64()), pa.array([b[2] for b in blocks], pa.binary())],
                        ["lang", "bucket", "width", "size", "block"],
                    )

    return rows.mapInArrow(work, "lang string, bucket long, width int, size long, block binary")


def multikey_counts(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, depth, count) of every equal partition that counts at least ``least``: all rows that
    agree with ``row`` in their first ``depth`` keys. 0 ends a row.

    Multikey three-way quicksort, all partitions a step at a time: the keys at a partition's
    depth are parted by a pivot into smaller, equal and larger ones. Equal ones go on with the
    next key; partitions that count too little are abandoned whole, as nothing in them can count
    more.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.arange(len(keys)) if len(keys) and weights.sum() >= least else np.empty(0, np.int64)
    sizes, depth = np.array([len(at)] if len(at) else [], np.int64), np.zeros(min(len(at), 1), np.int64)
    while len(at):
        starts = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(sizes)), sizes)
        own = keys[at, depth[part]]
        pivot = own[starts + sizes // 2]
        side = np.sign(own - pivot[part]) + 1
        new = part * 3 + side
        total = np.bincount(new, weights[at], 3 * len(sizes)).astype(np.int64)
        goes = total >= least
        goes[1::3] &= pivot != 0
        equal = np.flatnonzero(goes[1::3])
        if len(equal):
            first = np.full(3 * len(sizes), len(at))
            np.minimum.at(first, new, np.arange(len(at)))
            found.append((at[first[1::3][equal]], depth[equal] + 1, total[1::3][equal]))
            goes[1::3] &= depth + 1 < keys.shape[1]
        stay = goes[new]
        at, new = at[stay], new[stay]
        at = at[np.argsort(new, kind="stable")]
        counted = np.bincount(new, minlength=3 * len(sizes))
        sizes = counted[goes]
        depth = (np.repeat(depth, 3) + np.tile([0, 1, 0], len(depth)))[goes]
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _bucket_phrases(blocks: list[tuple[int, int, bytes]], depth: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Phrases of a bucket's suffixes and their counts, by length. The words that route a suffix
    are its first key, so that what it shares with others in other buckets is not counted here."""
    table = np.concatenate([_unpacked(*block).reshape(depth + 2, -1) for block in blocks], axis=1)
    rows, weights, by = np.ascontiguousarray(table[:depth].T), table[depth], table[depth + 1]
    by = by.astype(np.int64)
    keys = np.zeros_like(rows)
    for k in np.unique(by).tolist():
        own = np.flatnonzero(by == k)
        keys[own, 0] = rows[own, 0] if k == 1 else -(_numbered(rows[own, :k]) * (depth + 1) + k)
        keys[own, 1 : depth + 1 - k] = rows[own, k:]
    row, levels, n = multikey_counts(keys, weights, least)
    lengths = by[row] + levels - 1
    return [(rows[row[lengths == k], :k], n[lengths == k]) for k in range(2, depth + 1)]


def _numbered(rows: np.ndarray) -> np.ndarray:
    """A number from 1 for each distinct row."""
    order = np.lexsort(rows.T[::-1])
    first = np.concatenate([[True], (rows[order][1:] != rows[order][:-1]).any(axis=1)])
    numbers = np.empty(len(rows), np.int64)
    numbers[order] = np.cumsum(first)
    return numbers


def counted_phrases(blocks: DataFrame, depth: int, least: int) -> DataFrame:
    """(lang, ids, n) of the phrases of two words and more that route to a bucket or extend what
    does, if they occur ``least`` times. A bucket's blocks meet in one task."""

    def work(key, table):
        lang = key[0].as_py()
        own = list(zip(*(table.column(c).to_pylist() for c in ("width", "size", "block"))))
        found = _bucket_phrases(own, depth, least)
        return pa.Table.from_batches([_counted(lang, rows, n) for rows, n in found])

    return blocks.groupBy("lang", "bucket").applyInArrow(work, "lang string, ids array<long>, n long")


def phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
    depth: int = DEPTH, known: int = KNOWN, hot: int = HOT, bucket: int = BUCKET,
) -> DataFrame:
    """The collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and pieces
    into words at spaces and tabs. A candidate has 2 to ``depth`` words and occurs a >= ``least``
    times; n is the number of words of its language. Its score is the lowest floor(1000 a n /
    (l r)) over its cuts, with l and r the counts of the two sides; the first such cut counts.
    Candidates whose words lie inside a longer candidate with at least as many occurrences are
    dropped. The first ``top`` per language stay, by score, then a, then phrase in byte order.
    Null texts are empty and give nothing, a null language is ``und``; repeated rows count each
    time. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "phrases")
    texts = _texts(docs, text_col, lang_col)
    counted = stored_in(words(texts), f"{folder}/words")
    sizes = stored_in(counted.groupBy("lang").agg(F.sum("n").alias("words")), f"{folder}/sizes")
    total = sizes.agg(F.sum("words")).first()[0] or 0
    named, numbers, complete = _known(counted, least, known)
    named = stored_in(named.select("lang", "word", "n", "id"), f"{folder}/numbered")
    rows = encoded(texts, numbers, complete, f"{folder}/encoded")
    hottest, hot_rows = _hot(rows, named, depth, int(max(min(hot, total * WIDE), total * HOT_SHARE)))
    buckets = max(tasks(spark), total // bucket + 1)
    found = counted_phrases(routed(rows, hottest, buckets, depth), depth, least)
    known_rows = [(r["lang"], r["ids"], r["n"]) for r in hot_rows if len(r["ids"]) > 1 and r["n"] >= least]
    found = found.unionByName(spark.createDataFrame(known_rows, found.schema))
    found = stored_in(found, f"{folder}/found")
    discard(spark, f"{folder}/encoded")
    result = stored_in(_ranked(found, named, sizes, least, top), f"{folder}/ranked")
    for old in ("words", "numbered", "found", "sizes"):
        discard(spark, f"{folder}/{old}")
    return result


def _ranked(found: DataFrame, named: DataFrame, sizes: DataFrame, least: int, top: int) -> DataFrame:
    """Candidates that stay, scored, named and ranked; joins by phrase."""
    inner = """flatten(transform(sequence(2, size(ids) - 1), k ->
                 transform(sequence(1, size(ids) - k + 1), i -> slice(ids, i, k))))"""
    inside = found.filter("size(ids) > 2").select("lang", F.explode(F.expr(inner)).alias("ids"), "n")
    covered = inside.groupBy("lang", "ids").agg(F.max("n").alias("cover"))
    stay = found.join(covered, ["lang", "ids"], "left").filter("cover IS NULL OR cover < n").drop("cover")
    counts = found.unionByName(named.filter(F.col("n") >= least).select("lang", F.array("id").alias("ids"), "n"))
    cuts = stay.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").select(
        "lang", "ids", F.col("n").alias("a"), F.col("words").alias("n"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k")
    )
    cuts = cuts.withColumns({"left": F.expr("slice(ids, 1, k)"), "right": F.expr("slice(ids, k + 1, size(ids) - k)")})
    for side, name in (("left", "l"), ("right", "r")):
        own = counts.select("lang", F.col("ids").alias(side), F.col("n").alias(name))
        cuts = cuts.join(own, ["lang", side])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    score = cuts.withColumns({f"{c}_": v for c, v in wide.items()}).withColumn("score", F.expr("(1000BD * a_ * n_) div (l_ * r_)"))
    best = score.groupBy("lang", "ids").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    # A word at a time meets its name; the words of a phrase come together again in order.
    placed = best.select("lang", "ids", F.posexplode("ids").alias("at", "id"))
    spelled = placed.join(named.select("lang", "id", "word"), ["lang", "id"]).groupBy("lang", "ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    listed = best.join(spelled, ["lang", "ids"]).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
