"""Quality classifier: interpolated modified Kneser-Ney over characters of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seatpool.functions.ordered import sized
from seatpool.llm.common import text_hash, without
from seatpool.session import stored

ORDER = 5
#: Symbols per language: 0 starts a text, 255 is any other character.
SYMBOLS = 256
_START, _OTHER = 0, 255
#: Share of a language's trusted documents that the threshold keeps.
KEEP = 0.998
#: Symbols at the language's mean that a document's own are averaged with, so that a
#: threshold on rates holds for short documents.
PRIOR = 50
#: Name of the model of all languages together, for rows without language or with one that
#: has no trusted text.
POOLED = ""
_PART = 1 << 20


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _grams(symbols: np.ndarray, order: int, before: np.ndarray | None = None) -> np.ndarray:
    """The ``order`` symbols up to each place as one number, the last in the lowest byte."""
    start = np.full(order - 1, _START) if before is None else before
    padded = np.concatenate([start, symbols]).astype(np.uint64)
    found = np.zeros(len(symbols), dtype=np.uint64)
    for k in range(order):
        found = (found << np.uint64(8)) | padded[k : k + len(symbols)]
    return found


def _runs(texts: pa.Array, rows: list[int]) -> Iterator[list[tuple[np.ndarray, bool]]]:
    """Code points of the texts in these rows in runs of at most _PART, so that a task works on as
    many at a time however long its texts are. A run has pieces, and whether a text begins there."""
    run: list[tuple[np.ndarray, bool]] = []
    size = 0
    for i in rows:
        points = _points(texts[i].as_py())
        for at in range(0, len(points), _PART):
            piece = points[at : at + _PART]
            if run and size + len(piece) > _PART:
                yield run
                run, size = [], 0
            run.append((piece, at == 0))
            size += len(piece)
    if run:
        yield run


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, text) of all trusted rows with text."""
    texts = docs.select("doc_id", F.coalesce("lang", F.lit(POOLED)).alias("lang"), "text").filter(F.length("text") > 0)
    return stored(texts.join(sized(trusted, trusted.count()), "doc_id", "left_semi").select("lang", "text"), "trusted-texts")


def trusted_sample(docs: DataFrame, trusted: DataFrame, chars: int) -> DataFrame:
    """The same of rows chosen by hash so that each language gives about ``chars`` characters,
    for callers that ask for so many."""
    sizes = docs.select("doc_id", F.coalesce("lang", F.lit(POOLED)).alias("lang"), F.length("text").alias("size"))
    sizes = stored(sizes.filter("size > 0").join(trusted, "doc_id", "left_semi"), "trusted-sizes")
    totals = stored(sizes.groupBy("lang").agg(F.sum("size").alias("total")), "trusted-characters")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(_PART)) / F.lit(float(_PART))
    picked = stored(
        sizes.join(F.broadcast(totals), "lang").filter(share * F.col("total") < chars).select("doc_id").distinct(), "picked"
    )
    # At most as many ids as characters; the texts themselves are not shuffled.
    texts = docs.select("doc_id", F.coalesce("lang", F.lit(POOLED)).alias("lang"), "text").filter(F.length("text") > 0)
    return stored(texts.join(F.broadcast(picked), "doc_id").select("lang", "text"), "trusted-sample")


def alphabet(sample: DataFrame) -> DataFrame:
    """(lang, point, symbol): the most frequent characters of each language, at most 254."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            for lang in set(langs.tolist()):
                counts = np.zeros(0x110000, dtype=np.int64)
                for run in _runs(batch.column("text"), np.flatnonzero(langs == lang).tolist()):
                    for piece, _ in run:
                        points, n = np.unique(piece, return_counts=True)
                        counts[points] += n
                points = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(points), pa.string()), pa.array(points), pa.array(counts[points])], ["lang", "point", "n"]
                )

    counted = sample.mapInArrow(work, "lang string, point long, n long").groupBy("lang", "point").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("lang").orderBy(F.col("n").desc(), "point")
    return counted.withColumn("symbol", F.row_number().over(own)).filter(F.col("symbol") < _OTHER).select("lang", "point", "symbol")


def _tables(symbols: DataFrame) -> dict[str, dict[int, int]]:
    """Bounded by 254 characters per language."""
    found: dict[str, dict[int, int]] = {}
    for row in symbols.collect():
        found.setdefault(row["lang"], {})[row["point"]] = row["symbol"]
    return found


def _lookup(tables: dict[str, dict[int, int]]) -> dict[str, np.ndarray]:
    found = {}
    for lang, symbols in tables.items():
        table = np.full(0x110000, _OTHER, dtype=np.uint8)
        table[list(symbols)] = list(symbols.values())
        found[lang] = table
    return found


def counts(sample: DataFrame, tables: dict[str, dict[int, int]], order: int) -> DataFrame:
    """(lang, gram, n) of the longest order, combined per run of a batch before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(tables)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in set(langs) & set(lookup):
                before = None
                for run in _runs(batch.column("text"), [i for i, own in enumerate(langs) if own == lang]):
                    grams = []
                    for piece, begins in run:
                        symbols = lookup[lang][piece]
                        start = np.full(order - 1, _START, dtype=np.uint8) if begins else before
                        grams.append(_grams(symbols, order, start))
                        carried = np.concatenate([start, symbols[-order:]])
                        before = carried[len(carried) - (order - 1) :]
                    found, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                    )

    return sample.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model(longest: DataFrame, order: int) -> DataFrame:
    """(lang, k, gram, logp, backoff): log10 probabilities of seen grams of each length k, and
    the log10 weight of the shorter context behind a seen context.

    Counts of shorter grams are continuation counts: the distinct symbols before them. Three
    discounts per length come from the counts of counts. Each length joins its counts with
    the sums of their contexts and with the probabilities one symbol shorter, sharded by
    language and gram. These joins are merges: the files, by which Spark sizes the tables, are
    a small part of what they are in the memory of a driver that broadcasts them.
    """
    # each is written before the next is made of it, so that texts are counted once
    by_length = {order: stored(longest, f"grams-{order}")}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        shorter = by_length[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n"))
        by_length[k] = stored(shorter, f"grams-{k}")
    parts = []
    lower = None
    for k in range(1, order + 1):
        rows = by_length[k]
        of = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        d = [
            F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0)))).alias(f"d{i}")
            for i in (1, 2, 3)
        ]
        discounts = rows.groupBy("lang").agg(*of).select("lang", *d)
        context = F.shiftrightunsigned("gram", 8)
        several = [F.sum(F.when(c, 1).otherwise(0)).alias(f"c{i}") for i, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))]
        contexts = (
            rows.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), *several)
            .join(discounts, "lang")
            .withColumn("weight", (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total"))
        )
        contexts = stored(contexts.select("lang", "context", "total", "weight", "d1", "d2", "d3"), f"contexts-{k}")
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = rows.withColumn("context", context).join(contexts.hint("merge"), ["lang", "context"])
        shorter = F.lit(1.0 / SYMBOLS)
        if lower is not None:
            seen = seen.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(
                lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("shorter")).hint("merge"), ["lang", "tail"]
            )
            shorter = F.col("shorter")
        p = (F.greatest(F.col("n") - taken, F.lit(0.0)) / F.col("total") + F.col("weight") * shorter).alias("p")
        lower = stored(seen.select("lang", "gram", p), f"probabilities-{k}")
        parts.append(lower.select("lang", F.lit(k).alias("k"), "gram", F.log10("p").cast("float").alias("value")))
        parts.append(contexts.select("lang", F.lit(-k).alias("k"), F.col("context").alias("gram"), F.log10("weight").cast("float").alias("value")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


class Scorer:
    """Sorted arrays of one language's model; scores whole texts, part by part."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.grams, self.order = grams, order

    def _find(self, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.grams[k]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def total(self, symbols: np.ndarray) -> float:
        """Sum of log10 probabilities of the symbols."""
        total, before = 0.0, None
        for i in range(0, len(symbols), _PART):
            part = symbols[i : i + _PART]
            total += self._part(_grams(part, self.order, before))
            before = np.concatenate([np.full(self.order, _START), symbols[max(0, i + _PART - self.order) : i + _PART]])[-(self.order - 1) :]
        return total

    def _part(self, grams: np.ndarray) -> float:
        total, wanted = 0.0, grams
        for k in range(self.order, 0, -1):
            wanted = wanted & np.uint64((1 << 8 * k) - 1)
            there, values = self._find(k, wanted)
            total += float(values[there].sum(dtype=np.float64))
            wanted = wanted[~there]
            if not len(wanted):
                return total
            there, values = self._find(-k, wanted >> np.uint64(8))
            total += float(values[there].sum(dtype=np.float64))
        return total - len(wanted) * float(np.log10(SYMBOLS))


def _collected(rows: DataFrame) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The model as arrays: the distinct grams of all trusted text, per language and order. Languages
    go by number, so that there is no Python object per gram."""
    table = rows.toArrow()
    coded = table["lang"].dictionary_encode().combine_chunks()
    langs, names, lengths = coded.indices.to_numpy(), coded.dictionary.to_pylist(), table["k"].to_numpy()
    grams, values = table["gram"].to_numpy().view(np.uint64), table["value"].to_numpy()
    found: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for number, lang in sorted(enumerate(names), key=lambda pair: pair[1]):
        for k in np.unique(lengths).tolist():
            own = np.flatnonzero((langs == number) & (lengths == k))
            own = own[np.argsort(grams[own], kind="stable")]
            found.setdefault(lang, {})[k] = (grams[own], values[own])
    return found


def perplexities(docs: DataFrame, trusted: DataFrame, train_chars: int | None = None, order: int = ORDER) -> DataFrame:
    """(doc_id, text_hash, lang, model, n_symbols, log10_sum) of every whole text; written once.

    ``trusted`` has one column doc_id. ``model`` names the language model used; it is null if
    there is no trusted text at all, and so is the sum. Models are of all trusted rows, unless
    ``train_chars`` asks for about so many characters per language.
    """
    sample = trusted_texts(docs, trusted) if train_chars is None else trusted_sample(docs, trusted, train_chars)
    pooled = sample.filter(F.col("lang") != POOLED).withColumn("lang", F.lit(POOLED))
    sample = sample.unionByName(pooled)
    tables = _tables(alphabet(sample))
    arrays = _collected(model(counts(sample, tables, order), order)) if tables else {}
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((tables, arrays))
    rows = docs.select("doc_id", text_hash("text").alias("text_hash"), "lang", "text")
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("lang", T.StringType()),
        T.StructField("model", T.StringType()), T.StructField("n_symbols", T.LongType()), T.StructField("log10_sum", T.DoubleType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, arrays = shared.value
        lookup = _lookup(tables)
        scorers = {lang: Scorer(grams, order) for lang, grams in arrays.items()}
        for batch in batches:
            names, sizes, sums = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                name = lang if lang in scorers else POOLED if POOLED in scorers else None
                points = _points(text.as_py() or "")
                names.append(name)
                sizes.append(len(points))
                sums.append(None if name is None else scorers[name].total(lookup[name][points]) if len(points) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), batch.column("lang"), pa.array(names, pa.string()),
                 pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())],
                schema.names,
            )

    found = stored(rows.mapInArrow(work, schema), "perplexities")
    shared.destroy()
    return found


def classify(
    docs: DataFrame, labels: DataFrame, train_chars: int | None = None, keep: float = KEEP, order: int = ORDER
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, lang, n_symbols, perplexity,
    threshold, kept, text_hash.

    Trusted are the documents that ``labels`` marks with quality 1, and not also with 0. The
    perplexity per character is averaged with PRIOR characters at the mean of its model's
    trusted text; the threshold is the ``keep`` quantile over all trusted documents of the
    model. Null and empty texts lie at the mean and are kept. Rows without language, or of
    one without trusted text, go by the pooled model. Without any trusted text all rows are
    kept and have no perplexity. Repeated rows are repeated in the result.
    """
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = stored(marked.filter("quality = 1").select("doc_id"), "trusted")
    rows = perplexities(docs, trusted, train_chars, order)
    own = rows.filter("log10_sum IS NOT NULL AND n_symbols > 0").join(trusted, "doc_id", "left_semi")
    pooled = own.withColumn("model", F.lit(POOLED))
    # The pooled mean and threshold come from all trusted rows, under their own models' sums.
    own = stored(own.filter(F.col("model") != POOLED).unionByName(pooled).select("model", "n_symbols", "log10_sum"), "trusted-sums")
    means = own.groupBy("model").agg((F.sum("log10_sum") / F.sum("n_symbols")).alias("mean"))
    rate = (F.col("log10_sum") + PRIOR * F.col("mean")) / (F.col("n_symbols") + PRIOR)
    limits = (
        own.join(F.broadcast(means), "model").groupBy("model")
        .agg(F.percentile_approx(-rate, F.lit(keep), F.lit(100_000)).alias("limit"), F.first("mean").alias("mean"))
    )
    perplexity = F.pow(F.lit(10.0), -rate)
    threshold = F.pow(F.lit(10.0), F.col("limit"))
    return rows.join(F.broadcast(stored(limits, "limits")), "model", "left").select(
        "doc_id", "lang", "n_symbols", perplexity.alias("perplexity"), threshold.alias("threshold"),
        F.coalesce(perplexity <= threshold, F.lit(True)).alias("kept"), "text_hash",
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects."""
    rejected = stored(classify(docs, labels).filter("NOT kept"), "rejected")
    return without(docs, rejected, "doc_id", "text")
