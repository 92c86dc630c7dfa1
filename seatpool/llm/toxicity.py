"""Toxic passages by maximum-scoring segments, aggregated by extreme-value calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seatpool.llm.common import remainder, text_hash
from seatpool.session import stored

#: Labelled rows to train on, about, per class; chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Terms of the model at most, those with the clearest log-odds.
MAX_TERMS = 50_000
#: Strength of the Dirichlet prior as a share of all counts of a class.
PRIOR = 0.02
#: Standard deviations by which a term's log-odds must differ from zero to be kept.
CLEAR = 4.2
#: Documents that hold a term at least, for it to be in the model.
SUPPORT = 6
#: What a token without clear log-odds costs: ends passages in long neutral stretches.
NEUTRAL = 0.1
#: Letters of a word's beginning that stand for it where the word itself is too rare.
STEM = 5
#: Expected number of chance segments in a clean text below which a segment is significant.
SIGNIFICANT = 0.001
#: Log-odds below which a term is no sign of either class.
STRONG = 1.0
FOLDS = 5
_PART = 1 << 20
_REMEMBERED = 400_000
_EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’…-–—*#&%$|/\\¡¿"


def _word(token: str) -> str:
    return token.strip(_EDGES)


def _stem(word: str) -> str | None:
    return word[:STEM] + "*" if len(word) > STEM else None


def _terms(text: str) -> set[str]:
    words = {_word(t) for t in text.lower().split()}
    words.discard("")
    return words | {s for s in map(_stem, words) if s}


def segments(scores: list[float], starts: list[int], ends: list[int]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first token, token after the last), in linear time.

    ``scores`` alternate: positive runs of tokens, each followed by the cost up to the next
    (0 after the last); ``starts`` and ``ends`` are the token places of the runs. Candidates
    are kept on a stack with the totals before and after them; one that begins lower and ends
    higher than an earlier one takes it in.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # before, after, first, last, next candidate below
    total = 0.0
    for i in range(0, len(scores), 2):
        before, after = total, total + scores[i]
        total = after + scores[i + 1]
        first, last = starts[i // 2], ends[i // 2]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= after:
                kept.append((before, after, first, last, j))
                break
            before, first = kept[j][0], kept[j][2]
            below = kept[j][4]
            del kept[j:]
            j = below
    return [(after - before, first, last) for before, after, first, last, _ in kept]


@dataclass
class Model:
    """Log-odds of clear terms, and what calibrates segment scores: rate and factor of the
    extreme-value law, and the log expectation at which a document is as likely toxic as not."""

    odds: dict[str, float]
    rate: float
    factor: float
    even: float


class _Scores(dict):
    """Token to score, remembered per worker."""

    def __init__(self, odds: dict[str, float]) -> None:
        super().__init__()
        self.odds = odds

    def __missing__(self, token: str) -> float:
        word = _word(token)
        value = self.odds.get(word)
        if value is None:
            value = self.odds.get(_stem(word) or "", 0.0)
        value -= NEUTRAL
        if len(self) < _REMEMBERED:
            self[token] = value
        return value


def scan(text: str, scores: _Scores) -> tuple[int, list[tuple[float, int, int]]]:
    """Number of tokens, and the maximal scoring segments of the whole text."""
    tokens = text.lower().split()
    values = np.fromiter(map(scores.__getitem__, tokens), dtype=np.float64, count=len(tokens))
    for i in np.flatnonzero(values > 0).tolist():
        if i and tokens[i] == tokens[i - 1]:  # a word said again at once says nothing new
            values[i] = -NEUTRAL
    high = values > 0
    if not high.any():
        return len(tokens), []
    edge = np.diff(np.concatenate([[0], high.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    runs = sums[ends] - sums[starts]
    gaps = np.concatenate([sums[starts[1:]] - sums[ends[:-1]], [0.0]])
    return len(tokens), segments(np.stack([runs, gaps], axis=1).ravel().tolist(), starts.tolist(), ends.tolist())


def log_expectation(tokens: int, found: list[tuple[float, int, int]], rate: float, factor: float) -> float:
    """Log of how often chance makes such segments in a clean text of that length: the sum over
    the significant ones, or else that of the best."""
    least = math.log(factor * max(tokens, 1))
    significant = [least - rate * s for s, _, _ in found if least - rate * s < math.log(SIGNIFICANT)]
    best = max((s for s, _, _ in found), default=0.0)
    return sum(significant) if significant else least - rate * best


def _chosen(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic): training rows, about ``rows`` per class, one of each distinct text."""
    marked = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).filter(remainder("doc_id", FOLDS) != 0)
    )
    sizes = marked.groupBy("toxic").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_PART)) / F.lit(float(_PART))
    picked = stored(
        marked.join(F.broadcast(sizes), "toxic").filter(place * F.col("n") < rows).select("doc_id", "toxic"), "picked"
    )
    texts = docs.select("doc_id", text_hash("text").alias("h")).join(F.broadcast(picked), "doc_id")
    return stored(texts.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"), "training-rows")


def log_odds(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(term, odds) of the clear terms, at most MAX_TERMS.

    Counts are documents that hold a term, words and stems alike. The prior of a word is the
    share of its stem's documents, that of a stem the share of all; the variance is that of
    log-odds with Dirichlet priors.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                counts[toxic].update(_terms(text.as_py() or ""))
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())],
                ["term", "toxic", "clean"],
            )

    sizes = chosen.groupBy().agg(F.sum("toxic").cast("double").alias("n1"), F.sum(1 - F.col("toxic")).cast("double").alias("n0")).first()
    n1, n0 = sizes["n1"] or 0.0, sizes["n0"] or 0.0
    if not n1 or not n0:
        return docs.sparkSession.createDataFrame([], "term string, odds double")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counted = texts.mapInArrow(work, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("y1"), F.sum("clean").alias("y0")
    ).filter(F.col("y1") + F.col("y0") >= SUPPORT)
    # Pseudo-counts in proportion to a term's own frequency, split as the class sizes are.
    both = F.col("y1") + F.col("y0")
    a1, a0 = PRIOR * both * n1 / (n1 + n0), PRIOR * both * n0 / (n1 + n0)
    odds = F.log((F.col("y1") + a1) / F.lit(n1)) - F.log((F.col("y0") + a0) / F.lit(n0))
    deviation = F.sqrt(1 / (F.col("y1") + a1 + 0.5) + 1 / (F.col("y0") + a0 + 0.5))
    clear = counted.select("term", odds.alias("odds"), (F.abs(odds) / deviation).alias("z")).filter((F.col("z") >= CLEAR) & (F.abs("odds") >= STRONG))
    return clear.orderBy(F.col("z").desc(), "term").limit(MAX_TERMS).select("term", "odds")


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1, by bisection; 1 if scores do
    not allow one."""
    if scores.max(initial=0.0) <= 0 or float(scores @ shares) >= 0:
        return 1.0
    low, high = 0.0, 1e-3
    with np.errstate(over="ignore"):
        while (shares * np.exp(high * scores)).sum() < 1 and high < 64:
            low, high = high, 2 * high
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if (shares * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return low


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Model from labelled rows outside the held-out fold; None without rows of both classes.

    What comes to the driver is bounded by MAX_TERMS and, per training row, four numbers.
    """
    chosen = _chosen(docs, labels, rows)
    odds = {row["term"]: row["odds"] for row in log_odds(docs, chosen).collect()}
    if not odds:
        return None
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often clean text has each score, to hundredths."""
        scores = _Scores(odds)
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                if not toxic:
                    seen.update(round(100 * scores[t]) for t in (text.as_py() or "").lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["score", "n"])

    spread = texts.mapInArrow(tally, "score long, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    values = np.array([r["score"] for r in spread], dtype=float) / 100
    shares = np.array([r["n"] for r in spread], dtype=float)
    tokens = float(shares.sum())
    # One more of the commonest gain stands for what clean text outside the sample may hold.
    gain = float(np.median([v for v in odds.values() if v > 0] or [1.0])) - NEUTRAL
    values, shares = np.append(values, gain), np.append(shares, 1.0)
    rate = _rate(values, shares / shares.sum())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(odds)
        for batch in batches:
            found = [scan(text.as_py() or "", scores) for text in batch.column("text")]
            best = [max((s for s, _, _ in f), default=0.0) for _, f in found]
            own = [log_expectation(n, f, rate, 1.0) for n, f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array(best, pa.float64()), pa.array(own, pa.float64())],
                ["toxic", "tokens", "best", "own"],
            )

    measured = texts.mapInArrow(measure, "toxic int, tokens long, best double, own double").toArrow()
    toxic, best, own = (measured[c].to_numpy() for c in ("toxic", "best", "own"))
    # Clean documents whose best segment reaches the usual gain, against the law at factor 1.
    reached = int((best[toxic == 0] >= gain).sum())
    factor = (reached + 1) / max(tokens * math.exp(-rate * gain), 1e-300)
    factor = min(max(factor, 1e-6), 1.0)
    own = own + math.log(factor)
    return Model(odds, rate, factor, _even(own, toxic))


def _even(values: np.ndarray, toxic: np.ndarray) -> float:
    """The value that parts the classes with the fewest errors, in the middle of its gap."""
    order = np.argsort(values, kind="stable")
    values, toxic = values[order], toxic[order]
    wrong = np.concatenate([[0], np.cumsum(toxic == 0)]) + (toxic.sum() - np.concatenate([[0], np.cumsum(toxic)]))
    inner = np.flatnonzero(np.diff(values) > 1e-9) + 1
    if not len(inner):
        return float(values[0]) - 1.0
    cut = inner[np.argmin(wrong[inner])]
    return float(values[cut - 1] + values[cut]) / 2


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, passages.

    ``score`` is 1 / (1 + e^(l - even)), l the log expectation of the text's segments in clean
    text; ``passages`` lists the significant ones as first token, token after the last, score.
    Null and empty texts have no passage and score as any text without one. Without labelled
    rows of both classes every score is 0. Labels of one id that differ count as toxic; labels
    without id or value are not used. Repeated rows are repeated in the result. Nothing but
    the text enters a score.
    """
    fitted = train(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    out = docs.select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "text")
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([
        out.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(span)),
    ])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = _Scores(model.odds) if model else None
        for batch in batches:
            values, spans = [], []
            for text in batch.column("text"):
                if model is None:
                    values.append(0.0)
                    spans.append([])
                    continue
                tokens, found = scan(text.as_py() or "", scores)
                least = math.log(model.factor * max(tokens, 1))
                log_e = log_expectation(tokens, found, model.rate, model.factor)
                values.append(1 / (1 + math.exp(min(700.0, log_e - model.even))))
                spans.append([{"first": a, "after": b, "score": s} for s, a, b in found if least - model.rate * s < math.log(SIGNIFICANT)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64()),
                 pa.array([int(v >= 0.5) for v in values], pa.int32()), pa.array(spans, kind)],
                schema.names,
            )

    return out.mapInArrow(work, schema)
