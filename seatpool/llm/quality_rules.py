"""Quality rules: decision lists learned by sequential covering, applied as Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seatpool.llm.common import text_hash
from seatpool.session import discard, new_folder, stored_in

#: Labelled rows to learn from, at most; chosen by a hash of their ids.
SAMPLE = 30_000
#: Words of a window, and the base rule's bounds.
WINDOW = 8
LEAST_WORDS = 20
REPEATED = 30
#: Conditions a rule grows to, thresholds tried per statistic and step, and rules in a list.
CONDITIONS = 4
THRESHOLDS = 64
RULES = 32
#: Share of rows a rule must reject rightly on the rows kept aside for pruning, and rows it must
#: reject rightly there.
PRECISION = 0.97
SUPPORT = 3
#: Words worked on at a time; a longer text is worked on alone.
GROUP = 200_000

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_lettered", "n_marks",
)
#: What rules speak of, as SQL over the counts.
STATISTICS = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_word_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_word_share": "n_distinct / greatest(n_words, 1)",
    "upper_word_share": "n_upper / greatest(n_words, 1)",
    "lettered_word_share": "n_lettered / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}


class Condition(NamedTuple):
    statistic: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        own = values[self.statistic]
        return own >= self.threshold if self.above else own <= self.threshold

    def column(self) -> Column:
        own = F.expr(STATISTICS[self.statistic])
        return own >= F.lit(self.threshold) if self.above else own <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


# ---------------------------------------------------------------- statistics


def repeated_words(ids: np.ndarray, docs: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document the words that lie in a window of ``window`` words (a power of two) found
    twice or more in it. Windows get exact ranks by doubling: two ranks side by side make one
    of twice the length."""
    if len(ids) < window:
        return np.zeros(n_docs, np.int64)
    ranks, width = ids.astype(np.int64), 1
    while width < window:
        pairs = ranks[:-width] * (ranks.max() + 1) + ranks[width:]
        ranks, width = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * width
    whole = docs[: len(ranks)] == docs[window - 1 :]
    starts = np.flatnonzero(whole)
    _, at, n = np.unique(ranks[starts] * n_docs + docs[starts], return_inverse=True, return_counts=True)
    twice = starts[n[at] > 1]
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + window, -1)
    return np.bincount(docs[np.cumsum(steps[:-1]) > 0], minlength=n_docs)


def _counts(texts: list[bytes], lengths: list[int]) -> np.ndarray:
    """COUNTS of some texts, a row each."""
    n, numbers, ids, sizes = len(texts), {}, [], []
    found = np.zeros((n, len(COUNTS)), np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        sizes.append(len(words))
        ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
        lines = [line for line in text.split(b"\n") if line.strip(_SPACES)]
        spaces = len(text) - len(text.translate(None, _SPACES))
        symbols = len(text) - len(text.translate(None, _SYMBOLS))
        found[i, 1:4] = lengths[i] - spaces, symbols, len(lines) - len(set(lines))
        found[i, 5:7] = len(lines), len(set(words))
    found[:, 0] = sizes
    ids, docs = np.array(ids, np.int64), np.repeat(np.arange(n), sizes)
    found[:, 4] = repeated_words(ids, docs, n)
    known = [w.decode("utf-8", "replace") for w in numbers]
    for at, holds in ((7, lambda w: w.isupper()), (8, lambda w: any(map(str.isalpha, w))), (9, lambda w: w[-1] in "!?")):
        flags = np.fromiter(map(holds, known), bool, len(known))
        found[:, at] = np.bincount(docs[flags[ids]] if len(ids) else docs, minlength=n)
    return found


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and COUNTS of every whole text; a null text has none of anything."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"),
        F.coalesce(text, F.lit("")).cast("binary").alias("bytes"), F.coalesce(F.length(text), F.lit(0)).alias("length"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", *COUNTS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # About six bytes are a word.
            groups = pc.divide(pc.cumulative_sum(pc.cast(pc.binary_length(batch.column("bytes")), pa.int64())), 6 * GROUP).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(starts, starts[1:]):
                own = batch.slice(start, stop - start)
                found = _counts(own.column("bytes").to_pylist(), own.column("length").to_pylist())
                columns = [pa.array(np.ascontiguousarray(c)) for c in found.T]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_hash"), *columns], names)

    return rows.mapInArrow(work, f"doc_id {kind}, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


# ---------------------------------------------------------------- learning


def _covers(rule: Rule, values: dict[str, np.ndarray], size: int) -> np.ndarray:
    found = np.ones(size, bool)
    for condition in rule:
        found &= condition.holds(values)
    return found


def _grown(values: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray) -> Rule:
    """Conditions are added by the information they gain until no good row is covered."""
    rule: list[Condition] = []
    covered = left.copy()
    while len(rule) < CONDITIONS:
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for name in sorted(values):
            own = values[name][covered]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, THRESHOLDS + 1)[1:-1], method="nearest"))
            for above in (True, False):
                side = own[:, None] >= cuts if above else own[:, None] <= cuts
                rights, wrongs = side[bad[covered]].sum(axis=0), side[~bad[covered]].sum(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(rights > 0, rights * (np.log2(rights / (rights + wrongs)) - np.log2(p / (p + n))), 0.0)
                at = int(gains.argmax())
                if gains[at] > gain:
                    best, gain = Condition(name, above, float(cuts[at])), gains[at]
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(values)
    return tuple(rule)


def _pruned(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray) -> tuple[Rule, int, int]:
    """The beginning of a rule that is best on rows it was not grown on, and what it covers there:
    the least share of mistakes, then the most rows."""
    found = []
    for size in range(1, len(rule) + 1):
        own = left & _covers(rule[:size], values, len(bad))
        p, n = int((own & bad).sum()), int((own & ~bad).sum())
        found.append(((p + 1) / (p + n + 2), p, -size, n))
    _, p, size, n = max(found)
    return rule[:-size], p, n


def learned(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules for rejecting, in order. Each is grown on two thirds of the rows that no earlier rule
    covers and pruned on the others; the list ends with the first rule that is not good enough
    there, so that doubtful rows are kept."""
    aside = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < RULES and (left & bad & ~aside).any():
        rule = _grown(values, bad, left & ~aside)
        if not rule:
            break
        rule, p, n = _pruned(rule, values, bad, left & aside)
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~_covers(rule, values, len(bad))
    return rules


def labelled(counted: DataFrame, labels: DataFrame, rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics of labelled rows that pass the base rule, and which of them are bad. Ids that
    ``labels`` marks both ways teach nothing. At most ``rows`` of them, the first by hash."""
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("high")
    ).filter("low = high")
    own = counted.filter(~base_failed()).join(marked, "doc_id").select(
        F.xxhash64("doc_id", "text_hash").alias("order"), F.col("low").alias("quality"), *[F.expr(s).alias(k) for k, s in STATISTICS.items()]
    )
    sample = own.orderBy("order", *STATISTICS).limit(rows).toArrow()
    return {k: sample[k].to_numpy() for k in STATISTICS}, sample["quality"].to_numpy() == 0


def fired(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that covers a row; null if none does."""
    found = None
    for number, rule in enumerate(rules, 1):
        covers = F.lit(True)
        for condition in rule:
            covers = covers & condition.column()
        found = F.when(covers, number) if found is None else found.when(covers, number)
    return F.lit(None).cast("int") if found is None else found


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, rule (what rejected it: 0 the base, otherwise a rule's
    number), text_hash.

    Null and empty texts have no words and fail the base. Without labelled rows, or where no
    rule is good enough, the base alone decides. Very long texts are worked on whole. Repeated
    rows are repeated in the result, and rows without id teach nothing. An empty table gives
    no rows; other columns are not read.
    """
    folder = new_folder(docs.sparkSession, "quality-rules")
    counted = stored_in(statistics(docs, id_col, text_col), f"{folder}/statistics")
    rules = learned(*labelled(counted, labels, sample))
    rule = F.when(base_failed(), 0).otherwise(fired(rules))
    found = counted.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), rule.isNull().alias("kept"), rule.alias("rule"), "text_hash")
    result = stored_in(found, f"{folder}/result")
    discard(docs.sparkSession, f"{folder}/statistics")
    return result
