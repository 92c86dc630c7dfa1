"""Language-model scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from seatpool.functions.ordered import numbered
from seatpool.llm.common import remainder
from seatpool.session import discard, new_folder, stored, stored_in

FOLDS = 10
#: The end of a text as a token; words hold no white space.
END = b"\n"
#: Pseudo-count of the base distribution.
ADD = 0.1
#: Contexts seen so often may be states, and symbols seen so often behind one are stored.
MINIMUM = 20
#: Words that tasks know by a dictionary, the most frequent ones. Other words that are seen MINIMUM
#: times get their numbers by a join, and what hangs on them is joined too. Rarer ones are one symbol
#: to the tree; their base probabilities come from a join with all words.
WORDS_IN_TASKS = (1 << 20) - 1
#: Entries and states that tasks hold, the most frequent ones; tokens that may depend on others go to
#: the part of the whole tree that has all that may follow their middle word.
IN_TASKS = 2_000_000
#: Parts at least, and entries of a part on the average at most.
PARTS, ENTRIES_IN_PART = 48, 200_000
#: The most frequent words, whose contexts are dealt over SALTS parts; what hangs on such a word alone
#: is in each of them.
HOT_WORDS, SALTS = 256, 16
#: From so many tokens on, triples are counted and open tokens looked up in PASSES turns, so that
#: shuffle files of a share of them are on disk at a time.
MANY_TOKENS, PASSES = 10_000_000, 4
#: Weight of the shorter context, in tokens.
SMOOTH = 5.0
#: Bits of the filter of word pairs that are seen MINIMUM times: it passes all of them, and others.
FILTER_BITS = 25
#: Bits of the filter of entries and states that tasks do not hold.
REST_BITS = 26
_SHIFT = 31  # bits of a word number: two fit a long, and numbers an int
_WORD = (1 << _SHIFT) - 1
_FLUSH = 300_000
_CHUNK = 500_000  # tokens worked on at a time
_ONE, _NEXT, _STATE, _NEXT2 = 0, 1, 2, 3  # states of one word, entries behind, states of two words, entries behind these
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = np.dtype([("kind", "i1"), ("code", "<i8"), ("word", "<i4"), ("value", "<f8")])


def _tokens(text: bytes | None) -> list[bytes]:
    """Words of the text, A-Z in lower case, split as ASCII."""
    return (text or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts (binary), ends included; counted in pieces of bounded size per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            words = pa.array(list(counts.keys()), pa.binary()).cast(pa.string())
            found = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return found

        for batch in batches:
            for text in batch.column("text"):
                counts.update(_tokens(text.as_py()))
                if len(counts) > _FLUSH:
                    yield flushed()
            counts[END] += batch.num_rows
        yield flushed()

    return texts.mapInArrow(work, "word string, c long").filter("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def _numbers_of(words: pa.Array) -> dict[bytes, int]:
    return {word.encode(): i + 1 for i, word in enumerate(words.to_pylist())}


class _Dictionary:
    """Words in the order of their numbers; the dictionary is made in the tasks, not on the driver."""

    def __init__(self, words: pa.Array) -> None:
        self.words = words

    def __reduce__(self) -> tuple:
        return _numbers_of, (self.words,)


def numbered_texts(rows: DataFrame, words: pa.Array, folder: str, others: DataFrame | None = None) -> DataFrame:
    """Below ``folder``: rows (doc_id, held_out, text) as (row, doc_id, held_out, n_tokens, numbers, rare): the numbers
    of the tokens, 32 bits each, 0 for words without number. Words that are not in the dictionary are
    counted in rare; ``others`` (word, number), any number of them, get their numbers by a join."""
    shared = rows.sparkSession.sparkContext.broadcast(_Dictionary(words))
    rare = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("k", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
    kind = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64()), ("at", pa.list_(pa.int32()))]))
    placed = others is not None
    schema = T.StructType([
        T.StructField("row", T.LongType()), rows.schema["doc_id"], rows.schema["held_out"],
        T.StructField("n_tokens", T.LongType()), T.StructField("numbers", T.BinaryType()), T.StructField("rare", rare),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row = shared.value.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths, numbers, rare_ones = [], [], []
            for text in batch.column("text"):
                tokens = _tokens(text.as_py())
                tokens.append(END)
                found = np.fromiter(map(get, tokens, repeat(0)), np.int32, len(tokens))
                lengths.append(len(tokens))
                numbers.append(found.tobytes())
                at: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(found == 0).tolist():
                    at.setdefault(tokens[i], []).append(i)
                rare_ones.append([{"word": w.decode(), "k": len(x), "at": x if placed else None} for w, x in at.items()])
            places = pa.array(range(row, row + len(lengths)), pa.int64())
            row += len(lengths)
            columns = [places, batch.column("doc_id"), batch.column("held_out"), pa.array(lengths, pa.int64()),
                       pa.array(numbers, pa.binary()), pa.array(rare_ones, kind)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    done = stored_in(rows.mapInArrow(work, schema), f"{folder}/{'in-dictionary' if placed else 'all'}")
    shared.destroy()
    if not placed:
        return done
    whole = stored_in(_with_others(done, others), f"{folder}/all")
    discard(rows.sparkSession, f"{folder}/in-dictionary")
    return whole


def _with_others(texts: DataFrame, others: DataFrame) -> DataFrame:
    """Numbered texts with the numbers of ``others`` (word, number) put in their places; where these
    are is not kept."""
    asked = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.at")
    found = asked.join(others, "word").groupBy("row").agg(F.collect_list(F.struct("number", "at")).alias("found"))
    names = texts.columns
    place = names.index("numbers")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = []
            for old, found in zip(batch.column("numbers"), batch.column("found")):
                new = np.frombuffer(old.as_py(), np.int32).copy()
                for entry in found.as_py() or []:
                    new[entry["at"]] = entry["number"]
                numbers.append(new.tobytes())
            columns = batch.columns[:-1]
            columns[place] = pa.array(numbers, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    unplaced = F.expr("transform(rare, r -> named_struct('word', r.word, 'k', r.k, 'at', CAST(NULL AS array<int>)))")
    joined = texts.withColumn("rare", unplaced).join(found, "row", "left").select(*names, "found")
    return joined.mapInArrow(work, texts.schema)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about _CHUNK tokens: (first text, its numbers, where texts begin)."""
    lengths = batch.column("n_tokens").to_numpy()
    column = batch.column("numbers")
    first = 0
    while first < len(lengths):
        upto = first + max(1, int(np.searchsorted(np.cumsum(lengths[first:]), _CHUNK, side="right")))
        numbers = np.frombuffer(b"".join(column[i].as_py() for i in range(first, upto)), np.int32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths[first:upto])[:-1]]).astype(np.int64)
        yield first, numbers, starts
        first = upto


def _before(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers two and one places earlier in the same text; 0, which no state holds, before it."""
    one = np.concatenate([[0], numbers[:-1]])
    one[starts] = 0
    two = np.concatenate([[0], one[:-1]])
    two[starts] = 0
    return two, one


def _places(codes: np.ndarray, bits: int) -> np.ndarray:
    """Bits of a filter of 2 ** ``bits`` for codes, as of word pairs."""
    return (codes.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)


def _passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = _places(codes, len(bits).bit_length() + 5)
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _entry_codes(kind: int | np.ndarray, code: np.ndarray, word: int | np.ndarray = 0) -> np.ndarray:
    """One code for an entry or state of the tree, for the filter."""
    mixed = code.astype(np.uint64) * _MIX
    return (mixed ^ (mixed >> np.uint64(29))) + np.asarray(word).astype(np.uint64) * np.uint64(4) + np.asarray(kind).astype(np.uint64)


def entry_filter(entries: DataFrame) -> np.ndarray:
    """A filter that passes all these entries and states of the tree, and others."""
    return pair_filter(entries.select("kind", "code", "word"), REST_BITS, lambda b: _entry_codes(*[b.column(c).to_numpy() for c in ("kind", "code", "word")]))


def pair_filter(pairs: DataFrame, size: int = FILTER_BITS, codes: Callable = lambda batch: batch.column("code").to_numpy()) -> np.ndarray:
    """A filter of fixed size that passes every code of ``pairs``. Bits are combined in tasks
    and by the shuffle; at most 2 ** ``size`` of them come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(codes(batch), size))
            if len(at):
                slots, begin = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin)
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bits"])

    found = pairs.mapInArrow(work, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), dtype=np.uint64)
    bits[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def pair_counts(texts: DataFrame) -> DataFrame:
    """(code, c) of pairs of numbered words, counted in tasks before the shuffle."""

    def codes(two: np.ndarray, one: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
        return [((one << _SHIFT) | numbers)[(one > 0) & (numbers > 0)]]

    def counted(codes: np.ndarray) -> list[np.ndarray]:
        return [*np.unique(codes, return_counts=True)]

    return _gram_counts(texts, ["code"], codes, counted)


def triple_counts(texts: DataFrame, shared: Broadcast, turn: int = 0, turns: int = 1) -> DataFrame:
    """(context, word, c) of triples of numbered words, the context as the code of a pair, both of
    whose pairs pass the filter of frequent pairs, as those of all frequent triples do; of ``turns``
    shares of the contexts, the one of this ``turn``."""

    def codes(two: np.ndarray, one: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
        whole = (two > 0) & (one > 0) & (numbers > 0) & ((two + one) % turns == turn)
        context, pair = ((two << _SHIFT) | one)[whole], ((one << _SHIFT) | numbers)[whole]
        passed = _passes(shared.value, context)
        passed[passed] = _passes(shared.value, pair[passed])
        return [context[passed], pair[passed] & _WORD]

    def counted(context: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
        contexts, places = np.unique(context, return_inverse=True)
        found, c = np.unique((places << _SHIFT) | word, return_counts=True)
        return [contexts[found >> _SHIFT], found & _WORD, c]

    return _gram_counts(texts, ["context", "word"], codes, counted)


def _gram_counts(texts: DataFrame, names: list[str], codes: Callable, counted: Callable) -> DataFrame:
    """Grams as columns of whole numbers, and how often they come, in runs of bounded length per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            columns = counted(*[np.concatenate(parts) for parts in zip(*waiting)])
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], [*names, "c"])

        for batch in batches:
            for _, numbers, starts in _chunks(batch):
                waiting.append(codes(*_before(numbers, starts), numbers))
                if sum(len(parts[0]) for parts in waiting) > 10 * _FLUSH:
                    yield flushed()
        if waiting:
            yield flushed()

    schema = ", ".join(f"{name} long" for name in [*names, "c"])
    return texts.select("n_tokens", "numbers").mapInArrow(work, schema).groupBy(*names).agg(F.sum("c").alias("c"))


def _judged(entries: DataFrame) -> DataFrame:
    """Entries (context, word, c, total, q) with p, weight and whether the context is a state.

    ``p`` is the smoothed probability behind the context and ``weight`` what it leaves to the
    shorter one, whose probability is ``q``. A context is a state if its next-symbol distribution
    differs by more than the description of its entries costs: count times divergence, in nats,
    against half a log of the count per entry; symbols that are not stored are one symbol. A
    context has an entry per numbered word at most.
    """
    whole = Window.partitionBy("context").orderBy("word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def rest(column: str) -> Column:
        return F.greatest(1 - F.sum(column).over(whole), F.lit(1e-12))

    weighed = entries.withColumn("weight", (SMOOTH + F.col("total") - F.sum("c").over(whole)) / (F.col("total") + SMOOTH))
    smoothed = weighed.withColumn("p", F.col("c") / (F.col("total") + SMOOTH) + F.col("weight") * F.col("q"))
    gain = F.sum(F.col("c") * F.log(F.col("p") / F.col("q"))).over(whole) + F.col("total") * rest("p") * F.log(rest("p") / rest("q"))
    cost = 0.5 * F.log(F.greatest(F.col("total"), F.lit(2))) * F.count("*").over(whole)
    return smoothed.withColumn("kept", gain > cost)


def grow(texts: DataFrame, numbers: DataFrame, end: int, minimum: int, folder: str, turns: int = 1) -> DataFrame:
    """The tree as a table (kind, code, word, c, value) below ``folder``; entries behind two words
    have the code of these, and the word by itself. Triples are counted in so many ``turns``.

    ``texts`` are numbered, ``numbers`` has (number, c, base). Contexts of one and two words, and
    words behind them, are those seen ``minimum`` times; there is no other bound on their number,
    and none of them comes to the driver. Values are logs to base 10.
    """
    behind = numbers.select(F.col("number").alias("word"), F.col("base").alias("q"))
    before = numbers.select(F.col("number").alias("context"), F.col("c").alias("total"))
    pairs = pair_counts(texts).filter(F.col("c") >= minimum)
    pairs = pairs.withColumns({"context": F.shiftright("code", _SHIFT), "word": F.col("code").bitwiseAND(_WORD)})
    pairs = stored_in(_judged(pairs.join(before, "context").join(behind, "word")), f"{folder}/1")
    bits = pair_filter(pairs.select("code"))
    shorter = pairs.select(F.col("code").alias("pair"), F.when(F.col("kept"), F.col("p")).otherwise(F.col("q")).alias("q"))
    contexts = pairs.filter(F.col("word") != end).select(F.col("code").alias("context"), F.col("c").alias("total"))
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    judged = []
    for turn in range(turns):
        triples = triple_counts(texts, shared, turn, turns).filter(F.col("c") >= minimum)
        triples = triples.withColumn("pair", F.shiftleft(F.col("context").bitwiseAND(_WORD), _SHIFT).bitwiseOR(F.col("word")))
        judged.append(stored_in(_judged(triples.join(contexts, "context").join(shorter, "pair")), f"{folder}/2-{turn}"))
    triples = reduce(DataFrame.unionByName, judged)
    shared.destroy()

    def entries(table: DataFrame, kind: int, code: str, word: Column) -> DataFrame:
        return table.filter("kept").select(F.lit(kind).alias("kind"), F.col(code).alias("code"), word.alias("word"), "c", F.log10("p").alias("value"))

    def states(table: DataFrame, kind: int) -> DataFrame:
        state = table.filter("kept").groupBy("context").agg(F.max("total").alias("c"), F.max("weight").alias("weight"))
        return state.select(F.lit(kind).alias("kind"), F.col("context").alias("code"), none.alias("word"), "c", F.log10("weight").alias("value"))

    # States of one word are as many as numbered words at most.
    none = F.lit(0).cast("long")
    parts = [states(pairs, _ONE), entries(pairs, _NEXT, "code", none), states(triples, _STATE), entries(triples, _NEXT2, "context", F.col("word"))]
    model = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    model = stored_in(model, f"{folder}/all")
    for old in ("1", *[f"2-{turn}" for turn in range(turns)]):
        discard(texts.sparkSession, f"{folder}/{old}")
    return model


@dataclass
class Tree:
    """What tasks hold. ``base`` and ``weight`` are by word number (0: any other word) for the words
    of the dictionary, the latter with ``state``, whether the word alone is a state; ``codes`` and
    ``values`` by kind, sorted; behind two words, codes are the place of these in ``contexts`` and the
    word. ``bits`` tells which entries and states the rest of the tree may have, None if there is no rest."""

    base: np.ndarray
    state: np.ndarray
    weight: np.ndarray
    contexts: np.ndarray
    codes: dict[int, np.ndarray]
    values: dict[int, np.ndarray]
    bits: np.ndarray | None


def _band(c: str = "c") -> Column:
    return F.floor(F.log2(c) * 8).cast("int")


def _sorted(kind: np.ndarray, code: np.ndarray, word: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, dict, dict]:
    """Contexts, codes and values by kind, as a ``Tree`` has them."""
    code, behind = code.copy(), kind == _NEXT2
    contexts, places = np.unique(code[behind], return_inverse=True)
    code[behind] = (places << _SHIFT) | word[behind]
    codes, values = {}, {}
    for k in (_ONE, _NEXT, _STATE, _NEXT2):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(code[own])]
        codes[k], values[k] = code[own], value[own]
    return contexts, codes, values


def frequent_part(model: DataFrame, base: np.ndarray, in_tasks: int) -> Tree:
    """The most frequent entries and states, at most ``in_tasks``, for the tasks."""
    rows = model.filter(F.col("kind") != _ONE)
    least, kept, others = None, 0, False
    for band, n in rows.groupBy(_band().alias("band")).count().orderBy(F.col("band").desc()).collect():
        if kept + n > in_tasks:
            others = True
            break
        least, kept = band, kept + n
    some = rows.filter(_band() >= least) if least is not None else rows.filter("false")
    found = some.select("kind", "code", "word", "value").toArrow()
    contexts, codes, values = _sorted(*[found[name].to_numpy() for name in ("kind", "code", "word", "value")])
    ones = model.filter((F.col("kind") == _ONE) & (F.col("code") < len(base))).select("code", "value").toArrow()
    state, weight = np.zeros(len(base), dtype=bool), np.zeros(len(base))
    state[ones["code"].to_numpy()] = True
    weight[ones["code"].to_numpy()] = ones["value"].to_numpy()
    bits = entry_filter(rows if least is None else rows.filter(_band() < least)) if others else None
    return Tree(base, state, weight, contexts, codes, values, bits)


def _found(tree: Tree, kind: int, wanted: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted codes are in the tree, looked up only where asked, and their values."""
    there, value = np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    keys = tree.codes[kind]
    if len(keys):
        asked = np.flatnonzero(where)
        at = np.minimum(np.searchsorted(keys, wanted[asked]), len(keys) - 1)
        hit = keys[at] == wanted[asked]
        there[asked[hit]] = True
        value[asked[hit]] = tree.values[kind][at[hit]]
    return there, value


def _found_behind(tree: Tree, context: np.ndarray, word: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of entries behind two words."""
    there, value = np.zeros(len(word), dtype=bool), np.zeros(len(word))
    if len(tree.contexts):
        asked = np.flatnonzero(where)
        place = np.minimum(np.searchsorted(tree.contexts, context[asked]), len(tree.contexts) - 1)
        wanted = (place << _SHIFT) | word[asked]
        there[asked], value[asked] = _found(tree, _NEXT2, wanted, tree.contexts[place] == context[asked])
    return there, value


def scored_tokens(numbers: np.ndarray, starts: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of tokens by the longest state that tasks hold, and which tokens are open:
    they may depend on the rest of the tree or do on words that are not in the dictionary."""
    two, one = _before(numbers, starts)
    known = numbers > 0
    held, held_one = np.where(numbers < len(tree.base), numbers, 0), np.where(one < len(tree.base), one, 0)
    far_one = held_one < one
    pair, context = (one << _SHIFT) | numbers, (two << _SHIFT) | one
    after_state = (tree.state[held_one] | far_one) & known
    entry, value = _found(tree, _NEXT, pair, after_state)
    shorter = np.where(entry, value, tree.weight[held_one] + tree.base[held])
    whole = (two > 0) & (one > 0)
    state, weight = _found(tree, _STATE, context, whole)
    entry2, value2 = _found_behind(tree, context, numbers, state & known)
    opened = (far_one | (held < numbers)) & ~entry
    if tree.bits is not None:
        for kind, code, word, asked in (
            (_STATE, context, None, whole & ~state), (_NEXT, pair, None, after_state & ~entry),
            (_NEXT2, context, numbers, state & known & ~entry2),
        ):
            at = np.flatnonzero(asked & ~opened)
            opened[at] = _passes(tree.bits, _entry_codes(kind, code[at], 0 if word is None else word[at]))
    return np.where(entry2, value2, weight + shorter), opened & ~entry2


def _part_of(one: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    mixed = (one * SALTS + salt).astype(np.uint64) * _MIX
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _salt(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.where(one <= HOT_WORDS, two % SALTS, 0)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Numbers of 32 bits, four to a token, compressed by their first, second, third and last bytes."""
    found = np.stack(columns).astype("<i4").view(np.uint8).reshape(-1, 4).T
    return len(columns[0]).to_bytes(4, "little") + pa.Codec("zstd").compress(found.tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    found = np.frombuffer(pa.Codec("zstd").decompress(data[4:], decompressed_size=16 * n), np.uint8)
    return np.ascontiguousarray(found.reshape(4, -1).T).view("<i4").reshape(4, n)


def scored_texts(texts: DataFrame, tree: Tree, parts: int, folder: str) -> DataFrame:
    """Numbered texts as (row, doc_id, held_out, n_tokens, n_known, base_score, score, rare, open),
    written there: sums over the tokens of each; words not in the dictionary and open tokens are still
    to be added. Rows are numbered anew. ``open`` has all open tokens of a run of texts, with the first
    of these, by the part of the tree that settles them: the numbers of the two words before and of
    the token, and how many texts after that of the token before, packed."""
    shared = texts.sparkSession.sparkContext.broadcast(tree)
    fields = [texts.schema[name] for name in ("row", "doc_id", "held_out", "n_tokens", "rare")]
    sums = [T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    opened = T.ArrayType(T.StructType([T.StructField("part", T.LongType()), T.StructField("tokens", T.BinaryType())]))
    schema = T.StructType([*fields, *sums, T.StructField("open", opened)])
    kind = pa.list_(pa.struct([("part", pa.int64()), ("tokens", pa.binary())]))

    def packed(numbers: np.ndarray, starts: np.ndarray, at: np.ndarray) -> list[dict]:
        two, one = (x[at] for x in _before(numbers, starts))
        text = np.searchsorted(starts, at, side="right") - 1
        part = _part_of(one, _salt(two, one), parts)
        order = np.argsort(part, kind="stable")
        columns = [x[order].astype(np.int32) for x in (two, one, numbers[at], text)]
        found, begin = np.unique(part[order], return_index=True)
        blobs = []
        for p, i, j in zip(found.tolist(), begin, [*begin[1:], len(at)]):
            own = [x[i:j] for x in columns]
            blobs.append({"part": p, "tokens": _packed([*own[:3], np.diff(own[3], prepend=np.int32(0))])})
        return blobs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, numbers, starts in _chunks(batch):
                values, opened = scored_tokens(numbers, starts, tree)
                at = np.flatnonzero(opened)
                values[at] = 0.0
                blobs = [packed(numbers, starts, at) if len(at) else [], *[[]] * (len(starts) - 1)]
                own = batch.slice(first, len(starts))
                columns = [pa.array(np.arange(row, row + len(starts))), *[own.column(f.name) for f in fields[1:]]]
                row += len(starts)
                held = np.where(numbers < len(tree.base), numbers, 0)
                columns += [pa.array(np.add.reduceat((held > 0).astype(np.int64), starts)),
                            pa.array(np.add.reduceat(tree.base[held], starts)),
                            pa.array(np.add.reduceat(values, starts)), pa.array(blobs, kind)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    done = stored_in(texts.mapInArrow(work, schema), folder)
    shared.destroy()
    return done


def tree_parts(model: DataFrame, parts: int, turn: int, turns: int) -> DataFrame:
    """(part, entries): the tree by the word before the last, packed, of the parts of this ``turn``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, code, word, value = (batch.column(name).to_numpy() for name in ("kind", "code", "word", "value"))
            two, one = code >> _SHIFT, code & _WORD
            alone = (kind == _ONE) | (kind == _NEXT)
            one = np.where(kind == _NEXT, two, one)
            entries = np.empty(len(kind), _ENTRY)
            for name, column in (("kind", kind), ("code", code), ("word", word), ("value", value)):
                entries[name] = column
            every = np.flatnonzero(alone & (one <= HOT_WORDS))
            others = np.flatnonzero(~(alone & (one <= HOT_WORDS)))
            at = np.concatenate([others, np.repeat(every, SALTS)])
            salt = np.concatenate([np.where(alone, 0, _salt(two, one))[others], np.tile(np.arange(SALTS), len(every))])
            part = _part_of(one[at], salt, parts)
            # a part gets what it has by several salts once
            part, at = np.unique(np.stack([part, at])[:, part % turns == turn], axis=1)
            found, begin = np.unique(part, return_index=True)
            blobs = [entries[at[i:j]].tobytes() for i, j in zip(begin, [*begin[1:], len(at)])]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], ["part", "entries"])

    return model.select("kind", "code", "word", "value").mapInArrow(work, "part long, entries binary")


def open_sums(scored: DataFrame, model: DataFrame, parts: int, steps: tuple[np.ndarray, np.ndarray], turn: int, turns: int) -> DataFrame:
    """(row, open_score): sums of the open tokens of the parts of this ``turn``. Tokens meet their part
    of the tree in one task, packed, so one shuffle settles them; what goes on are sums per text.
    ``steps`` are numbers and the logs of base probabilities from these on."""
    entries = tree_parts(model, parts, turn, turns).select("part", F.lit(-1).cast("long").alias("row"), F.col("entries").alias("data"))
    tokens = scored.filter("size(open) > 0").select("row", F.explode("open").alias("o")).filter(F.col("o.part") % turns == turn)
    both = entries.unionByName(tokens.select("o.part", "row", F.col("o.tokens").alias("data")))
    both = both.repartition("part").sortWithinPartitions("part", "row")
    numbers, bases = steps

    def settled(blobs: list[tuple[int, np.ndarray]], tree: Tree) -> pa.RecordBatch:
        two, one, word = (np.concatenate([x[i] for _, x in blobs]).astype(np.int64) for i in range(3))
        rows = np.concatenate([row + np.cumsum(x[3], dtype=np.int64) for row, x in blobs])
        context = (two << _SHIFT) | one
        entry, value = _found(tree, _NEXT, (one << _SHIFT) | word, one > 0)
        base = bases[np.searchsorted(numbers, word, side="right") - 1]
        shorter = np.where(entry, value, _found(tree, _ONE, one, one > 0)[1] + base)
        whole = (two > 0) & (one > 0)
        entry2, value2 = _found_behind(tree, context, word, whole)
        value = np.where(entry2, value2, _found(tree, _STATE, context, whole)[1] + shorter)
        found, places = np.unique(rows, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(places, weights=value))], ["row", "value"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table, tree, waiting, size = None, [], None, [], 0
        for batch in batches:
            for p, row, data in zip(batch.column("part").to_pylist(), batch.column("row").to_pylist(), batch.column("data")):
                if p != part:
                    if waiting:
                        yield settled(waiting, tree)
                    part, table, tree, waiting, size = p, [], None, [], 0
                if row < 0:
                    table.append(np.frombuffer(data.as_py(), _ENTRY))
                    continue
                if tree is None:
                    every = np.concatenate([np.empty(0, _ENTRY), *table])
                    table = []
                    tree = Tree(bases, bases, bases, *_sorted(*[every[name] for name in ("kind", "code", "word", "value")]), None)
                waiting.append((row, _unpacked(data.as_py())))
                size += waiting[-1][1].shape[1]
                if size > _CHUNK:
                    yield settled(waiting, tree)
                    waiting, size = [], 0
        if waiting:
            yield settled(waiting, tree)

    return both.mapInArrow(work, "row long, value double").groupBy("row").agg(F.sum("value").alias("open_score"))


def _base_steps(base: np.ndarray, others: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, and the logs of the base probabilities from these on. Numbers go by count, so
    there are as many steps as different counts."""
    first = np.flatnonzero(np.diff(base, prepend=np.nan))
    numbers, values = first, base[first]
    if others is not None:
        found = others.groupBy("c").agg(F.min("number").alias("number"), F.min("base").alias("base")).toArrow().sort_by("number")
        numbers = np.concatenate([numbers, found["number"].to_numpy()])
        values = np.concatenate([values, np.log10(found["base"].to_numpy())])
    return numbers, values


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    minimum: int = MINIMUM, words: int | None = None, in_tasks: int = IN_TASKS,
    words_in_tasks: int = WORDS_IN_TASKS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Null and empty texts are the end alone. Rows without id count as id ''. Repeated rows are
    trained on and scored as rows of their own. Without training rows every token is unknown; an
    empty table gives no rows. Very long texts are rows like others; texts are worked on in runs of
    bounded length, one text at least. Other columns are not read.

    The tree holds every context of one or two words that is seen ``minimum`` times and passes the
    divergence test, so it grows with the corpus. Symbols are all words seen ``minimum`` times, or the
    ``words`` most frequent of them if that is given. Tasks hold the ``words_in_tasks`` most frequent
    words and the ``in_tasks`` most frequent entries; if there are more, the others get their numbers
    by a join, and tokens that may depend on other words or entries are sent to parts of the tree;
    scores are the same. Words that tasks do not hold are summed per document and join the counts of
    the whole vocabulary. Tables are removed when nothing reads them any more.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "suffix-tree")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (remainder(id_col, FOLDS) == 0).alias("held_out"), F.col(text_col).cast("binary").alias("text")
    )
    vocabulary = stored(word_counts(rows.filter("NOT held_out").select("text")), "vocabulary")
    size = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"] or 0, size["v"]
    whole = n + ADD * (v + 1)
    symbols = vocabulary.filter(F.col("c") >= minimum)
    held = words_in_tasks if words is None else min(words, words_in_tasks)
    top = symbols.orderBy(F.col("c").desc(), "word").limit(held).toArrow()
    counts = top["c"].to_numpy().astype(np.int64)
    names = top["word"].combine_chunks()
    probability = (counts + ADD) / whole
    table = pa.table({"number": pa.array(np.arange(1, len(counts) + 1, dtype=np.int64)), "c": pa.array(counts), "base": pa.array(probability)})
    numbers = stored(spark.createDataFrame(table, "number long, c long, base double"), "word-numbers")
    last = top.slice(held - 1).to_pylist()[0] if held and len(counts) == held else {"c": None, "word": None}
    end = pc.index(names, END.decode()).as_py() + 1
    del top, table
    others = None
    if len(counts) == words_in_tasks and (words is None or words > held):
        after = (F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > last["word"])) if held else F.lit(True)
        ranked, n_others = numbered(symbols.filter(after).withColumn("down", -F.col("c")), ["down", "word"])
        if n_others:
            others = ranked.select("word", "c", (F.col("position") + held + 1).alias("number"), ((F.col("c") + ADD) / F.lit(whole)).alias("base"))
            others = stored(others if words is None else others.filter(F.col("number") <= words), "other-words")
            numbers = numbers.unionByName(others.select("number", "c", "base"))
    turns = PASSES if n > MANY_TOKENS else 1
    texts = numbered_texts(rows, names, f"{folder}/texts", None if others is None else others.select("word", "number"))
    del names
    model = grow(texts.filter("NOT held_out"), numbers, end, minimum, f"{folder}/tree", turns)
    tree = frequent_part(model, np.concatenate([[0.0], np.log10(probability)]), in_tasks)
    parts = max(PARTS, model.count() // ENTRIES_IN_PART)
    scored = scored_texts(texts, tree, parts, f"{folder}/scored")
    discard(spark, f"{folder}/texts")
    opened = None
    if tree.bits is not None or others is not None:
        steps = _base_steps(tree.base, others)
        sums = [stored_in(open_sums(scored, model, parts, steps, turn, turns), f"{folder}/open-{turn}") for turn in range(turns)]
        opened = reduce(DataFrame.unionByName, sums).groupBy("row").agg(F.sum("open_score").alias("open_score"))
    discard(spark, f"{folder}/tree")
    asked = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    # Words that tasks do not hold are seen no more often than the last that they hold.
    upto = (int(counts[-1]) if held else n) if len(counts) == held else minimum - 1
    asked = asked.join(vocabulary.filter(F.col("c") <= upto), "word", "left")
    base = F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + ADD) / F.lit(whole))
    single = F.lit(True)
    if others is not None:
        # the scores of words that are symbols come with the open tokens
        asked = asked.join(others.select("word", "number"), "word", "left")
        single = F.col("number").isNull()
    missing = asked.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(base).alias("more_base"), F.sum(F.when(single, base)).alias("more"),
    )
    result = scored.drop("rare", "open").join(stored_in(missing, f"{folder}/missing"), "row", "left")
    more = F.lit(0.0)
    if opened is not None:
        result = result.join(opened, "row", "left")
        more = F.coalesce("open_score", F.lit(0.0))
    nothing = F.lit(0.0)
    return result.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_base", nothing)).alias("base_score"),
        (F.col("score") + more + F.coalesce("more", nothing)).alias("score"),
    )
