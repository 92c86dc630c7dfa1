"""Vector codes, quality rules and phrases against brute force, on small tables with nulls, empty
and long rows, ties, repeated rows, clashing columns and no rows at all."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from seatpool.llm import phrases, quality_rules, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, row string, size int, entry int, part string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", 1, 2, "y") for i, v, g in rows], VECTORS)


def coded(rows, parts=16, entries=64, rounds=2):
    """One vector, entry and component at a time, in Python's integers."""
    kept = [(i, v, g) for i, v, g in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    found = Counter()
    for size in {len(v) for _, v, _ in kept}:
        own = sorted(((i, v, g) for i, v, g in kept if len(v) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        width = size // parts
        ints = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in own]
        cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
        books = [[v[p] for v in cut[:entries]] for p in range(parts)]

        def nearest(p, part):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            near = [[nearest(p, v[p])[1] for p in range(parts)] for v in cut]
            for p in range(parts):
                for k in range(len(books[p])):
                    members = [v[p] for v, n in zip(cut, near) if n[p] == k]
                    if members:
                        books[p][k] = [sum(c) // len(members) for c in zip(*members)]
        sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for (i, _, g), v in zip(own, cut):
            at = [nearest(p, v[p]) for p in range(parts)]
            found[i, g, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at), sha] += 1
    labels = Counter()
    for (_, g, _, error, _), n in found.items():
        labels[g] += n * error
    return Counter({(i, code, error, labels[g], sha): n for (i, g, code, error, sha), n in found.items()})


def some_vectors(seed, n=150, size=32):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(size)], rng.choice([0, 1, None])) for i in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v], g) for i, v, g in rows]
    rows += [(1000 + i, rows[5][1], 1) for i in range(80)] + [rows[3], (None, rows[4][1], 2), (None, rows[9][1], None)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 31 + [None], 0), (2003, [float("nan")] * 32, 1), (2004, [0.5] * 15, 1)]
    rows += [(2005, [0.0] * size, 7), (2006, [1e6] * size, 7), (2007, [float(np.float32(3e12))] * size, 7), (2008, [0.25] * 16, 8)]
    return rows


def answers(frame):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in frame.collect())


@pytest.mark.parametrize("entries, rounds", [(64, 2), (5, 4), (300, 1)])
def test_vector_codes(spark, entries, rounds):
    rows = some_vectors(1)
    found = vector_codes.compress(vectors(spark, rows), entries=min(entries, 256), rounds=rounds)
    assert answers(found) == coded(rows, entries=min(entries, 256), rounds=rounds)


def test_vector_codes_of_an_outlying_entry(spark):
    # an entry beyond exact doubles, and a component beyond 64-bit integers
    rows = [(0, [float(np.float32(5e7))] * 16, 0), (1, [0.5] * 16, 0), (2, [0.75] * 16, 1), (3, [-0.3] * 16, 1)]
    assert answers(vector_codes.compress(vectors(spark, rows))) == coded(rows)
    huge = [(9, [3e38] * 16, 0), (10, [0.5] * 16, 0)]
    found = {r.vec_id: (r.code, r.error) for r in vector_codes.compress(vectors(spark, huge)).collect()}
    assert found == {9: ("00" * 16, 0), 10: ("01" * 16, 0)}


def test_vector_codes_of_nothing(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).collect() == []


def test_owners_split_a_hot_entry(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "OWNED", 3)
    rows = some_vectors(2, 40)
    assert answers(vector_codes.compress(vectors(spark, rows))) == coded(rows)


# ---------------------------------------------------------------- quality rules

DOCS = "doc_id long, text string, lang string, n_words int, rule string, quality int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", 5) for i, t in rows], DOCS)


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def some_texts(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é x", "日本", "A", "SHOUT"]
    rows, quality = [], []
    for i in range(n):
        good = rng.random() < 0.7
        own = rng.choices(words, k=rng.choice([5, 30, 60, 200]))
        if not good:
            own = [w + rng.choice("#$%&*") for w in own]
        text = "".join(w + rng.choice([" ", "\n", "\t", "  ", "\n\n"]) for w in own)
        rows.append((i, text))
        quality.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t\v"), (1003, "a " * 60), (1004, "same line of words\n" * 30), (1005, "x" * 50_000)]
    rows += [(1006, " ".join(rng.choices(words, k=60_000))), (1007, ("one two three four five six seven eight " * 2) + " ".join(words))]
    rows += [rows[2], (None, rows[3][1]), (3, "other text under a known id " * 9)]
    return rows, quality


def test_quality_rules(spark):
    rows, quality = some_texts(1)
    labels = quality + [(None, 0), (7, None), (8, 0), (8, 1)]
    found = quality_rules.classify(texts(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    answer = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter((r.doc_id, *answer(r)) for r in found) == Counter((i, *base(t)) for i, t in rows)
    marked = dict(quality)
    judged = [(r.kept, marked[r.doc_id]) for r in found if not r.base_failed and r.doc_id in marked]
    assert sum(kept == bool(good) for kept, good in judged) >= 0.98 * len(judged)
    assert all(not r.kept and r.rule == 0 for r in found if r.base_failed)
    assert all((r.rule is None) == r.kept for r in found)


def test_quality_rules_without_labels(spark):
    rows, _ = some_texts(2, 30)
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_rules.classify(texts(spark, rows), none).collect()
    assert len(found) == len(rows) and all(r.kept != r.base_failed for r in found)
    assert quality_rules.classify(texts(spark, []), none).collect() == []


def test_rules_apply_in_order_and_only_where_they_hold(spark):
    rng = np.random.default_rng(0)
    values = {k: rng.random(3000) for k in ("words", "word_length", "upper_word_share")}
    bad = ((values["words"] > 0.8) & (values["word_length"] < 0.4)) | (values["upper_word_share"] > 0.9)
    rules = quality_rules.learned(values, bad)
    covered = np.zeros(3000, bool)
    for rule in rules:
        covered |= np.logical_and.reduce([c.holds(values) for c in rule])
    assert (covered & ~bad).mean() < 0.01 and (covered & bad).sum() > 0.85 * bad.sum()
    # nothing to learn from noise
    assert quality_rules.learned(values, rng.random(3000) < 0.1) == []


# ---------------------------------------------------------------- phrases


def mined(rows, least, top=2000):
    pieces = {}
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        pieces.setdefault(lang if lang is not None else "und", []).extend(
            re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low))
    result = []
    for lang, own in pieces.items():
        f = Counter(tuple(p[i : i + k]) for p in own for k in range(1, 6) for i in range(len(p) - k + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        covered = {}
        for w, a in candidates.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    covered[w[i : i + k]] = max(a, covered.get(w[i : i + k], 0))
        scored = []
        for w, a in candidates.items():
            if covered.get(w, 0) >= a:
                continue
            score, k = min((1000 * a * n // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            scored.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(result)


def some_phrases(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["The", "É", "日本", "a b", "x\x00y", "\x1cz"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "!\r\n", " ; "]) for _ in range(rng.choice([1, 3, 40, 90])))
        rows.append((text, rng.choice(["en", "en", "de", None])))
    rows += [("new york city hall", "en")] * 40 + [("hot hot " * 300, "en"), (None, "en"), ("", "fr"), (" . , ", "fr"), ("only", "it")]
    rows += [(" ".join(rng.choices(words, k=4000)), "de"), ("w1 w2 " * 50, "und")]
    return rows


def listed(spark, rows, **options):
    table = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, word string")
    return sorted(tuple(r) for r in phrases.phrases(table, **options).collect())


@pytest.mark.parametrize(
    "options",
    [{}, {"hot": 60, "bucket": 200}, {"hot": 5, "bucket": 50}, {"known": 3}, {"known": 0, "hot": 30}, {"top": 4}],
    ids=str,
)
def test_phrases(spark, options):
    rows = some_phrases(3)
    assert listed(spark, rows, least=6, **options) == mined(rows, 6, options.get("top", 2000))


def test_suffixes_by_chunks(monkeypatch):
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 0, 8, 9, 0, 10, 0, 1, 2], np.int64)
    whole = np.concatenate(list(phrases.suffixes(ids, 5)))
    monkeypatch.setattr(phrases, "CHUNK", 4)
    assert (np.concatenate(list(phrases.suffixes(ids, 5))) == whole).all()
    assert whole.tolist()[:4] == [[1, 2, 3, 4, 5], [2, 3, 4, 5, 6], [3, 4, 5, 6, 7], [4, 5, 6, 7, 0]]


def test_words_that_share_a_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = some_phrases(5)
    own = phrases._hashed
    monkeypatch.setattr(phrases, "_hashed", lambda word: own(F.when(word.isin("w10", "w11", "the"), "w10").otherwise(word)))
    assert listed(spark, rows, least=6, known=1) == mined(rows, 6)


def test_multikey_counts_equal_counting():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 5, (3000, 4)) * (rng.random((3000, 4)) < 0.9)
    keys = np.where(np.logical_and.accumulate(keys != 0, axis=1), keys, 0)
    weights = rng.integers(1, 4, 3000)
    counted = Counter()
    for row, weight in zip(keys.tolist(), weights.tolist()):
        for k in range(1, 5):
            if row[k - 1]:
                counted[tuple(row[:k])] += weight
    row, depth, n = phrases.multikey_counts(keys, weights, 20)
    found = {tuple(keys[r, :d].tolist()): c for r, d, c in zip(row, depth, n.tolist())}
    assert found == {k: c for k, c in counted.items() if c >= 20} and len(found) == len(row)


def test_phrases_of_nothing(spark):
    assert listed(spark, []) == [] and listed(spark, [(None, None)]) == []
