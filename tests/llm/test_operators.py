"""The operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows, clashing columns and no rows at all."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from seatpool.llm import (
    embeddings, exact_dedup, html_text, line_dedup, mixing, packing, quality, simhash, suffix_tree, toxicity,
)
from seatpool.session import stored, stored_in

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, size long, rep long, sha string, part int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, 2, "x", 3) for i, t, g, s in rows], SCHEMA)


def sample(seed: int, n: int = 60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 90])))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", "é", None])))
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \t\n ", "en", "b"), (103, "long " * 5000, "en", "a")]
    rows += [(104, rows[3][1], "en", "a"), (105, rows[3][1].replace(" ", "\n\t"), "de", "b"), (3, rows[3][1], rows[3][2], rows[3][3])]
    rows += [(None, "no id here", "en", "a"), (None, rows[5][1], "en", "a")]
    rows += [(200 + k, rows[4][1], "en", "b") for k in range(25)]
    return rows


@pytest.fixture(params=["full", "empty"])
def rows(request):
    return sample(1) if request.param == "full" else []


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark, rows):
    found = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normalised(t), []).append(i)
    assert len(found) == len(rows)
    expected = Counter()
    for i, t, *_ in rows:
        group = groups[normalised(t)]
        keep = min((x for x in group if x is not None), default=None)
        expected[i, keep, len(group), hashlib.sha256(normalised(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = [r for r in found if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in kept)
    docs = documents(spark, rows)
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter(r.doc_id for r in kept)


def plain_fingerprint(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    rows = sample(2)
    base = " ".join(f"tok{i}" for i in range(300)).split()
    for k in range(30):
        words = list(base)
        for j in range(k % 4):
            words[17 * j + k] = f"new{k}{j}"
        rows.append((300 + k, " ".join(words), "en", "a"))
    return rows


def test_links_are_not_broadcast_however_small_the_fingerprints_look(spark):
    fps = stored(spark.range(50).select(F.xxhash64("id").alias("fp")), "few-fingerprints")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("make", [near_rows, list])
def test_near_duplicates(spark, make):
    rows = make()
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = {}
    for i, t, *_ in rows:
        if i is not None:
            prints.setdefault(plain_fingerprint(t), []).append(i)
    names = list(prints)
    root = {p: p for p in names}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(names, 2):
        if (a ^ b).bit_count() <= 4:
            root[top(a)] = top(b)
    least = {}
    for p in names:
        least[top(p)] = min([least.get(top(p), math.inf), *prints[p]])
    expected = Counter(
        (i, f"{plain_fingerprint(t):016x}", None if i is None else least[top(plain_fingerprint(t))]) for i, t, *_ in rows
    )
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    docs = documents(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, c in expected.elements() if i is None or i == c)


def test_links_find_every_pair_within_four_bits(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for bits in range(1, 7):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), bits)))
            values.add(v ^ sum(1 << b for b in rng.sample(range(32), bits)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r.x, r.y) for r in simhash.links(fps).collect()]
    expected = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(found) == len(set(found)) and set(found) == expected


def test_mix(spark, rows):
    docs = documents(spark, rows)
    found = mixing.mix(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, size(t)) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS / 2
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in found)
    pieces = mixing.mixed(docs)
    assert pieces.columns == docs.columns
    copies = Counter()
    for r in found:
        copies[r.doc_id, r.source, r.size] += r.copies + (r.part > 0 and r.part * 2 >= r.size)
    assert Counter((r.doc_id, r.source, size(r.text)) for r in pieces.collect()) == +copies


def test_mix_of_small_sources_is_true_to_the_word(spark):
    rng = random.Random(3)
    lengths = [65, 30, 130, 66, *range(1, 301, 13), 5_000]
    rows = []
    for k, n in enumerate(lengths):
        while n:
            part = min(n, rng.randint(1, 40))
            rows.append((len(rows), "w " * part, "en", f"s{k:03}"))
            n -= part
    docs = documents(spark, rows)
    found = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for k, n in enumerate(lengths):
        s = f"s{k:03}"
        # Half a block, or half of the last one, is the nearest whole blocks come.
        assert abs(taken[s] - target[s]) <= min(n, mixing.BLOCK_WORDS) / 2 + 1e-6
    assert sum(r.taken for r in found) == pytest.approx(1.5 * sum(lengths), rel=0.05)
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == +Counter({r.doc_id: r.copies + (r.part > 0 and r.part * 2 >= r.size) for r in found})
    assert max(copies.values()) <= mixing.MOST


def test_schedule_is_even_and_takes_each_block_in_turn(spark):
    sizes = [640, 64, 6_400, 1, 64_000]
    aims = spark.createDataFrame([(k, n, n * f) for k, (n, f) in enumerate(zip(sizes, (2.0, 2.0, 1.5, 1.0, 0.7)))], "source_no long, source_size long, target double")
    found = sorted(mixing.schedule(aims).collect())
    need = {r.source_no: (r.blocks, r.slots) for r in mixing.needed(aims).collect()}
    assert [r.slot for r in found] == list(range(sum(n for _, n in need.values())))
    seen = Counter()
    for i, r in enumerate(found):
        blocks, slots = need[r.source_no]
        assert (r.epoch, r.block) == divmod(seen[r.source_no], blocks)
        seen[r.source_no] += 1
        assert all(abs(seen[s] - (i + 1) * n / len(found)) <= 5 for s, (_, n) in need.items())
    assert seen == {s: n for s, (_, n) in need.items()}
    long = mixing._LONGEST
    try:
        mixing._LONGEST = 0
        assert sorted(mixing.schedule(aims).collect()) == found
    finally:
        mixing._LONGEST = long


def test_pack(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    found = packing.pack(documents(spark, rows), PATH, size=64).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        start, piece = 0, 0
        while start < len(ids):
            stop = start + ((len(ids) - start) % 64 or 64)
            expected[i, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start, piece = stop, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= math.ceil(sum(r.length for r in found) / 64) * 1.1


def test_plan_fills_sequences_and_places_every_piece():
    rng = random.Random(3)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20000)]
    histogram = Counter(lengths)
    plan = packing.plan(histogram)
    assert plan.sequences <= 1.01 * math.ceil(sum(lengths) / 2048)
    ranks = Counter()
    used = Counter()
    for length in lengths:
        wanted = length * packing._RANKS + ranks[length]
        ranks[length] += 1
        at = int(np.searchsorted(plan.key, wanted, side="right")) - 1
        used[int(plan.base[at] + wanted - plan.key[at])] += length
    assert max(used.values()) <= 2048 and len(used) == plan.sequences


@pytest.mark.parametrize(
    ("histogram", "fewest"),
    [
        ({500: 12_000, 700: 12_000, 848: 12_000}, 12_000),
        ({900: 12_000, 600: 12_000, 540: 12_000}, 12_000),
        ({512: 5_000, 1024: 3_000, 1536: 4_000}, 5_750),
        ({700: 9_000, 300: 1_000, 1000: 500}, 4_750),
        ({1500: 3_000, 500: 3_000, 30: 3_000}, 3_000),
        ({1300: 1_000}, 1_000),
        ({2048: 7, 1: 2_048}, 8),
        ({}, 0),
    ],
)
def test_plan_of_few_lengths_comes_near_the_fewest_sequences(histogram, fewest):
    plan = packing.plan(histogram)
    assert fewest <= plan.sequences <= 1.01 * fewest


def test_patterns_are_all_that_fill_and_hold_every_length():
    present = np.array([3, 4, 5, 7, 9, 12])
    rows = {tuple(r) for r in packing.patterns(present, 16, 2).tolist()}
    for i, j, k in itertools.combinations_with_replacement(present.tolist(), 3):
        longest = max((v for v in present if v <= 16 - i - j), default=0)
        assert ((i, j, k) in rows) == (k == longest and i + j + k >= 14)
    assert all(14 <= sum(r) <= 16 for r in rows)
    several = [{tuple(r) for r in packing.patterns(present, 16, 2, phase, 4).tolist()} for phase in range(6)]
    assert set.union(*several) == rows


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    encode, _ = packing.encoder(PATH)
    rng = random.Random(9)
    points = [c for c in range(0x2B0) if c]
    texts = ["".join(map(chr, points)), *(f"a{chr(c)}b {chr(c)} {chr(c)}c  {chr(c)}" for c in points)]
    texts += ["".join(rng.choices(" \n\tabcé'1,. \x1c\x85", k=40)) for _ in range(500)]
    texts += ["<|endoftext|> x", "日本語 text ñ", "a  b", "don't we'll  x", " lead", "trail ", "a \n b"]
    for text in texts:
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries, over symbols after ``order - 1`` starts."""
    counts = {order: Counter()}
    for t in texts:
        s = [0] * (order - 1) + t
        counts[order].update(tuple(s[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        discounts[k] = [0] + [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / max(n[i], 1))) for i in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        k = len(g)
        after = [(h, c) for h, c in counts[k].items() if h[:-1] == g[:-1]]
        total = sum(c for _, c in after)
        if not total:
            return p(g[1:])
        d = discounts[k]
        weight = sum(d[min(c, 3)] for _, c in after) / total
        c = counts[k][g]
        return max(c - d[min(c, 3)], 0) / total + weight * p(g[1:])

    return p


def test_language_model_against_dictionaries(spark):
    trusted = ["abab abac", "abc abc cab", "bacab"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(trusted)] + [(9, "abcx cab", "en", "a"), (10, "bab", None, None)])
    ids = spark.createDataFrame([(i,) for i in range(3)], "doc_id long")
    found = {r.doc_id: r for r in quality.perplexities(docs, ids, order=3).collect()}
    points = Counter("".join(trusted))
    symbols = {c: k + 1 for k, c in enumerate(sorted(points, key=lambda c: (-points[c], c)))}
    p = plain_model([[symbols[c] for c in t] for t in trusted], 3)
    for i, text in [(0, trusted[0]), (9, "abcx cab"), (10, "bab")]:
        s = [0, 0] + [symbols.get(c, 255) for c in text]
        expected = sum(math.log10(p(tuple(s[j : j + 3]))) for j in range(len(text)))
        assert found[i].log10_sum == pytest.approx(expected, abs=1e-3)
        assert found[i].n_symbols == len(text)


def test_classify_keeps_trusted_and_rejects_junk(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", "and", "ran"], k=40)) for _ in range(60)]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean)]
    rows += [(100, "ZQ## " * 30, "en", "a"), (101, None, "en", "a"), (102, "", None, None), (None, clean[0], "xx", "a"), (0, clean[0], "en", "a")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(None, 1, 1), (51, None, None), (100, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(documents(spark, rows), labels).collect()
    assert len(found) == len(rows)
    kept = Counter((r.doc_id, r.kept) for r in found)
    assert kept[100, False] == 1 and kept[101, True] == 1 and kept[102, True] == 1 and kept[0, True] == 2 and kept[None, True] == 1
    docs = documents(spark, rows)
    assert Counter(r.doc_id for r in quality.accepted(docs, labels).collect()) == Counter(r.doc_id for r in found if r.kept)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert all(r.kept and r.perplexity is None for r in none) and len(none) == len(rows)
    assert quality.classify(docs.limit(0), labels).collect() == []


def plain_segments(values):
    """The maximal scoring subsequences by their recursive definition."""
    best, place = 0.0, None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > best + 1e-12:
                best, place = total, (i, j + 1)
    if place is None:
        return []
    i, j = place
    right = [(s, a + j, b + j) for s, a, b in plain_segments(values[j:])]
    return [*plain_segments(values[:i]), (best, i, j), *right]


def test_segments_against_the_definition():
    rng = random.Random(8)
    for _ in range(300):
        tokens = [f"t{rng.randrange(30)}" for _ in range(rng.randrange(0, 25))]
        tokens = [t for i, t in enumerate(tokens) if not i or t != tokens[i - 1]]
        odds = {f"t{i}": rng.choice([0.0, 0.0, 0.31, 1.7, 3.3, -2.1]) for i in range(30)}
        scores = toxicity._Scores(odds)
        _, found = toxicity.scan(" ".join(tokens), scores)
        expected = plain_segments([odds[t] - toxicity.NEUTRAL for t in tokens])
        assert [(round(s, 6), a, b) for s, a, b in found] == [(round(s, 6), a, b) for s, a, b in expected]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        tokens = rng.choices(words, k=80)
        toxic = int(rng.random() < 0.2)
        for _ in range(4 * toxic):
            tokens[rng.randrange(80)] = rng.choice(["grot", "vile", "scumble"])
        rows.append((i, " ".join(tokens), "en", "a"))
        labels.append((i, 1, toxic))
    rows += [(1000, None, None, None), (1001, "", "en", "a"), (None, "vile grot vile", "en", "a"), (5, rows[5][1], "en", "a")]
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score(documents(spark, rows), marks).collect()
    assert len(found) == len(rows)
    truth = dict((i, x) for i, _, x in labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in found if r.doc_id in (1000, 1001))
    untaught = toxicity.score(documents(spark, rows), marks.limit(0)).collect()
    assert all(r.score == 0 for r in untaught) and len(untaught) == len(rows)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))
    vectors = [(i, (centres[i % 8] + rng.normal(scale=0.25, size=12)).tolist()) for i in range(150)]
    vectors += [(500 + k, vectors[0][1]) for k in range(7)] + [(600, vectors[9][1])]
    bad = [(700, None), (701, []), (702, [0.0] * 12), (703, [float("nan")] * 12), (704, [None] + [1.0] * 11), (705, [1.0, 2.0]), (706, [float("inf")] + [1.0] * 11)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + bad], "vec_id long, embedding array<float>, rep long, tile int")
    found = {r.vec_id: r for r in embeddings.near_duplicates(table, tile=16).collect()}
    x = np.array([v for _, v in vectors], dtype=np.float32).astype(float)
    ids = [i for i, _ in vectors]
    cosine = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = cosine >= 0.9
    np.fill_diagonal(link, False)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(link)):
            low = min(label[ids[a]], label[ids[b]])
            for n in (ids[a], ids[b]):
                if label[n] != low:
                    label[n], changed = low, True
    for k, i in enumerate(ids):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (link[k].sum(), label[i], label[i] == i)
    for i, _ in bad:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert embeddings.near_duplicates(table.limit(0)).collect() == []


def test_embeddings_of_every_length_link(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=12).tolist()) for i in range(40)]
    small = rng.normal(size=5)
    # Near ones and copies of a length that is not the commonest, an id that has both lengths, copies alone.
    vectors += [(50 + k, (small + 0.01 * k).tolist()) for k in range(4)] + [(60, small.tolist()), (3, (small + 0.05).tolist())]
    vectors += [(70, vectors[0][1]), (80, [1.0, 2.0]), (81, [1.0, 2.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table, tile=16).collect())
    expected = Counter((i, 0, i, True) for i in range(1, 40))
    expected.update([(0, 1, 0, True), (70, 1, 0, False), (80, 1, 80, True), (81, 1, 80, False), (3, 5, 3, True)])
    expected.update((i, 5, 3, False) for i in (50, 51, 52, 53, 60))
    assert found == expected


def test_suffix_tree(spark, rows):
    found = suffix_tree.score(documents(spark, rows)).collect()
    tokens = lambda t: [*WORDS.findall((t or "").lower()), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t, *_ in rows:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        expected[i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == expected
    assert all(r.score <= 0 for r in found)


def plain_tree(texts, minimum, words):
    """Token counts, and per context that is a state: total, left weight, probabilities stored."""
    counts = Counter(w for text in texts for w in text)
    n, v = sum(counts.values()), len(counts)
    base = lambda w: (counts[w] + 0.1) / (n + 0.1 * (v + 1))
    ranked = sorted((w for w in counts if counts[w] >= minimum), key=lambda w: (-counts[w], w))
    symbols, tree = set(ranked[:words]), {}

    def probability(context, w):
        if not context:
            return base(w)
        if context not in tree:
            return probability(context[1:], w)
        left, stored_here = tree[context]
        return stored_here.get(w) or left * probability(context[1:], w)

    for depth in (1, 2):
        behind = {}
        for text in texts:
            for i in range(depth, len(text)):
                gram = tuple(text[i - depth : i + 1])
                if set(gram) <= symbols:
                    behind.setdefault(gram[:-1], Counter())[gram[-1]] += 1
        total = Counter(tuple(text[i : i + depth]) for text in texts for i in range(len(text)) if i + depth <= len(text))
        found = {}
        for context, follow in behind.items():
            follow = {w: c for w, c in follow.items() if c >= minimum}
            if not follow:
                continue
            t = total[context]
            left = (5 + t - sum(follow.values())) / (t + 5)
            q = {w: probability(context[1:], w) for w in follow}
            p = {w: c / (t + 5) + left * q[w] for w, c in follow.items()}
            rest_p, rest_q = max(1 - sum(p.values()), 1e-12), max(1 - sum(q.values()), 1e-12)
            gain = sum(c * math.log(p[w] / q[w]) for w, c in follow.items()) + t * rest_p * math.log(rest_p / rest_q)
            if gain > 0.5 * math.log(max(t, 2)) * len(follow):
                found[context] = (left, p)
        tree.update(found)
    return tree, probability


def chained(seed, n=150):
    """Texts in which words depend on the two before, with copies, rare words and empty ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["a", "b"]
        for _ in range(rng.choice([3, 20, 60])):
            likely = "abcdefgh"[(ord(words[-1][0]) * 3 + ord(words[-2][0]) * 5) % 8]
            words.append(likely if rng.random() < 0.7 else rng.choice([*"abcdefgh", f"rare{rng.randrange(60)}"]))
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else "\n".join(words), "en", "a"))
    return [*rows, (500, None, None, None), (501, "", "en", "a"), (None, "a b c", "en", "a"), *[(600 + k, rows[1][1], "en", "b") for k in range(30)]]


@pytest.mark.parametrize("minimum, words, in_tasks", [(5, 1000, 10**6), (5, 1000, 0), (5, 1000, 25), (8, 6, 10), (10**6, 5, 5)])
def test_suffix_tree_scores_against_dictionaries(spark, minimum, words, in_tasks):
    rows = chained(3)
    tokens = lambda t: [*WORDS.findall((t or "").lower()), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tree, probability = plain_tree([tokens(t) for i, t, *_ in rows if not held(i)], minimum, words)
    if minimum < 10**6:
        assert {len(context) for context in tree} == {1, 2}
    expected = Counter()
    for i, t, *_ in rows:
        text = tokens(t)
        total = sum(math.log10(probability(tuple(text[max(0, k - 2) : k]), text[k])) for k in range(len(text)))
        expected[i, round(total, 5)] += 1
    found = suffix_tree.score(documents(spark, rows), minimum=minimum, words=words, in_tasks=in_tasks).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in found) == expected


@pytest.mark.parametrize("words_in_tasks, in_tasks", [(4, 10**6), (4, 0), (4, 25), (0, 25)])
def test_suffix_tree_scores_words_beyond_those_of_the_dictionary(spark, words_in_tasks, in_tasks):
    rows = chained(5)
    tokens = lambda t: [*WORDS.findall((t or "").lower()), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    training = [tokens(t) for i, t, *_ in rows if not held(i)]
    tree, probability = plain_tree(training, 5, 10**6)
    counts = Counter(w for text in training for w in text)
    n, v = sum(counts.values()), len(counts)
    symbols = sorted((w for w in counts if counts[w] >= 5), key=lambda w: (-counts[w], w))
    beyond = set(symbols[words_in_tasks:])
    assert any(beyond & set(context) for context in tree) and any(beyond & set(p) for _, p in tree.values())
    expected = Counter()
    for i, t, *_ in rows:
        text = tokens(t)
        total = sum(math.log10(probability(tuple(text[max(0, k - 2) : k]), text[k])) for k in range(len(text)))
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in text)
        expected[i, sum(counts[w] > 0 for w in text), round(base, 5), round(total, 5)] += 1
    found = suffix_tree.score(documents(spark, rows), minimum=5, in_tasks=in_tasks, words_in_tasks=words_in_tasks).collect()
    assert Counter((r.doc_id, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in found) == expected


def test_open_tokens_are_shuffled_once_and_packed(spark, monkeypatch):
    """Tokens that tasks cannot settle go out as one row per part and run of texts, and come back as sums."""
    frames, rows = {}, chained(3)

    def watched(df, folder):
        name = folder.rsplit("/", 1)[1]
        frames[name] = df._jdf.queryExecution().executedPlan().toString()
        done = stored_in(df, folder)
        if name == "scored":
            frames["open"] = done.select(F.explode("open").alias("o")).count()
        return done

    monkeypatch.setattr(suffix_tree, "stored_in", watched)
    monkeypatch.setattr(suffix_tree, "MANY_TOKENS", 0)
    n_tokens = sum(r.n_tokens for r in suffix_tree.score(documents(spark, rows), minimum=5, words=1000, in_tasks=0).collect())
    plans = [frames[f"open-{turn}"] for turn in range(suffix_tree.PASSES)]
    assert all("Join" not in plan and plan.count("Exchange hashpartitioning") == 2 for plan in plans)
    assert 0 < frames["open"] <= suffix_tree.PARTS * 4 < n_tokens


def test_packed_tokens_come_back(spark):
    columns = [np.array(x, dtype=np.int32) for x in ([0, 1, 2**31 - 1], [5, 6, 7], [0, 255, 256], [0, 3, 0])]
    assert (suffix_tree._unpacked(suffix_tree._packed(columns)) == np.stack(columns)).all()


def test_suffix_tree_distributions_sum_to_one(spark):
    texts = [[*"abcab"], [*"abd"], [*"cab"]] * 20
    tree, probability = plain_tree([[*t, "\n"] for t in texts], 5, 100)
    base = 0.1 / (sum(len(t) + 1 for t in texts) + 0.1 * 6)
    for context in ((), ("a",), ("a", "b"), ("c", "a"), ("d",)):
        assert sum(probability(context, w) for w in [*"abcd", "\n"]) + probability(context, "unseen") == pytest.approx(1, abs=1e-6)
    assert base == pytest.approx(probability((), "unseen"))


def test_suffix_tree_grows_with_the_corpus(spark):
    """Contexts seen often enough stay however large a share of the corpus others are."""
    rare = [(i, "rare pair here again", "en", "a") for i in range(40)]
    common = [(1000 + i, "some quite common words " * 200, "en", "a") for i in range(60)]
    found = {r.doc_id: r for r in suffix_tree.score(documents(spark, rare + common)).collect()}
    assert all(found[i].score > found[i].base_score + 5 for i in range(40))


def plain_cut(costs, edges):
    best = None
    for labels in itertools.product([False, True], repeat=len(costs)):
        cost = sum(abs(c) for c, x in zip(costs, labels) if (c > 0) != x) + sum(w for a, b, w in edges if labels[a] != labels[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(0, n - 1, rng.uniform(0, 1))] * (n > 2)
        labels = html_text.minimum_cut(costs, edges)
        cost = sum(abs(c) for c, x in zip(costs, labels) if (c > 0) != x) + sum(w for a, b, w in edges if labels[a] != labels[b])
        assert cost == pytest.approx(plain_cut(costs, edges))


def test_main_text(spark):
    page = (
        "<html><head><title>No</title><script>var t='</p>';</script></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href='/a'>Menu</a><li><a href='/b'>More</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies, as everybody does, and you agree to this.</div>"
        "<article><h1>A title</h1><p>First &amp; foremost,\n a  <b>sentence</b> of text.<p>Short.</p>"
        "<div class=ad>Buy things now, they are cheap today.</div><p>Last one here, with <a href=x>a link</a> in it.</p>"
        "<section id='comments'><p>I do not agree with any of this text at all.</p></section></article>"
        "<form><label>Name</label><input></form><aside>Related things to read.</aside><footer>&copy; site</footer></body><p cut"
    )
    table = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "y"), (3, "u", "", "z"), (1, "u", page, "x"), (4, "u", "<p>" + "word " * 200000, "w")], "page_id long, url string, html string, text string")
    found = html_text.extract(table).collect()
    expected = "A title\n\nFirst & foremost, a sentence of text.\n\nShort.\n\nLast one here, with a link in it."
    assert [r.text for r in found if r.page_id == 1] == [expected] * 2
    assert [(r.text, r.n_chars) for r in found if r.page_id in (2, 3)] == [("", 0)] * 2
    assert [r.n_chars for r in found if r.page_id == 4] == [len(("word " * 200000).strip())]
    assert html_text.extract(table.limit(0)).collect() == []


def test_site_lines(spark):
    pages = [(i, f"http://{'a' if i % 3 else 'b'}.example/x", f"<p>Menu</p><div>Text {i}<br>more &amp; {i}</div>" + "<p>Menu</p>" * (i % 2)) for i in range(30)]
    pages += [(50, None, "<p>Menu</p>"), (51, "http://a.example", None), (52, "http://A.example:80/", ""), (1, pages[1][1], pages[1][2])]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    found = line_dedup.site_lines(table, ratio=0.5).collect()
    assert len(found) == len(pages)
    for r in found:
        if r.page_id < 30:
            own = f"Text {r.page_id}\nmore &amp; {r.page_id}"
            assert r.text == own and r.n_dropped == 1 + r.page_id % 2 and r.host_pages == (10 if r.host == "b.example" else 23)
    assert [(r.host, r.text) for r in found if r.page_id == 50] == [("", "Menu")]
    assert [(r.host, r.n_lines) for r in found if r.page_id in (51, 52)] == [("a.example", 0)] * 2
    assert line_dedup.site_lines(table.limit(0)).collect() == []


def test_site_lines_goes_by_the_share_alone(spark):
    site = lambda host, n, often: [(host, f"<p>own {i}</p>" + "<p>Line</p>" * (i < often)) for i in range(n)]
    sites = {"one": (1, 1, False), "two": (2, 2, True), "small": (15, 3, True), "middle": (30, 3, False), "large": (200, 5, False), "larger": (200, 21, True)}
    pages = [page for host, (n, often, _) in sites.items() for page in site(host, n, often)]
    table = spark.createDataFrame([(i, f"http://{h}/", html) for i, (h, html) in enumerate(pages)], "page_id long, url string, html string")
    dropped = Counter()
    for r in line_dedup.site_lines(table).collect():
        dropped[r.host] += r.n_dropped
    assert dropped == Counter({host: often if gone else 0 for host, (_, often, gone) in sites.items()})


def test_site_lines_and_mix_are_native(spark, capsys):
    docs = documents(spark, sample(1))
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
    for frame in (mixing.mix(docs), mixing.mixed(docs), line_dedup.site_lines(pages)):
        frame.explain("formatted")
        text = capsys.readouterr().out
        assert not re.search("EvalPython|InPandas|InArrow|CartesianProduct|NestedLoop", text)


def test_main_text_past_elements_that_look_like_hidden_ones():
    said = " Words that make a sentence of some length, and then a few more of them to be sure."
    custom = html_text.main_text(f'<article><p>A{said}</p><video-player src="x"></video-player><p>B{said}</p></article>')
    assert custom == f"A{said}\n\nB{said}"
    icon = html_text.main_text(f'<article><p>A{said} <svg id="i"/></p><p>B{said}</p><svg><path d="1>2"/></svg><p>C{said}</p></article>')
    assert icon == f"A{said}\n\nB{said}\n\nC{said}"
    script = html_text.main_text(f'<article><p>A{said}</p><script data-a="x>y">var a = "<p>no</p>"</script><p>B{said}</p>')
    assert script == f"A{said}\n\nB{said}"


def test_mixed_shuffles_texts_once_before_their_order(spark):
    docs = documents(spark, sample(4)).repartition(3).localCheckpoint()
    lines = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [re.search("[A-Za-z]", line).start() if re.search("[A-Za-z]", line) else 0 for line in lines]
    at = next(i for i, line in enumerate(lines) if "named_struct(doc_id" in line or "struct(doc_id" in line and "AS doc" in line)
    above, upto = [], depth[at]
    for i in range(at, -1, -1):
        if depth[i] < upto:
            upto = depth[i]
            above.append(lines[i])
    assert sum("Exchange" in line for line in above) == 2


def test_mixed_shuffles_texts_once_before_their_order_in_shuffled_joins(spark):
    docs = documents(spark, sample(4)).repartition(3).localCheckpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # by key for the numbers and for the choices, and by slot
    assert any("SortMergeJoin" in line or "ShuffledHashJoin" in line for line in lines)
    assert sum("Exchange" in line for line in lines) == 3


def test_stored_leaves_no_shuffle_files(spark):
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    place = spark._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        files = place.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    known = shuffles()
    found = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if shuffles() <= known:
            break
        time.sleep(0.1)
    assert shuffles() <= known
    assert sorted(r["count"] for r in found.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before


def test_quality_is_trained_on_all_trusted_text(spark):
    rows = [(i, f"{chr(0x430 + i)}bcd " * 120_000, "en", "a") for i in range(8)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    found = quality.classify(documents(spark, rows), labels).collect()
    assert len(found) == 8 and all(r.perplexity < 2 for r in found)


def test_quality_counts_long_texts_in_pieces_and_reads_texts_once(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcé", k=k)) for k in (1_200_000, 3, 40, 1)]
    tables = {"en": {ord(c): i + 1 for i, c in enumerate("abc")}}
    expected = Counter()
    for text in texts:
        symbols = np.array([tables["en"].get(ord(c), 255) for c in text], dtype=np.uint8)
        expected.update(quality._grams(symbols, 3).tolist())
    reads = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    sample = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").mapInArrow(counting, "lang string, text string")
    assert {r.gram: r.n for r in quality.counts(sample, tables, 3).collect()} == expected
    before = reads.value
    assert quality.model(quality.counts(sample, tables, 3), 3).count() > 0
    assert reads.value - before == len(texts)
    points = {r.point: r.symbol for r in quality.alphabet(sample).collect()}
    assert set(points) == set(map(ord, "abcé")) and set(points.values()) == {1, 2, 3, 4}


def test_the_model_is_collected_without_an_object_per_gram():
    n = 200_000
    rng = np.random.default_rng(3)
    langs, lengths = np.array(["de", "", "en"])[rng.integers(0, 3, n)], rng.integers(-2, 3, n)
    grams, values = rng.permutation(n).astype(np.int64), rng.random(n).astype(np.float32)

    class Rows:
        def toArrow(self):
            return pa.table({"lang": pa.array(langs, pa.string()), "k": pa.array(lengths, pa.int32()), "gram": grams, "value": values})

    tracemalloc.start()
    found = quality._collected(Rows())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(found) == ["", "de", "en"]
    for lang, by_length in found.items():
        for k, (keys, logs) in by_length.items():
            own = (langs == lang) & (lengths == k)
            assert list(zip(keys.tolist(), logs.tolist())) == sorted(zip(grams[own].tolist(), values[own].tolist()))
    assert peak < 60 * n


def test_tables_that_grow_are_merged_however_small_their_files_are(spark, monkeypatch):
    plans = {}

    def watched(df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, purpose)

    monkeypatch.setattr(quality, "stored", watched)
    texts = spark.createDataFrame([("en", "abc abd"), ("de", "cab")], "lang string, text string")
    tables = {lang: {ord(c): i + 1 for i, c in enumerate("abcd ")} for lang in ("en", "de")}
    quality.model(quality.counts(texts, tables, 3), 3)
    for k in (2, 3):
        assert plans[f"probabilities-{k}"].count("SortMergeJoin") == 2 and "Broadcast" not in plans[f"probabilities-{k}"]
    docs = documents(spark, sample(4))
    for frame in (mixing.mixed(docs), simhash.near_duplicates(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
