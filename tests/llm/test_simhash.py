import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tests.llm.helpers import DOCS, documents, odd_documents, words


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute(rows):
    prints = {}
    for d, t, *_ in rows:
        prints.setdefault(d, set()).add(fingerprint(t))
    ids = [d for d in prints if d is not None]
    label = {d: d for d in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and any(bin(x ^ y).count("1") <= 4 for x in prints[a] for y in prints[b]):
                    label[a], moved = label[b], True
    return label


def check(spark, rows, **options):
    got = simhash.simhash_groups(documents(spark, rows), **options).collect()
    label = brute(rows)
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((d or -1, f"{fingerprint(t):016x}") for d, t, *_ in rows)
    assert all(r.component_id == label.get(r.doc_id) for r in got)


def test_odd_rows(spark):
    check(spark, odd_documents())


def test_small_tiles_and_chains(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") * 2 + str(rng.randrange(50)) for _ in range(300)]
    rows = []
    for d in range(60):
        base[rng.randrange(300)] = f"x{d}"
        rows.append((d + 1, " ".join(base), "en", "a"))
    check(spark, rows, tile_rows=5)


def test_empty(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.integers(0, 64, 30).astype(np.uint64)
        x, y = simhash.forest(a, None, 1)
        label = np.arange(30)
        for _ in range(30):
            for p, q in zip(x, y, strict=True):
                label[[p, q]] = min(label[p], label[q])
        near = np.bitwise_count(a[:, None] ^ a[None]) <= 1
        assert all(label[i] == label[j] for i in range(30) for j in range(30) if near[i, j])


def test_one_of_a_group_stays(spark):
    rows = odd_documents()
    kept = simhash.drop_near_copies(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    label = brute(rows)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, *_ in rows if d is None or label[d] == d)


def similarity(a, b):
    a, b = ({tuple(words(t.lower())[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_copies_of_similarity_above_four_fifths_go(spark):
    rng = random.Random(5)
    rows, expected = [], set()
    for d in range(0, 120, 2):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), 2 + d % 8):
            other[at] = f"new{at}"
        rows += [(d, " ".join(base), "en", "a"), (d + 1, " ".join(other), "en", "a")]
        if similarity(rows[-1][1], rows[-2][1]) >= 0.8:
            expected.add(d + 1)
    near = {d for d, at in brute(rows).items() if d != at}
    assert 20 < len(expected) < 60 and len(expected - near) >= 10
    kept = {r.doc_id for r in simhash.drop_near_copies(documents(spark, rows)).collect()}
    assert kept == set(range(120)) - expected - near
