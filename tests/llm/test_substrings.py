import hashlib
import random

import pytest

from tessera.llm import substrings
from tests.llm.helpers import DOCS, documents, odd_documents, words


def brute(rows, window=50):
    least = {}
    split = [(d, words(t)) for d, t, *_ in rows]
    key = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = " ".join(w[i : i + window])
            least[k] = min(least.get(k, float("inf")), key(d))
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[" ".join(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def check(spark, rows, **options):
    got = substrings.dedup_substrings(documents(spark, rows), **options).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got))) == sorted(map(repr, brute(rows)))
    return got


def test_odd_rows(spark):
    check(spark, odd_documents(), probes_a_part=5000)


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages_at_any_offset(spark, seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 74, 75, 120)]
    rows = []
    for d in rng.sample(range(1000), 40):
        w = some(rng.randrange(60))
        for p in rng.sample(passages, 2):
            w += p + some(rng.randrange(40))
        rows.append((d, (" ", "\n", "\t ")[d % 3].join(w) + " é" * (d % 2), "en", "a"))
    rows += [(2000 + k, " ".join(["same"] * (60 + k)), "en", "a") for k in range(4)]
    check(spark, rows, probes_a_part=300, join_bytes=100)


def test_kept_text(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(80)), "en", "a"), (2, "x  y " + " ".join(f"a{i}" for i in range(10, 70)) + " z", "en", "a")]
    got = {r.doc_id: r.kept for r in substrings.dedup_substrings(documents(spark, rows), with_text=True).collect()}
    assert got == {1: rows[0][1], 2: "x y z"}


def test_empty(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
