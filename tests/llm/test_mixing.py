import math
from collections import defaultdict

import pytest

from tessera.llm import mixing
from tests.llm.helpers import DOCS, documents, odd_documents, words


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(spark, rows):
    got = mixing.mix_sources(documents(spark, rows), rows_a_range=2).collect()
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted((d or -1, s or "", len(words(t))) for d, t, _, s in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, t, _, s in rows:
        sizes[s] += len(words(t))
    targets = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.mix_sources(documents(spark, rows[::-1]), rows_a_range=3).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    return got


def test_odd_rows(spark):
    check(spark, odd_documents())


def test_sources_that_stop(spark):
    check(spark, [(i, "w " * (1 if i % 7 else 40), "en", f"s{i % 7}") for i in range(90)])


def test_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert all(r.taken == 0 for r in check(spark, [(1, None, None, None), (2, " ", "en", "a")]))


def test_documents_as_the_mix_takes_them(spark):
    rows = odd_documents()
    docs = documents(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id] += r.taken
    for r in out.collect():
        taken[r.doc_id] -= len(words(r.text))
        assert r.n_chars == len(r.text)
    assert not any(taken.values())


def test_every_word_of_the_budget_is_written(spark):
    rows = [(1, "a b c d e f g", "en", "x")] * 5 + [(1, "h i j k l m n", "en", "x")] * 3 + [(None, "p q r", "en", "y")] * 9 + [(None, "p q s", None, "y"), (2, "one two", "en", None), (2, "one two", "de", None), (2, None, "en", None)]
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    for every in (rows, rows * 7):
        docs = documents(spark, every)
        written, texts = defaultdict(int), defaultdict(int)
        for r in mixing.mixed_documents(docs, rows_a_range=4).collect():
            written[r.source] += len(words(r.text))
            texts[r.text] += 1
        budgets = {s: math.floor(t) for s, t in brute_targets({s: n * len(every) // len(rows) for s, n in sizes.items()}).items()}
        assert written == {s: b for s, b in budgets.items() if b}
        check(spark, every)


def test_many_rows_of_one_id(spark):
    rows = [(7, "w " * 5, "en", "a")] * 3000 + [(k, "w " * (k % 9), "en", "ab"[k % 2]) for k in range(100)]
    check(spark, rows)
