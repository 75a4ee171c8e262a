import math

import numpy as np
import pytest

from tessera.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, block int, rank int"


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, [math.floor(1024 * float(np.float32(x))) for x in v])
    for q in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)  # noqa: B905
            yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]))


def check(spark, rows, every=100, k=10, **options):
    table = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)
    got = topk.top_products(table, every=every, k=k, **options).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(brute(rows, every, k))


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [float("nan"), 1.0]), (400, [None, 1.0]), (500, [1.0]), (600, []), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.0, 0.5, 7.0]), (700, [-1e9, 1e9])]
    check(spark, rows)
    check(spark, rows, rows_a_block=3, queries_a_block=2, k=3)


def test_ties_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, (rng.integers(-3, 4, 6) / 2).tolist()) for i in range(400)], every=20, rows_a_block=60, queries_a_block=7)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, [1.0])])


def test_threshold_algorithm_against_all_rows():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, width = int(rng.integers(1, 300)), int(rng.integers(1, 8))
        m = rng.integers(-6, 7, (n, width))
        ids, q = rng.permutation(n) * 3, rng.integers(-6, 7, width)
        order = np.argsort(m, axis=0, kind="stable").T
        want = sorted((-int(s), int(i)) for s, i in zip(m @ q, ids, strict=True) if i != ids[0])[:10]
        best, scores, scored = topk.threshold_top(m, order, ids, q, int(ids[0]), 10, step=int(rng.integers(1, 20)))
        assert want == [(-int(s), int(i)) for s, i in zip(scores, best, strict=True)] and scored < n
        floor = -want[len(want) // 2][0] if want else 0
        best, scores, _ = topk.threshold_top(m, order, ids, q, int(ids[0]), 10, step=4, floor=floor)
        assert [w for w in want if -w[0] >= floor] == [(-int(s), int(i)) for s, i in zip(scores, best, strict=True)]


def test_the_bound_stops_reading_early():
    """Components of falling weight: a few entries of the lists decide."""
    rng = np.random.default_rng(4)
    m = (rng.standard_normal((8000, 6)) * [4000, 400, 40, 20, 10, 5]).astype(np.int64)
    order = np.argsort(m, axis=0, kind="stable").T
    for q in m[:20]:
        _, scores, scored = topk.threshold_top(m, order, np.arange(8000), q, -1, 10)
        assert scores.tolist() == sorted((m @ q).tolist())[::-1][:10]
        _, _, again = topk.threshold_top(m, order, np.arange(8000), q, -1, 10, floor=int(scores[-1]))
        assert again <= scored < 8000 / 2


def test_an_ids_valid_vector_counts_beside_invalid_ones(spark):
    nan = float("nan")
    check(spark, [(1, [1.0, 1.0]), (1, [None, 1.0]), (1, None), (1, [nan, 0.0]), (100, [1.0, 2.0]), (100, [nan, -9.0]), (2, [None, None])])


def test_large_components_are_exact_or_raise(spark):
    check(spark, [(0, [3e9, 1.0]), (1, [2e3, 1.0]), (2, [-2.5e3, 1.0]), (100, [1.5, 3e9]), (3, [1e-3, 5e-4])])
    for rows in ([(0, [3e9]), (1, [3e9])], [(0, [1.0]), (1, [1e30])]):
        with pytest.raises(Exception, match="OverflowError"):
            check(spark, rows)


def test_rows_scored_are_counted(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(rng.standard_normal() * 50), float(rng.standard_normal())], 1, 2, 3, 4) for i in range(3000)]
    out = topk.top_products(spark.createDataFrame(rows, SCHEMA), rows_a_block=500, with_scored=True).collect()
    assert len(out) == 300 and all(10 <= r.scored < 2999 / 2 for r in out)
