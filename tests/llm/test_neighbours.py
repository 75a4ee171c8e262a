import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id long, key string, half string"


def brute(rows, threshold=0.93):
    good = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = {}, {i: i for i, _, _ in good}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    pairs = [(a, b) for a in range(len(good)) for b in range(len(good)) if a != b and good[a][2] == good[b][2] and cos(good[a][1], good[b][1])]
    for a, _ in pairs:
        links[good[a][0]] = links.get(good[a][0], 0) + 1
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if label[good[b][0]] < label[good[a][0]]:
                label[good[a][0]], moved = label[good[b][0]], True
    return links, label


def check(spark, rows, **options):
    table = spark.createDataFrame([(i, v, g, 1, "k", "h") for i, v, g in rows], SCHEMA)
    audits = []
    got = neighbours.near_duplicates(table, report=audits.append, **options).collect()
    links, label = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == (links.get(r.vec_id, 0), label.get(r.vec_id, r.vec_id)), r
        assert r.vec_id is None or r.kept == (r.vec_id == r.component_id)
    return audits


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [2.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [1.0, 0.0], 2), (8, [1.0, 0.0], None), (9, None, 1), (10, [], 1), (11, [0.0, 0.0], 1),
        (12, [nan, 1.0], 1), (13, [inf, 1.0], 1), (14, [None, 1.0], 1), (15, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (16, [-1.0, 0.0], 1), (17, [0.0, 1e-30], 1), (18, [0.0, 3e30], 1), (19, None, None),
    ]
    check(spark, rows)


def test_groups_chains_and_saturated_lists(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for size in (90, 2, 2, 3):
        center = rng.standard_normal(24)
        for _ in range(size):
            rows.append((k * 7 % 1009, (center + rng.standard_normal(24) * 0.12).tolist(), 1))
            k += 1
    for step in range(15):
        angle = step * 0.3
        rows.append((k * 7 % 1009, [float(np.cos(angle)), float(np.sin(angle)), *[0.0] * 22], 2))
        k += 1
    for _ in range(300):
        rows.append((k * 7 % 1009, rng.standard_normal(24).tolist(), int(k % 2) + 1))
        k += 1
    audits = check(spark, rows, length=4)
    assert audits[-1]["recall"] >= 0.9


def test_same_ids_and_nothing(spark):
    got = neighbours.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1, 1, "k", "h")] * 3, SCHEMA)).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(1, 2, 1, True)] * 3
    assert neighbours.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_tables(spark, table):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").collect()]
    last = check(spark, rows)[-1]
    assert brute(rows)[0] or (last["links"], last["recall"]) == (0, None)  # these tables' vectors lie apart
    assert last["recall"] is None or last["recall"] >= 0.9


def test_a_hub_of_many_near_copies(spark):
    """One group of 1,500 near copies in many tiles, and a stop without recall."""
    rng = np.random.default_rng(8)
    center = rng.standard_normal(16)
    near = center + rng.standard_normal((1500, 16)) * 0.02
    table = spark.createDataFrame([(k + 10, v.tolist(), 1, 1, "k", "h") for k, v in enumerate(near)] + [(k, rng.standard_normal(16).tolist(), 1, 1, "k", "h") for k in range(9)], SCHEMA)
    got = {r.vec_id: r for r in neighbours.near_duplicates(table, with_recall=True).collect()}
    assert all((got[k + 10].n_links, got[k + 10].component_id) == (1499, 10) for k in range(1500)) and {r.audit_recall for r in got.values()} == {1.0}


def test_too_low_a_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "checked", lambda lists, classes, threshold: lists.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    table = spark.createDataFrame([(k * 50, [1.0, k / 1000], 1, 1, "k", "h") for k in range(9)], SCHEMA)
    with pytest.raises(RuntimeError, match="audited links"):
        neighbours.near_duplicates(table, rounds=1, most_rounds=1)


def test_the_audit_sees_links_whatever_the_ids(spark):
    """Pairs on odd ids in many labels; and none at all."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        v = rng.standard_normal(16)
        rows += [(4 * k + 1, v.tolist(), k % 30), (4 * k + 3, (v + rng.standard_normal(16) * 0.01).tolist(), k % 30)]
    last = check(spark, rows)[-1]
    assert last["links"] >= 30 and last["recall"] >= 0.9 and last["by_vector"] >= 0.9
    apart = spark.createDataFrame([(k, np.eye(8)[k].tolist(), 1, 1, "k", "h") for k in range(8)], SCHEMA)
    assert {r.audit_recall for r in neighbours.near_duplicates(apart, with_recall=True).collect()} == {None}
