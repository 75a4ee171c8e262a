"""Registered queries on small tables whose answer needs every row."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from tessera.operators import catalog, graph
from tessera.plans import queries


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    """Suppliers 1-2-3 and 6-7 share parts that are no multiples of 20; 4 and 8 share part 20; 5 shares none."""
    lines = [(1, 3), (2, 3), (2, 7), (3, 7), (3, 7), (4, 20), (8, 20), (5, 11), (6, 41), (7, 41)]
    path = f"file://{tmp_path_factory.mktemp('linked')}"
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 9)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    of = {k: {k} for k in range(1, 9)}
    for _ in of:
        for a, p in lines:
            for b, q in lines:
                if p == q:
                    of[a] |= of[b]
    return path, of


def test_closure_and_canonical_ids_use_every_part(spark, linked):
    path, of = linked
    got = queries.QUERIES["closure"](spark, path).collect()
    assert sorted((r.seed, r.node) for r in got) == sorted((s, n) for s in range(1, 6) for n in of[s])
    got = queries.QUERIES["canonical_ids"](spark, path).collect()
    assert sorted((r.id, r.canonical) for r in got) == sorted((k, min(v)) for k, v in of.items() if len(v) > 1)


def test_families_are_components_of_a_group(spark, tmp_path):
    orders = {1: [1, 30, 500, 520, 900], 2: [7], 3: [1, 50, 100], 4: [5, 6, 7, 300], 5: [1, 50, 100, 400, 410]}
    spark.createDataFrame([(o, s) for o, m in orders.items() for s in m], "l_orderkey long, l_suppkey long").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    expected = []
    for o, m in orders.items():
        of = {s: {s} for s in m}
        for _ in m:
            for s in m:
                of[s] |= {y for x in of[s] for y in m if abs(x - y) <= 60}
        expected += [(o, s, min(c)) for s, c in of.items() if len(c) > 1 and all(abs(x - y) <= 60 for x in c for y in c)]
    got = queries.QUERIES["candidate_family_members"](spark, f"file://{tmp_path}").collect()
    assert len(expected) == 9 and sorted((r.l_orderkey, r.l_suppkey, r.representative) for r in got) == sorted(expected)


def brute_merges(rows):
    """(owner, into) by all pairs."""
    owners, out = sorted({o for o, *_ in rows}), {}
    of = {o: {} for o in owners}
    for o, provider, kind, e in rows:
        of[o].setdefault((provider, kind), set()).add(e)
    for x in owners:
        for y in owners:
            spaces = of[x].keys() & of[y].keys()
            if y < x and any(of[x][k] & of[y][k] for k in spaces) and all(of[x][k] & of[y][k] for k in spaces):
                out[x] = min(y, out.get(x, y))
    return sorted(out.items())


def test_merging_against_all_pairs(spark):
    rng = random.Random(7)
    for n, values in ((12, 3), (40, 6), (60, 25), (30, 1)):
        rows = [(rng.randrange(n), rng.choice("pqr"), "artist", rng.randrange(values)) for _ in range(3 * n)]
        table = spark.createDataFrame(rows + rows[:3], "owner long, provider string, kind string, external_id long")
        assert sorted(map(tuple, catalog.mergeable(table, "owner").collect())) == brute_merges(rows)
        assert sorted(map(tuple, catalog.mergeable(table, "owner", first=4).collect())) == brute_merges(rows)
    assert catalog.mergeable(table.limit(0), "owner").count() == 0


def test_a_veto_costs_no_round(spark, monkeypatch):
    """Fifty owners of one identity, of which only the last two share another namespace: it doesn't take a round for each."""
    rows = [(k, "p", "artist", 1) for k in range(50)] + [(k, "q", "artist", min(k, 48)) for k in range(50)]
    calls, cut = [], graph.cut
    for module in (catalog, graph):
        monkeypatch.setattr(module, "cut", lambda df: calls.append(1) or cut(df))
    got = catalog.mergeable(spark.createDataFrame(rows, "owner long, provider string, kind string, external_id long"), "owner").collect()
    assert sorted(map(tuple, got)) == brute_merges(rows) == [(49, 48)] and len(calls) < 12


def test_long_chains_are_closed(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    got = graph.reachable(edges, spark.createDataFrame([(0,), (1001,), (5000,), (0,)], "seed long")).collect()
    assert sorted((r.seed, r.node) for r in got) == [(0, k) for k in range(301)] + [(1001, 1000), (1001, 1001), (5000, 5000)]


def test_fresh_observations_round_seconds_as_the_twin(spark, tmp_path):
    now, day = datetime(2024, 1, 30, 23, 59, 25, 500_000), timedelta(days=1)
    seen = [now] + [now - day + timedelta(microseconds=u) for u in range(-2_500_000, 2_500_001, 250_000)] + [None]
    spark.createDataFrame(list(enumerate(seen)), "event_id long, ts timestamp_ntz").write.parquet(f"file://{tmp_path}/events.parquet")
    got = queries.QUERIES["fresh_observations"](spark, f"file://{tmp_path}").orderBy("event_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert [tuple(r) for r in got] == con.execute(f"SELECT event_id, fresh FROM ({queries.ORACLES['fresh_observations']}) ORDER BY 1").fetchall()
