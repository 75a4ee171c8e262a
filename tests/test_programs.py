"""Positioned programmes against a brute-force version."""

import random
from collections import Counter

import pytest

from tessera.operators import graph, programs
from tessera.plans import queries
from tessera.plans.tables import Tables

LOCAL = "group_id long, index int, title_key string, version string, duration_ms long, disc int, number int, identity string"


def brute(local, program, complete):
    """[(index, provider index, decision)] of one group; rows are (index, title, version, ms, disc, number, identity)."""
    place = lambda t: None if t[5] is None else ((t[4] or 1), t[5])
    clash = lambda a, b: a[6] is not None and b[6] is not None and a[6] != b[6]
    agrees = lambda a, b: a[1:3] == b[1:3]
    options = {a[0]: [b for b in program if not clash(a, b) and ((a[6] is not None and a[6] == b[6]) or (agrees(a, b) and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 10_000)))] for a in local}
    asked = Counter(b[0] for bs in options.values() for b in bs)
    mapped = {i: bs[0] for i, bs in options.items() if len(bs) == 1 and asked[bs[0][0]] == 1}
    strong = complete and len(mapped) >= 3 and len(mapped) * 5 >= 4 * len(local) and len(mapped) * 5 >= 4 * len(program)
    line = [mapped[a[0]][0] for a in sorted(local) if a[0] in mapped]
    reordered = bool(line) and any(x >= y for x, y in zip(line, line[1:], strict=False))
    at = {place(b): b for b in sorted(program) if place(b)}
    duplicates = sum(place(b) is not None for b in program) - len(at)
    anchors = {place(a) for a in local if place(a) in at and agrees(a, at[place(a)]) and not clash(a, at[place(a)])}
    if strong:
        anchors = {a[0] for a in local if a[0] in mapped and not clash(a, mapped[a[0]])}
    shifted = any(place(a) in at and not agrees(a, at[place(a)]) and any(place(b) != place(a) and agrees(a, b) for b in program) for a in local if place(a))
    differs = any(place(a) != place(mapped[a[0]]) for a in local if a[0] in mapped)
    out = []
    for a in local:
        c = mapped.get(a[0]) if strong or differs else at.get(place(a)) if place(a) else None
        if c is None:
            d = "trusted_identity_conflict" if any(clash(a, b) and agrees(a, b) for b in program) else ("ambiguous_correspondence" if any(agrees(a, b) for b in program) else "local_only") if strong else "position_mismatch"
        elif duplicates:
            d = "position_mismatch"
        elif clash(a, c):
            d = "trusted_identity_conflict"
        elif not strong and (place(a) is None or place(a) != place(c)):
            d = "position_mismatch"
        elif shifted and not strong:
            d = "shifted_program"
        elif a[2] != c[2]:
            d = "version_conflict"
        elif a[1] == c[1]:
            d = ("reordered_track" if reordered else "aligned_after_insertion") if strong and place(a) != place(c) else "exact_anchor"
        else:
            d = "corroborated_position" if len(anchors) >= 3 else "insufficient_anchors"
        out.append((a[0], c and c[0], d, len(anchors)))
    return out, complete and not duplicates and all(d in programs.FITTING for _, _, d, _ in out)


def test_all_decisions_against_brute_force(spark):
    rng = random.Random(11)
    groups = {}
    for g in range(500):
        n = rng.randrange(1, 9)
        local = [(i, rng.choice("abcdefghij") if rng.random() < 0.3 else "t" + str(i), "live" if rng.random() < 0.07 else "", rng.choice([None, 1000, 1000 + 30_000 * (rng.random() < 0.1)]), rng.choice([None, 0, 1]), i + 1 if rng.random() < 0.95 else None, rng.choice([None, None, f"x{i}"])) for i in range(n)]
        kept = [t for t in local if rng.random() < 0.9]
        if rng.random() < 0.3:
            rng.shuffle(kept)
        program = []
        for j, t in enumerate(kept):
            number = t[5] if rng.random() < 0.6 else j + 1 + (rng.random() < 0.1)
            program.append((j, t[1] if rng.random() < 0.85 else "u", t[2] if rng.random() < 0.95 else "live", t[3], t[4], number, t[6] if rng.random() < 0.9 else "y"))
        if program:
            groups[g] = (local, program, rng.random() < 0.9)
    plain = [(i, f"t{i}", "", 1000, 1, i + 1, None) for i in range(8)]
    groups[500] = (plain + [(8, "u", "", 1000, 1, 9, None), (9, "u", "", 1000, 1, 10, None)], plain + [(8, "u", "", 1000, 1, 9, None)], True)
    groups[501] = (plain[:4], [(i, t, v, 60_000, d, n + 1, x) for i, t, v, _, d, n, x in plain[:4]], True)
    flat = lambda k: [(g, *t) for g, x in groups.items() for t in x[k]]
    local = spark.createDataFrame(flat(0), LOCAL)
    program = spark.createDataFrame([(g, *t, x[2]) for g, x in groups.items() for t in x[1]], LOCAL + ", complete boolean")
    decisions = programs.positioned_program(local, program)
    want = {g: brute(*x) for g, x in groups.items()}
    rows = [(g, *r) for g, (found, _) in want.items() for r in found]
    assert sorted(map(repr, ((r.group_id, r.local_index, r.provider_index, r.decision, r.anchors) for r in decisions.collect()))) == sorted(map(repr, rows))
    assert len({r[3] for r in rows}) == 11
    fits = {r.group_id: r.compatible for r in programs.compatible_programs(decisions, program).collect()}
    assert fits == {g: fit for g, (_, fit) in want.items()} and len(set(fits.values())) == 2


def test_album_outcomes(spark):
    from tessera.operators import programs

    columns = "group int, program int, track int, considered boolean, trusted boolean, exact_title boolean, position boolean, identity_conflict boolean, duration_mismatch boolean, occurrence_supported boolean, recording int, occurrence int, p_key string"
    row = lambda track, program=0, group=1, exact=True, at=True, conflict=False, off=False, supported=True, rec=None, occ=None, key="k", trusted=False: (group, program, track, True, trusted, exact, at, conflict, off, supported, rec, occ, key)
    checks = [
        row(1, rec=7), row(1, 1, rec=7), row(2, rec=7), row(2, 1, rec=8), row(3, rec=7), row(3), row(4, conflict=True, rec=7), row(5, rec=7), row(5, 1), row(6),
        row(7, exact=False, key="a"), row(7, 1, exact=False, key="b"), row(8, exact=False, key="a", occ=3), row(8, 1, exact=False, key="b", occ=3), row(9, exact=False, off=True, rec=7), row(10, off=True, rec=7), row(11, supported=False, rec=7), row(12, 2, rec=7),
        row(1, group=2, rec=7), row(2, 1, group=2, rec=7),
    ]
    tracks = spark.createDataFrame([(1, k) for k in range(1, 14)] + [(2, 1), (2, 2), (1, 1), (3, 1)], "group int, track int")
    known = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, True), (2, 1, False)], "group int, program int, complete boolean")
    chosen = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "group int, program int")
    got = {(r.group, r.track): tuple(r)[2:] for r in programs.album_outcomes(spark.createDataFrame(checks, columns), tracks, known, chosen).collect()}
    matched = lambda status, rec=None: (False, "matched", status, rec)
    none = (False, "no_confident_match", None, None)
    assert got == {
        (1, 1): matched("identified", 7), (1, 2): matched("ambiguous"), (1, 3): (False, "ambiguous", None, None), (1, 4): (False, "conflicting_identity", None, None), (1, 5): matched("ambiguous"), (1, 6): matched("not_provided"),
        (1, 7): (False, "ambiguous", None, None), (1, 8): matched("not_provided"), (1, 9): matched("duration_mismatch"), (1, 10): matched("identified", 7), (1, 11): matched("ambiguous"), (1, 12): none, (1, 13): none,
        (2, 1): (True, "no_confident_match", None, None), (2, 2): (True, "no_confident_match", None, None), (3, 1): none,
    }


@pytest.mark.parametrize("name", ["positioned_program", "program_selection"])
def test_sales_tables_are_read_once(spark, sf, name):
    """All sides of a programme come from rows written once; lineitem isn't aggregated anew for each."""
    files = queries.QUERIES[name](spark, sf).inputFiles()
    assert files and not any("lineitem" in f for f in files)


@pytest.fixture
def shuffles(spark):
    """Counts the shuffles that a plan has where nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_positions_are_decided_where_albums_lie(spark, sf, shuffles):
    """Tracks are dealt by album once; what is decided from them isn't shuffled again."""
    with graph.together(spark):
        assert shuffles(queries._positioned(Tables(spark, sf))[0]) == 0


@pytest.mark.parametrize("name", ["compatible_programs", "album_track_outcomes"])
def test_results_are_decided_where_albums_lie(spark, sf, shuffles, monkeypatch, name):
    """What the query writes comes from the dealt tracks unshuffled."""
    released, found = graph.released, []
    monkeypatch.setattr(graph, "released", lambda df: found.append(shuffles(df)) or released(df))
    queries.QUERIES[name](spark, sf)
    assert found[-1:] == [0]


def test_a_pair_of_equal_title_and_identity_counts_once(spark):
    """Three pairs by title, two of them by identity as well, one by identity alone; a fifth by title has another identity."""
    rows = [(1, i, f"t{i}", "", 1000, 1, i + 1, x) for i, x in enumerate(["a", "b", None, "c", "d"])]
    listed = [(*r[:2], "u" if r[1] == 3 else r[2], *r[3:7], "y" if r[1] == 4 else r[7], True) for r in rows]
    got = programs.positioned_program(spark.createDataFrame(rows, LOCAL), spark.createDataFrame(listed, LOCAL + ", complete boolean")).collect()
    decisions = ["exact_anchor"] * 3 + ["corroborated_position", "trusted_identity_conflict"]
    assert sorted((r.local_index, r.provider_index, r.decision, r.anchors, r.strong) for r in got) == [(i, None if i == 4 else i, d, 4, True) for i, d in enumerate(decisions)]
