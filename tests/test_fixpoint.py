import random

import pytest

from tessera.operators import fixpoint
from tessera.plans import queries
from tessera.plans.tables import Tables

TRACKS = "track_id long, album_id long, trusted boolean, excluded boolean, song_ok boolean, placed boolean"


def naive(tracks, credits, programs):
    """Evaluates everything until nothing changes."""
    needed, state, rounds = dict(programs), {}, 0
    live = {t[0] for t in tracks if t[2] and not t[3]}
    while True:
        rounds += 1
        artists = {a for t, a in credits if t in live and a is not None}
        new = set()
        for t, album, trusted, excluded, song, placed in tracks:
            if t in live or trusted or excluded:
                continue
            anchors = sum(x[1] == album and x[0] in live for x in tracks)
            if (song and any(c == t and a in artists for c, a in credits)) or (placed and album in needed and anchors >= needed[album]):
                new.add(t)
        if not new:
            break
        live |= new
        state |= dict.fromkeys(new, rounds)
    for t, album, trusted, excluded, song, _ in tracks:
        yield t, "excluded" if excluded else "trusted" if trusted else "accepted" if t in state else "unresolved" if song or album in needed else "needs_retry", state.get(t)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_evaluating_everything(spark, seed):
    rng = random.Random(seed)
    flag = lambda p: rng.choice([None, False]) if rng.random() > p else True
    tracks = [(k, rng.choice([None, *range(15)]), flag(0.05), flag(0.1), flag(0.5), flag(0.6)) for k in range(90)]
    credits = [(rng.randrange(95), rng.choice([None, *range(40)])) for _ in range(120)]
    programs = [(a, rng.randrange(4)) for a in range(12)]
    frames = spark.createDataFrame(tracks + tracks[:3], TRACKS), spark.createDataFrame(credits + credits[:5], "track_id long, artist_id long"), spark.createDataFrame(programs, "album_id long, needed int")
    got, _ = fixpoint.reevaluate(*frames)
    assert sorted((r.track_id, r.state, r.round) for r in got.collect()) == sorted(naive(tracks, credits, programs))


def test_later_rounds_evaluate_ever_less(spark, sf):
    got, rounds = fixpoint.reevaluate(*queries._reevaluation(Tables(spark, sf)))
    rounds = [tuple(r) for r in rounds.orderBy("round").collect()]
    assert 3 <= len(rounds) < queries._ROUNDS and rounds[-1][2] == 0
    assert rounds[1][1] < rounds[0][1] and rounds[-1][1] < rounds[0][1] / 4
    assert sum(r[1] for r in rounds) < len(rounds) * rounds[0][1] / 2
    assert sum(r[2] for r in rounds) == got.where("state = 'accepted'").count() > 0


def test_a_chain_and_no_tracks(spark):
    tracks = spark.createDataFrame([(k, k // 2, k == 0, False, k % 2 == 0, k % 2 == 1) for k in range(8)], TRACKS)
    credits = spark.createDataFrame([(k, (k + 1) // 2) for k in range(8)], "track_id long, artist_id long")
    programs = spark.createDataFrame([(a, 1) for a in range(4)], "album_id long, needed int")
    got, rounds = fixpoint.reevaluate(tracks, credits, programs)
    assert {r.track_id: r.round for r in got.collect()} == {0: None, **{k: k for k in range(1, 8)}}
    assert [(r.evaluated, r.accepted) for r in rounds.orderBy("round").collect()] == [(7, 1)] + [(1 + (k % 2 == 0), 1) for k in range(2, 8)] + [(0, 0)]
    assert fixpoint.reevaluate(tracks.limit(0), credits, programs)[0].count() == 0


def test_rounds_only_read_what_was_kept_once(spark, monkeypatch):
    """What a round writes is no larger than what it accepts and establishes: the pending tracks aren't rewritten."""
    tracks = spark.createDataFrame([(k, k // 2, k == 0, False, k % 2 == 0, k % 2 == 1) for k in range(8)] + [(100 + k, 100 + k, False, False, True, False) for k in range(500)], TRACKS)
    credits = spark.createDataFrame([(k, (k + 1) // 2) for k in range(8)], "track_id long, artist_id long")
    programs = spark.createDataFrame([(a, 1) for a in range(4)], "album_id long, needed int")
    sizes, name = [], next(n for n in ("kept", "cut") if hasattr(fixpoint, n))
    keep = getattr(fixpoint, name)

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, name, counted)
    got, _ = fixpoint.reevaluate(tracks, credits, programs)
    assert got.where("state = 'accepted'").count() == 7 and sum(s >= 500 for s in sizes) == 1
