import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import resolution

CANDIDATES = "group long, candidate long, title_class string, artist_accepted boolean, artist_ids array<long>, year int, month int, day int, kind string, title_key string, tracks int, required int, local_tracks int, local_usable boolean, local_year int, local_month int, local_day int, more_pages boolean, edition_pair boolean, type_conflict boolean, unsystematic boolean"
PROGRAMS = "group long, candidate long, program int, complete boolean, strong boolean, anchors int, listed int, duplicates int, matched int, usable boolean, over_3s boolean, over_10s boolean, trusted_conflict boolean, displaced boolean, version_conflict boolean, unanchored boolean"
TRACKS = "group long, candidate long, program int, index int, disc int, number int, track_id long, title_key string, artist_ids array<long>, lead_ids array<long>, credits int, known_credits boolean, recordings array<long>, isrcs array<string>, duration_ms int, approximate boolean"


def fields(schema):
    return [x.split()[0] for x in schema.split(", ")]


def generated(seed, groups=150):
    rng = random.Random(seed)
    some = lambda p: rng.random() < p
    candidates, programs, tracks = [], [], []
    for g in range(groups):
        local, more, usable = rng.choice([0, 3, 3, 4]), some(0.2), some(0.8)
        head = {"local_tracks": local, "more_pages": more, "local_usable": usable, "required": rng.choice([2, 3, 4]), "local_year": rng.choice([None, 2000, 2001]), "local_month": rng.choice([None, 5]), "local_day": rng.choice([None, 7])}
        noise = rng.choice([0, 0.3, 1])
        clean, lists = some(0.7), [[rng.randrange(3) for _ in range(rng.choice([2, 3, 3]))] for _ in range(2)]
        for k in range(rng.choice([1, 2, 2, 3, 3, 4, 5, 6])):
            bad = 0.05 if clean else 0.35
            date = (2000, 5, 7) if some(1 - noise) else rng.choice([(2000, 5, 7), (2000, 5, 7), (2000, None, None), (2001, 1, 1), (None, None, None)])
            title = rng.choice(["exact"] * 5 + ["typography", "release_type_suffix", "boilerplate", "minor_typo", "shared_title_span"]) if not some(bad) else rng.choice(["conflict", "version_conflict", "type_conflict"])
            key = {"group": g, "candidate": g * 10 + k}
            candidates.append(key | head | {
                "title_class": title, "artist_accepted": not some(bad), "artist_ids": rng.choice([[1], [1], [1, 2], [2, 1]]), "year": date[0], "month": date[1], "day": date[2], "kind": rng.choice(["album", "album", "album", "ep"]), "title_key": rng.choice("xxxy"),
                "tracks": rng.choice([None, 1, 3, 4, 9]) if some(bad) else 4, "edition_pair": some(0.7), "type_conflict": some(bad / 4), "unsystematic": some(0.5)})
            for p in range(rng.choice([0, 2]) if some(bad / 3) else 1):
                fine = some(0.7)
                programs.append(key | {"program": p, "complete": not some(bad / 2), "strong": some(0.8), "anchors": local if fine else rng.randrange(5), "listed": 4 if fine else 2, "duplicates": int(some(bad / 4)), "matched": 4 if fine else 2, "usable": some(0.8), "over_3s": some(0.2), "over_10s": some(0.2), "trusted_conflict": some(bad / 4), "displaced": some(bad / 4), "version_conflict": some(bad / 4), "unanchored": some(bad / 2)})
                titles = rng.choice(lists)
                for i, t in enumerate(titles):
                    extra = some(0.15 * noise)
                    tracks.append(key | {"program": p, "index": i, "disc": 1, "number": i + 1, "track_id": rng.choice([None, 5]) if some(0.1 * noise) else t + 100 * i, "title_key": f"t{t}{'' if some(0.3 * noise) else i}", "artist_ids": [1, 2] if extra else [1], "lead_ids": [1], "credits": 2 if extra else 1, "known_credits": not some(0.05), "recordings": rng.choice([[], [], [7 + t], [8]]) if some(0.3 * noise) else [], "isrcs": rng.choice([[], ["a"], ["b"]]) if some(0.1) else [], "duration_ms": 1000 * t + 500 + (rng.choice([0, 80, 2000]) if some(0.4 * noise) else 0), "approximate": some(0.03)})
    return candidates, programs, tracks


def agreement(a, b):
    if a[0] is None or a[0] != b[0] or (a[1] and b[1] and a[1] != b[1]):
        return 0
    if not (a[1] and b[1]):
        return 1
    return 2 if not (a[2] and b[2]) else 3 if a[2] == b[2] else 0


def related(c, d, programs, tracks):
    """same, comparable, equivalent of two candidates, straight from their definitions."""
    lists = []
    for x in (c, d):
        own = [p for p in programs if p["candidate"] == x["candidate"]]
        if len(own) != 1 or not own[0]["complete"]:
            return False, False, False
        lists.append(sorted((t for t in tracks if t["candidate"] == x["candidate"]), key=lambda t: t["index"]))
    a, b = lists
    if len(a) != len(b) or not a:
        return False, False, False
    z = list(zip(a, b, strict=True))
    listed = all((x["disc"], x["number"], x["title_key"]) == (y["disc"], y["number"], y["title_key"]) for x, y in z)
    same = listed and all(x["track_id"] is not None and x["track_id"] == y["track_id"] and x["artist_ids"] == y["artist_ids"] and x["number"] > 0 for x, y in z)
    comparable = len(a) >= 3 and listed and all(abs(x["duration_ms"] - y["duration_ms"]) <= 3000 and set(x["lead_ids"]) & set(y["lead_ids"]) and not any(i != j for i in x["recordings"] for j in y["recordings"]) for x, y in z)
    def clash(x, y):
        r = x["recordings"] and y["recordings"] and set(x["recordings"]) != set(y["recordings"])
        return r or (x["isrcs"] and y["isrcs"] and not set(x["isrcs"]) & set(y["isrcs"]))
    strict = len(a) >= 3 and listed and len({t["title_key"] for t in a}) == len(a) and all(
        x["track_id"] is not None and y["track_id"] is not None and x["known_credits"] and y["known_credits"] and x["artist_ids"] == y["artist_ids"] and not x["approximate"] and not y["approximate"]
        and x["duration_ms"] > 0 and y["duration_ms"] > 0 and abs(x["duration_ms"] - y["duration_ms"]) <= 100 and not clash(x, y) for x, y in z)
    date = lambda x: (x["year"], x["month"], x["day"])
    dates = c["year"] == d["year"] and (not c["month"] or not d["month"] or c["month"] == d["month"])
    alike = dates and c["kind"] == d["kind"] and sorted(c["artist_ids"]) == sorted(d["artist_ids"]) and c["title_key"] == d["title_key"]
    return same, comparable, bool(alike and (same or (c["year"] and date(c) == date(d) and strict)))


def brute(cands, programs, tracks):
    rows = {}
    local, more = cands[0]["local_tracks"], cands[0]["more_pages"]
    rel = {(c["candidate"], d["candidate"]): related(c, d, programs, tracks) for c in cands for d in cands if c is not d}
    progs = {c["candidate"]: sorted((p for p in programs if p["candidate"] == c["candidate"]), key=lambda p: p["program"]) for c in cands}
    for c in cands:
        reasons = []
        if not c["artist_accepted"]:
            reasons.append("artist_mismatch")
        reasons += {"conflict": ["album_title_mismatch"], "version_conflict": ["album_version_mismatch"]}.get(c["title_class"], [])
        if c["title_class"] == "type_conflict" or c["type_conflict"]:
            reasons.append("release_type_mismatch")
        if c["tracks"] is not None and c["tracks"] < c["required"] and not (local >= 3 and c["tracks"] * 5 >= local * 4):
            reasons.append("track_count_mismatch")
        rows[c["candidate"]] = {"title": c["title_class"], "ok": c["artist_accepted"], "reasons": reasons, "c": c, "eq": None}
    ids = lambda r: sorted(r["c"]["artist_ids"])
    freed = []
    for k, r in rows.items():
        if not more and len(cands) <= 4 and r["reasons"] == ["artist_mismatch"]:
            others = [j for j, o in sorted(rows.items()) if o["ok"] and not o["reasons"] and ids(o) == ids(r)]
            if others and rel[k, others[0]][2]:
                freed.append(k)
    for k in freed:
        rows[k].update(ok=True, reasons=[])
    for r in rows.values():
        r["decision"] = "rejected" if r["reasons"] else "withheld"

    def finish(outcome, reason):
        return [(k, r["title"], r["decision"], r["reasons"], r["eq"], outcome, reason) for k, r in rows.items()]

    if local == 0:
        return finish("no_confident_match", "insufficient_program_anchors")
    if not more and all(r["reasons"] for r in rows.values()):
        alt = [r for r in rows.values() if r["ok"] and set(r["reasons"]) <= {"album_version_mismatch", "album_title_mismatch"} and r["c"]["edition_pair"]]
        if len(alt) == 1:
            alt[0].update(title="playable_edition", reasons=[], decision="withheld")
    viable = [k for k in sorted(rows) if not rows[k]["reasons"]]
    if len(viable) > 4 or (more and all(rows[k]["title"] == "playable_edition" for k in viable)):
        return finish("ambiguous", "incomplete_candidate_page" if more else "candidate_limit")
    examined = []
    won = lambda k: progs[k] and all(p["complete"] and p["strong"] and p["anchors"] >= 3 and p["anchors"] == local for p in progs[k])
    for k in viable:
        r, c, ps = rows[k], rows[k]["c"], progs[k]
        if r["title"] == "boilerplate" and c["unsystematic"]:
            r.update(reasons=["album_version_mismatch"], decision="rejected")
            continue
        against = []
        for p in ps:
            for bad, reason in ((not p["complete"], "incomplete_program"), (p["trusted_conflict"], "trusted_identity_conflict"), (p["listed"] < c["required"] and not p["strong"], "track_count_mismatch"), (p["duplicates"] > 0 or p["displaced"], "position_mismatch"), (p["version_conflict"], "album_version_mismatch"), (p["unanchored"], "insufficient_program_anchors")):
                if bad:
                    against.append(reason)
                    break
        need = 0 if r["title"] in ("exact", "typography") else 3 if r["title"] == "playable_edition" else max(3, c["required"] - 1)
        slow = {"minor_typo": "over_3s", "playable_edition": "over_10s"}.get(r["title"])
        if r["title"] == "playable_edition" and any(p["matched"] < 3 or p["matched"] * 5 < local * 4 for p in ps):
            r.update(reasons=["insufficient_program_anchors"], decision="withheld")
        elif not ps or against:
            r["reasons"] = against or ["incomplete_program"]
            unsure = set(r["reasons"]) <= {"incomplete_program", "insufficient_program_anchors"}
            r["decision"] = "withheld" if unsure else "rejected"
            if unsure:
                examined.append(k)
        elif need and any(p["anchors"] < need for p in ps):
            r.update(reasons=["insufficient_program_anchors"], decision="rejected")
        elif slow and any(p[slow] for p in ps):
            r.update(reasons=["duration_conflict"], decision="rejected")
        else:
            examined.append(k)
    if any(not rows[k]["reasons"] and won(k) for k in examined) and cands[0]["local_usable"]:
        for k in list(examined):
            if rows[k]["reasons"] and progs[k] and all(p["complete"] and p["anchors"] * 2 < local and p["usable"] for p in progs[k]):
                rows[k].update(reasons=["track_title_mismatch"], decision="rejected")
                examined.remove(k)
    single = [k for k in examined if len(rows[k]["c"]["artist_ids"]) == 1 and not rows[k]["reasons"]]
    examined = [k for k in examined if len(rows[k]["c"]["artist_ids"]) == 1 or not any(k != j and rel[k, j][0] for j in single)]
    extra = lambda k: sum(max(0, t["credits"] - 1) for t in tracks if t["candidate"] == k)
    top = lambda k: max(p["anchors"] for p in progs[k])
    weaker = [k for k in examined if not rows[k]["reasons"] and any(k != j and not rows[j]["reasons"] and ids(rows[k]) == ids(rows[j]) and extra(j) < extra(k) and rel[k, j][1] and top(j) >= top(k) for j in examined)]
    for k in weaker:
        rows[k].update(reasons=["weaker_artist_credit"], decision="rejected")
    examined = [k for k in examined if k not in weaker]
    groups = []
    for k in examined:
        for g in groups:
            if all(rel[k, j][2] for j in g):
                g.append(k)
                break
        else:
            groups.append([k])
    agree = {k: agreement([rows[k]["c"][f"local_{x}"] for x in ("year", "month", "day")], [rows[k]["c"][x] for x in ("year", "month", "day")]) for k in examined}
    for g in groups:
        g.sort(key=lambda k: (-agree[k], k))
    supported = all(not rows[k]["reasons"] for k in examined)
    winner = None
    if supported and len(groups) == 1:
        winner = groups[0]
    elif supported and groups:
        best = max(agree[g[0]] for g in groups)
        at = [g for g in groups if agree[g[0]] == best]
        if all(rows[k]["title"] != "minor_typo" for k in examined) and best > 0 and len(at) == 1 and all(p["anchors"] >= 3 for k in examined for p in progs[k]):
            winner = at[0]
    if more and not (winner and rows[winner[0]]["title"] in ("exact", "typography", "release_type_suffix") and won(winner[0])):
        return finish("ambiguous", "incomplete_candidate_page")
    if winner:
        title = rows[winner[0]]["title"]
        reason = "equivalent_candidates_collapsed" if len(winner) > 1 else resolution.ACCEPTED.get(title, "accepted_minor_typo")
        for k in examined:
            rows[k].update(decision="withheld", reasons=["competing_candidates"])
        for k in winner:
            rows[k].update(decision="accepted", reasons=[reason], eq=winner[0] if k != winner[0] else None)
        return finish("matched" if title == "exact" else "matched_close", reason)
    if len(examined) == 1 and not supported:
        reason = rows[examined[0]]["reasons"][0]
    elif not examined:
        lead = next((k for k in sorted(rows) if rows[k]["ok"]), min(rows))
        reason = (rows[lead]["reasons"] or ["no_candidates"])[0]
    else:
        reason = "competing_candidates"
    for k in examined:
        rows[k]["reasons"] = rows[k]["reasons"] or ["competing_candidates"]
    return finish("no_confident_match" if not examined or (len(examined) == 1 and not supported) else "ambiguous", reason)


def frames(spark, candidates, programs, tracks):
    return [spark.createDataFrame([tuple(r[f] for f in fields(s)) for r in rows], s) for rows, s in ((candidates, CANDIDATES), (programs, PROGRAMS), (tracks, TRACKS))]


@pytest.mark.parametrize("seed", range(3))
def test_resolution_equals_the_steps_one_by_one(spark, seed):
    candidates, programs, tracks = generated(seed, 400)
    got = resolution.resolve(*frames(spark, candidates, programs, tracks)).orderBy("group", "candidate").collect()
    want = []
    for g in range(400):
        own = lambda rows, g=g: [r for r in rows if r["group"] == g]
        want += sorted(brute(own(candidates), own(programs), own(tracks)))
    assert [tuple(r)[1:] for r in got] == want
    reached = {(r.outcome, r.outcome_reason) for r in got}
    assert len(reached) > 15 and {r.outcome for r in got} == {"matched", "matched_close", "ambiguous", "no_confident_match"}
    assert any(r.equivalent_to for r in got)


def test_related_programs(spark):
    candidates, programs, tracks = generated(7, 60)
    got = {(r.a, r.b): (r.same, r.comparable, r.equivalent) for r in resolution.related_programs(*frames(spark, candidates, programs, tracks)).collect()}
    by = {}
    for c in candidates:
        by.setdefault(c["group"], []).append(c)
    want = {(c["candidate"], d["candidate"]): related(c, d, programs, tracks) for own in by.values() for c in own for d in own if c["candidate"] < d["candidate"]}
    assert got == {k: v for k, v in want.items() if any(v)} and len(got) > 10


def test_reasons_carry_their_evidence(spark):
    candidates, programs, tracks = generated(1, 30)
    row = candidates[0] | {"group": 0, "candidate": 1, "title_class": "version_conflict", "artist_accepted": False, "artist_ids": [4, 9], "tracks": 1, "required": 3, "local_tracks": 2, "type_conflict": True, "kind": "ep"}
    df = frames(spark, [row], programs, tracks)[0]
    got = resolution.candidate_reasons(df).first().reasons
    assert [tuple(x) for x in got] == [("artist_mismatch", "4,9"), ("album_version_mismatch", "version_conflict"), ("release_type_mismatch", "version_conflict|ep"), ("track_count_mismatch", "1|3|2")]
    assert resolution.candidate_reasons(df.withColumns({"title_class": F.lit("exact"), "artist_accepted": F.lit(True), "tracks": F.lit(None).cast("int"), "type_conflict": F.lit(None).cast("boolean")})).first().reasons == []


def test_the_query_takes_all_steps(spark, sf):
    from tessera.plans import queries
    from tessera.plans.tables import Tables

    t = Tables(spark, sf)
    inputs = [[r.asDict() for r in df.collect()] for df in (queries._candidates(t), *queries._candidate_programs(t))]
    got = queries.QUERIES["representation_resolution"](spark, sf).orderBy("group", "candidate").collect()
    groups, want = {}, []
    for k, rows in enumerate(inputs):
        for r in rows:
            groups.setdefault(r["group"], ([], [], []))[k].append(r)
    for g in sorted(groups):
        candidates, programs, tracks = groups[g]
        want += sorted(brute(sorted(candidates, key=lambda r: r["candidate"]), programs, tracks))
    assert [tuple(r)[1:] for r in got] == want and len({r.outcome_reason for r in got}) > 8


def test_rows_are_dealt_once_a_step(spark):
    """The query's shuffles write few rows for each line: nothing is dealt again for each of a step's joins and windows, nor track lists that meet no other."""
    from tessera.plans import queries

    def stages():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None).iterator()
        while found.hasNext():
            yield found.next()

    last = max((s.stageId() for s in stages()), default=-1)
    queries.QUERIES["representation_resolution"](spark, "/root/testdata/sf0.01").count()
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    assert 0 < sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > last) < 8 * lines
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
