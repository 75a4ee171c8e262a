"""Operators on small cases: pages, availability, lists, linkage boundaries, closures, titles."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import credits, dates, text
from tessera.operators import aggregates, effective, graph, incremental, keyset, linkage, playlists, search, sets


def test_pages_concatenate_and_reverse(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice("abc"), rng.randrange(3), i) for i in range(120)], "t string, d int, id long")
    keys = ["t", "d", "id"]
    whole = [tuple(r) for r in df.orderBy(*keys).collect()]
    got, after = [], None
    while part := [tuple(r) for r in keyset.page(df, keys, after, 17).collect()]:
        got += part
        after = part[-1]
    assert got == whole
    back = [tuple(r) for r in keyset.page(df, keys, whole[60], 201, reverse=True).collect()]
    assert back == whole[:60][::-1]
    assert [tuple(r) for r in keyset.page(df, keys, whole[10], 5, inclusive=True).collect()] == whole[10:15]
    assert [tuple(r) for r in keyset.page(df, keys, whole[10], 5, descending=True).collect()] == whole[5:10][::-1]
    assert [tuple(r) for r in keyset.around(df, keys, whole[50], 10, 20).collect()] == whole[40:70]
    assert sorted(tuple(r) for r in keyset.between(df, keys, whole[30], whole[20]).collect()) == whole[20:31]
    assert keyset.clamp(0) == 1 and keyset.clamp(900) == 201 and keyset.more_than(df, 119) and not keyset.more_than(df, 120)


def test_page_filter_reaches_the_scan(spark, sf):
    plan = keyset.page(spark.read.parquet(f"{sf}/orders.parquet").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], (1000.0, 5))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_availability_matrix(spark):
    tracks = spark.createDataFrame([(i, "Same") for i in range(1, 7)], "track_id int, title string")
    sources = spark.createDataFrame([(2, False), (3, True), (4, True), (4, False), (5, True), (5, True), (6, True)], "track_id int, available boolean")
    saved = spark.createDataFrame([(i,) for i in range(1, 6)], "track_id int")
    mine, up = sets.having(tracks, saved, ["track_id"]), sources.where("available")
    ids = lambda df: sorted(r.track_id for r in df.collect())
    assert ids(sets.having(mine, up, ["track_id"], True)) == [3, 4, 5]
    assert ids(sets.having(mine, up, ["track_id"], False)) == [1, 2]
    assert ids(sets.having(mine, up, ["track_id"], None)) == [1, 2, 3, 4, 5]
    assert [r.a for r in sets.flagged(mine, up, ["track_id"], "a").orderBy("track_id").collect()] == [False, False, True, True, True]


def test_sets(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in sets.unique_or_none(df, ["k"], "v").collect()) == [(2, "c")]
    assert {r.k for r in sets.in_list(df, "k", list(range(2, 400))).collect()} == {2, 3}
    first = sets.first_of([df.where("k = 2"), df.where("k <= 2")], ["k"]).collect()
    assert sorted((r.k, r.v) for r in first) == [(1, "a"), (1, "a"), (1, "b"), (2, "c")]
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 3), (4, 4)], "l int, r int")
    assert [tuple(r) for r in sets.unique_on_both_sides(pairs, "l", "r").collect()] == [(4, 4)]
    assert sets.matching(df, {"k": [1, 2], "v": ["a", "c"]}).count() == 3 and sets.matching(df, {"k": None}).count() == 5
    sel = spark.createDataFrame([([1, 2],)], "s array<int>").select(sets.toggled(F.col("s"), F.lit(2)).alias("a"), sets.toggled(F.col("s"), F.lit(3)).alias("b")).first()
    assert sel.a == [1] and sel.b == [1, 2, 3]


def test_lists_with_repeats_and_gaps(spark):
    entries = spark.createDataFrame([("p", "x", 0), ("p", "y", 5), ("p", "x", 9), ("q", "z", 1)], "list string, item string, position long")
    assert [r.ordinal for r in playlists.ordinals(entries.where("list = 'p'"), "list", "position").orderBy("position").collect()] == [1, 2, 3]
    added = spark.createDataFrame([("p", "x", 0), ("p", "w", 1), ("p", "w", 2), ("n", "x", 0)], "list string, item string, o int")
    plan = sorted((r.list, r.position, r.item) for r in playlists.append_plan(entries, added, "list", "item", "position", "o").collect())
    assert plan == [("n", 0, "x"), ("p", 10, "w"), ("p", 11, "w")]
    assert playlists.append_plan(entries, added, "list", "item", "position", "o", include_existing=True).count() == 4
    moves = spark.createDataFrame([("p", 3, 1)], "list string, from_ordinal int, to_ordinal int")
    assert [(r.position, r.ordinal) for r in playlists.moved(entries, "list", "position", moves).where("list = 'p'").orderBy("position").collect()] == [(0, 2), (5, 3), (9, 1)]
    assert [r.overall for r in playlists.overall(entries, ["list", "position"], 3).orderBy("list", "position").collect()] == [1, 2, 3, 4]
    many = spark.range(5000).selectExpr("id % 7 as list", "hash(id) as position", "id")
    got = playlists.overall(many, ["list", "position", "id"], 16).orderBy("list", "position", "id").select("overall").collect()
    assert [r.overall for r in got] == list(range(1, 5001))
    swapped = entries.withColumn("position", F.when(F.col("item") == "y", 20).otherwise(F.col("position")))
    one, two = (playlists.revision(e, "list", "position", "item").where("list = 'p'").first().revision for e in (entries, swapped))
    assert one != two


def test_recordings_at_the_boundaries(spark):
    local = spark.createDataFrame([(i, "Song", "unknown artist" if i == 7 else "Band", None if i == 3 else 100_000, i == 6, i != 5) for i in range(1, 9)], "track_id int, title string, artist string, duration_ms long, known boolean, complete boolean")
    rows = [(1, "a", " SONG ", "band", 103_000), (2, "a", "Song", "Band", 103_001), (3, "a", "Song", "Band", 1), (4, "a", "Song", "Band", 100_000), (4, "b", "Song", "Band", 100_000), (5, "a", "Song", "Band", 100_000), (6, "a", "Song", "Band", 100_000), (7, "a", "Song", "Other", 100_000), (8, "a", "Song (Live)", "Band", 100_000)]
    candidates = spark.createDataFrame(rows, "track_id int, candidate_id string, title string, artist string, duration_ms long")
    got = {r.track_id: (r.outcome, r.candidate_id) for r in linkage.recordings(local, candidates).collect()}
    assert got == {1: ("matched", "a"), 2: ("none", None), 3: ("matched", "a"), 4: ("ambiguous", None), 5: ("incomplete", None), 6: ("already_matched", None), 7: ("matched", "a"), 8: ("none", None)}


def test_artists(spark):
    queries = spark.createDataFrame([(1, "Queen", True), (2, "Prince", True), (3, "ABBA", True), (4, "Nobody", True), (5, "Queen", False), (6, "X’s", True)], "query_id int, name string, complete boolean")
    rows = [(1, "a", "QUEEN", None), (2, "a", "TAFKAP", ["prince"]), (2, "b", "Princes", None), (3, "a", "abba", None), (3, "b", "Other", ["Abba"]), (5, "a", "Queen", None), (6, "a", "x's", None)]
    got = {r.query_id: (r.outcome, r.candidate_id) for r in linkage.artists(queries, spark.createDataFrame(rows, "query_id int, candidate_id string, name string, aliases array<string>")).collect()}
    assert got == {1: ("matched", "a"), 2: ("ambiguous", None), 3: ("ambiguous", None), 4: ("none", None), 5: ("ambiguous", None), 6: ("matched", "a")}


def test_albums(spark):
    queries = spark.createDataFrame([(1, "Title", True), (2, "Title EP", True), (3, "Titles", True), (4, "Title (Live)", True), (5, "Title", False), (6, "Title EP", True)], "query_id int, title string, complete boolean")
    rows = [(1, "a", "title", "Album"), (1, "b", "Titla", "Album"), (2, "a", "Title", "EP"), (2, "b", "Title", "Album"), (3, "a", "Title", "Album"), (4, "a", "Title", "Album"), (5, "a", "Title", "Album"), (6, "a", "Title", "Album")]
    got = {r.query_id: (r.outcome, r.candidate_id) for r in linkage.albums(queries, spark.createDataFrame(rows, "query_id int, candidate_id string, title string, primary_type string")).collect()}
    assert got == {1: ("matched", "a"), 2: ("matched_close", "a"), 3: ("matched_close", "a"), 4: ("none", None), 5: ("ambiguous", None), 6: ("none", None)}


def test_alignment_kinds(spark):
    names = "ABCDEF"
    side = "group_id int, index int, title_key string, duration_ms long, disc int, number int"
    local = [(1, i, c, 1000, 1, i) for i, c in enumerate(names)] + [(2, i, c, 1000, 1, i) for i, c in enumerate(names)]
    program = [(1, i, c, 1000, 1, i + (c == "B"), True) for i, c in enumerate(names[:-1] + "G")] + [(2, 5 - i, c, 1000, 1, i, True) for i, c in enumerate(names)]
    got = linkage.alignment(spark.createDataFrame(local, side), spark.createDataFrame(program, side + ", complete boolean")).collect()
    kinds = {(r.group_id, r.local_index, r.provider_index): r.kind for r in got}
    assert kinds[1, 0, 0] == "exact" and kinds[1, 1, 1] == "title_normalized" and kinds[1, 5, None] == "inserted_local" and kinds[1, None, 5] == "missing_local"
    assert all(k == "reordered" for (g, *_), k in kinds.items() if g == 2)


def test_titles(spark):
    def one(expr, **values):
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first().x

    a, b = F.col("a"), F.col("b")
    assert one(text.normalize_album_title(a), a=" [X’ed  Out] ") == "x'ed out"
    assert one(text.normalize_album_title(a), a="Café") == "café"
    assert one(text.presentation_title(a), a="(a) b (c)") == "(a) b (c)"
    assert one(text.comparison_title(a), a="Rock & Roll!") == "rock and roll"
    assert one(text.album_representation_title(a), a="X-Y & Z+") == "x y & z+"
    for title in ("Audiotree", "Audiotree Live", "Audiotree LIVE"):
        assert one(text.artist_album_discovery_variant(a, b), a="CHON", b=title) == "CHON on Audiotree Live"
    assert one(text.artist_album_discovery_variant(a, b), a="Artist", b="Demo") is None
    assert one(text.artist_album_title(a, b), a="Band on Stage", b="band") == "Stage"
    assert one(text.shared_title_span(a, b), a="Song", b="A Song, Again") == "song" and one(text.shared_title_span(a, b), a="Song", b="Songs") is None
    assert one(text.arbitrary_title_fragment(a, b), a="Song", b="Songs") and not one(text.arbitrary_title_fragment(a, b), a="Song", b="A Song")
    assert one(text.alternate_title_components(a), a="Haru - Spring").second == "spring" and one(text.alternate_title_components(a), a="春 Spring").layout == "whitespace_blocks"
    assert one(text.exact_alternate_component(a, b), a="Haru - Spring", b="HARU")
    assert one(text.numeric_title(a), a="Twenty-One") == "21" and one(text.numeric_title(a), a="One More") == "one more"
    assert one(text.numeric_equivalent(a, b), a="Twelve Days", b="12 Days") and not one(text.numeric_equivalent(a, b), a="One Day", b="1 Day")
    assert one(text.literal_search_component(a), a="春 (Spring) ab") == "Spring) ab"
    assert one(text.punctuation_placeholder(a), a="… !") and not one(text.punctuation_placeholder(a), a="a!")
    classes = {("Song", "Song (Album Version)"): "album_version", ("Dr. X", "Dr X"): "punctuation", ("Sun Shine", "Sunshine"): "token_boundary", ("Color", "Colour"): "tiny_typo", ("Song (Live)", "Song"): None, ("Nothing", "Nohting"): None, ("Something", "Somehting"): "tiny_typo", ("in the air of the night now", "in air of the night now x"): None, ("one two the three four five six", "one two three four five six"): "article_in_program", ("Don't", "Dont"): None}
    for (x, y), want in classes.items():
        assert one(text.contextual_title_class(a, b), a=x, b=y) == want, (x, y)
    assert one(credits.musical_title(a, F.array(F.lit("A"), F.lit("B"), F.lit("C"))), a="Song (feat. B & C)") == "Song"
    assert one(credits.musical_title(a, F.array(F.lit("A"), F.lit("B"))), a="Song (feat. D)") == "Song (feat. D)"


@pytest.mark.parametrize(("value", "want"), [("2020", (2020, None, None)), ("2020-02", (2020, 2, None)), ("2020-02-29", (2020, 2, 29)), ("2021-02-29", None), ("1900-02-29", None), ("2020-13", None), ("0000", None), ("20", None), ("2020-2", None), ("", None), ("2020-04-31", None)])
def test_partial_dates(spark, value, want):
    got = spark.createDataFrame([(value,)], "a string").select(dates.parse_date(F.col("a")).alias("d")).first().d
    assert (tuple(got) if got else None) == want


def test_closure_and_canonical_ids(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8), (8, 7)], "a int, b int")
    seeds = spark.createDataFrame([(3,), (7,), (4,)], "seed int")
    assert sorted((r.seed, r.node) for r in graph.reachable(edges, seeds).collect()) == [(3, 1), (3, 2), (3, 3), (4, 4), (7, 7), (7, 8), (7, 9)]
    ids = graph.canonical(edges)
    assert sorted(map(tuple, ids.collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7), (8, 7), (9, 7)]
    owned = spark.createDataFrame([(3, "x"), (1, "x"), (4, "y")], "a int, v string")
    assert sorted(map(tuple, graph.repointed(owned, "a", ids).collect())) == [(1, "x"), (4, "y")]


def test_aggregates(spark):
    rows = spark.createDataFrame([("a", 1, 2, 1, 2), ("a", 1, 2, 2, 2), ("a", 2, 2, 1, 1), ("b", 1, 1, 1, 2), ("c", 1, 1, 1, 1), ("c", 1, 1, 1, 1), ("d", None, 1, 1, 1)], "g string, disc int, discs int, track int, tracks int")
    assert {r.g: r.complete for r in aggregates.completeness(rows, "g", "disc", "discs", "track", "tracks").collect()} == {"a": True, "b": False, "c": False, "d": False}
    names = spark.createDataFrame([(2, "B", None), (1, "A", " & "), (3, "C", None)], "p int, n string, j string")
    assert names.agg(aggregates.ordered_text("p", F.col("n"), F.col("j")).alias("x")).first().x == "A & B / C"
    assert names.agg(aggregates.agreed(F.col("n")).alias("x")).first().x is None


def test_overrides_and_scans(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    edits = spark.createDataFrame([(1, True, None), (2, False, "z"), (3, True, "y")], "id int, s boolean, v string")
    assert [r.t for r in effective.with_overrides(base, edits, ["id"], {"t": ("s", "v")}).orderBy("id").collect()] == [None, "b", "y"]
    assert [r.k for r in spark.createDataFrame([(2000,), (None,)], "y int").select(effective.year_key(F.col("y")).alias("k")).collect()] == ["000000997999", "999999999999"]
    known = spark.createDataFrame([(1, True), (2, True), (3, False)], "id int, available boolean")
    seen = spark.createDataFrame([(1,), (3,)], "id int")
    state = lambda complete: [r.available for r in incremental.reconciled(known, seen, ["id"], complete).orderBy("id").collect()]
    assert state(True) == [True, False, True] and state(False) == [True, True, True]
    listing = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size int, at int")
    before = spark.createDataFrame([("a", 1, 1), ("b", 2, 9)], "path string, size int, at int")
    assert sorted(r.path for r in incremental.changed(listing, before, "path", ["size", "at"]).collect()) == ["b", "c"]


@pytest.mark.parametrize("words", ["hop", "Hop Along", "HOP ALONG", "hop-along"])
def test_sections(spark, words):
    artists = spark.createDataFrame([(1, "Hop Along"), (2, "Other")], "artist_id int, name string")
    albums = spark.createDataFrame([(1, "Painted Shut"), (2, "Hopes"), (3, "Nothing")], "album_id int, title string")
    tracks = spark.createDataFrame([(1, 1, "Waitress"), (2, 2, "Hop Along, Little One"), (3, 3, "Silence")], "track_id int, album_id int, title string")
    credit = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "track_id int, artist_id int")
    got = {(r.section, r.id): r.score for r in search.sections(artists, albums, tracks, credit, words).collect()}
    assert ("artist", "1") in got and got["song", "1"] == 4 and got["album", "1"] == 4 and ("song", "3") not in got
    assert got["song", "2"] == (1 if "-" not in words else 2)


def test_edition_titles(spark):
    from tessera.operators import editions

    rows = [("Album", "album", "", "exact"), ("Album EP", "Album", "EP", "release_type_suffix"), ("Album EP", "Album", "Album", "type_conflict"), ("Al-bum", "Al bum", "", "typography"), ("Albums", "Album", "", "minor_typo"), ("Album (Live)", "Album", "", "version_conflict"), ("Album", "Other", "", "conflict")]
    df = spark.createDataFrame(rows, "a string, b string, k string, want string")
    assert all(r.got == r.want for r in df.select("want", editions.title_class(F.col("a"), F.col("b"), F.col("k")).alias("got")).collect())
    pairs = [("Song", "Song (2011 Remastered)", True), ("Song - Deluxe Edition", "Song", True), ("Song", "Song", False), ("Song", "Song (Live)", False), ("Song (Remastered) (20th Anniversary Edition)", "Song", True), ("Deluxe", "Song", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", editions.playable_edition_pair(F.col("a"), F.col("b")).alias("got")).collect())
    df = spark.createDataFrame([("A/B", "A / B"), ("Song (Remastered)", "Song"), ("Song (Live)", None)], "a string, want string")
    assert all(r.got == r.want for r in df.select("want", editions.title_query_variant(F.col("a")).alias("got")).collect())
