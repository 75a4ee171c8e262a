"""The library's own lists: targets, queues to play, counts, discovery candidates, attachment, consolidation, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import browse, keyset, sets


def targets(c: browse.Catalogue, kind: str, ids: Sequence, entries: DataFrame | None = None, request: browse.Request | None = None) -> DataFrame:
    """(id): the tracks of artists, genres, albums, songs or lists. entries has list_id, position, track_id; a list keeps its repeats. No ids, no tracks."""
    if not ids:
        return c.tracks.limit(0).select(F.col("track_id").alias("id"))
    if kind == "lists":
        return sets.in_list(entries, "list_id", ids).join(c.tracks.select("track_id"), "track_id", "left_semi").orderBy("list_id", "position").select(F.col("track_id").alias("id"))
    base = request or browse.Request()
    named = {"artists": {"artists": list(ids)}, "genres": {"genres": list(ids)}, "albums": {"albums": list(ids)}, "songs": {"tracks": list(ids)}}[kind]
    return browse.browse(c, browse.Request(**(base.__dict__ | named | {"pane": "songs", "ids_only": True, "limit": None}))).select("id")


def playback(rows: DataFrame, ignored: DataFrame, explicit: DataFrame, group: str, position: str, key: str, start: str) -> DataFrame:
    """Rows of each program without ignored ones unless explicitly asked for, with new positions from 0 and whether they are the start."""
    marked = sets.flagged(sets.flagged(rows, ignored, [key], "__ignored"), explicit, [key], "__explicit")
    kept = marked.where(~F.col("__ignored") | F.col("__explicit")).drop("__ignored", "__explicit")
    return kept.withColumn("new_position", F.row_number().over(Window.partitionBy(group).orderBy(position)) - 1).withColumn("is_start", F.col(position) == F.col(start))


def unresolved_counts(saved: DataFrame, trusted: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """One row: saved, marked, and unresolved = saved less distinct trusted less marked."""
    flags = sets.flagged(sets.flagged(saved.select(key).distinct(), trusted, [key], "t"), excluded, [key], "x")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return flags.agg(F.count("*").alias("saved"), count(F.col("x")).alias("marked"), (F.count("*") - count(F.col("t")) - count(F.col("x"))).alias("unresolved"))


def discovery_candidates(sources: DataFrame, attached: DataFrame, suppressed: DataFrame, key: str, after=None, limit: int = 50, explicit: bool = False) -> DataFrame:
    """The next sources that belong to no track and, unless asked for, aren't suppressed."""
    free = sets.having(sources, attached, [key], False)
    free = free if explicit else sets.having(free, suppressed, [key], False)
    return keyset.page(free, [key], None if after is None else (after,), limit)


def attached(claims: DataFrame, occurrences: DataFrame, albums: DataFrame) -> DataFrame:
    """(source_id, track_id): sources whose occurrence claims lead to one track and whose album claims, if any, lead to that track's album alone. claims: source_id, scope, external_id, valid; occurrences: external_id, track_id, album_id; albums: external_id, album_id. A source with an invalid claim, or two of one scope, attaches to nothing."""
    per_scope = claims.groupBy("source_id", "scope").agg(F.countDistinct("external_id").alias("n"), F.min("valid").alias("ok"))
    doubtful = per_scope.where("n > 1 or not ok").select("source_id").distinct()
    sure = claims.join(doubtful, "source_id", "left_anti")
    direct = sure.where("scope = 'occurrence'").join(occurrences, "external_id").groupBy("source_id").agg(F.countDistinct("track_id").alias("n"), F.min("track_id").alias("track_id"), F.min("album_id").alias("album_id")).where("n = 1")
    own = sure.where("scope = 'album'").join(albums, "external_id").groupBy("source_id").agg(F.countDistinct("album_id").alias("m"), F.min("album_id").alias("claimed"))
    return direct.join(own, "source_id", "left").where("m is null or (m = 1 and claimed = album_id)").select("source_id", "track_id")


def same_context(artists: DataFrame) -> DataFrame:
    """(artist_id, canonical): artists of one directory with the same name key become the smallest of them, unless two of them have different identities in a namespace. artists: artist_id, directory, name, provider, external_id (null: none)."""
    keyed = artists.withColumn("name_key", text.normalize(F.col("name")))
    clash = keyed.where("external_id is not null").groupBy("directory", "name_key", "provider").agg(F.countDistinct("external_id").alias("n")).where("n > 1").select("directory", "name_key").distinct()
    fine = keyed.join(clash, ["directory", "name_key"], "left_anti")
    least = fine.groupBy("directory", "name_key").agg(F.min("artist_id").alias("canonical"))
    return fine.select("artist_id", "directory", "name_key").distinct().join(least, ["directory", "name_key"]).groupBy("artist_id").agg(F.min("canonical").alias("canonical"))


def credit_fallback(tracks: DataFrame, own: str, sources: DataFrame, albums: DataFrame) -> DataFrame:
    """(track_id, credit, from_album, conflict): a track's own credit, else the one all its sources agree on; with the album's identities where the names are the album's. sources: track_id, source_id, names; albums: album_id, names. Sources that disagree are a conflict."""
    agreed = sources.groupBy("track_id").agg(F.countDistinct("names").alias("n"), F.min("names").alias("s_names"))
    rows = tracks.join(agreed, "track_id", "left").join(albums.select("album_id", F.col("names").alias("a_names")), "album_id", "left")
    none = F.coalesce(F.trim(own) == "", F.lit(True))
    credit = F.when(~none, F.col(own)).when(F.col("n") == 1, F.col("s_names"))
    same = F.coalesce(text.normalize(credit) == text.normalize(F.col("a_names")), F.lit(False))
    return rows.select("track_id", credit.alias("credit"), same.alias("from_album"), F.coalesce(none & (F.col("n") > 1), F.lit(False)).alias("conflict"))


def rename_matches(albums: DataFrame, album_id: Column, title: Column, identities: DataFrame, limit: int = 20) -> DataFrame:
    """(album_id, blocked): albums that have the new title of a renamed one, blocked where trusted identities of a namespace differ."""
    others = albums.where((F.lower("title") == F.lower(title)) & (F.col("album_id") != album_id)).orderBy("album_id").limit(limit)
    mine = identities.where(F.col("album_id") == album_id).select("provider", "kind", F.col("external_id").alias("own"))
    theirs = identities.join(mine, ["provider", "kind"]).where("own <> external_id").select("album_id").distinct()
    return sets.flagged(others.select("album_id"), theirs, ["album_id"], "blocked")


def import_conflicts(lists: DataFrame, sources: DataFrame, provider: str, external_id: str, name: str) -> DataFrame:
    """(list_id, name, same_source): lists that an import would meet, by name whatever the case or by where they came from."""
    same = sources.where((F.col("provider") == provider) & (F.col("external_id") == external_id))
    return sets.flagged(lists, same, ["list_id"], "same_source").where((F.lower("name") == name.strip().lower()) | F.col("same_source")).orderBy(F.lower("name"), "list_id")


def local_match_candidates(wanted: DataFrame, editions: DataFrame, most: int = 200) -> DataFrame:
    """(release_id, track_id) of local editions with a wanted (title, credit): only where one edition has them and no more than `most` tracks."""
    counts = editions.groupBy("title", "credit").agg(F.countDistinct("release_id").alias("n"), F.count("*").alias("tracks")).where((F.col("n") == 1) & (F.col("tracks") <= most))
    return editions.join(wanted.select("title", "credit").distinct(), ["title", "credit"], "left_semi").join(counts.select("title", "credit"), ["title", "credit"], "left_semi").select("release_id", "track_id")


def corroborated(pairs: DataFrame) -> DataFrame:
    """(query_id, outcome, artist_id): pairs (query_id, artist_id, exact_name, album_outcome, complete): the one artist that an album supports, if its name is exact and the album matched; everything else stays ambiguous."""
    supported = F.col("album_outcome").isin("matched", "matched_close", "ambiguous")
    sure = F.col("album_outcome").isin("matched", "matched_close") & F.col("exact_name")
    g = pairs.groupBy("query_id").agg(F.min("complete").alias("complete"), F.sum(supported.cast("int")).alias("n"), F.max(supported & sure).alias("sure"), F.min(F.when(supported, F.col("artist_id"))).alias("winner"))
    good = F.col("complete") & (F.col("n") == 1) & F.col("sure")
    return g.select("query_id", F.when(good, "matched").otherwise("ambiguous").alias("outcome"), F.when(good, F.col("winner")).alias("artist_id"))
