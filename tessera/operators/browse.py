"""Browsing: a request becomes one plan over the catalogue's tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import effective, keyset, sets

NO_NUMBER = 2_147_483_647


@dataclass(frozen=True)
class Catalogue:
    """tracks: track_id, album_id, title, disc, number, year, genre; albums: album_id, title, year, artist_id, artist; artists: artist_id, name;
    credits: track_id, artist_id; saved: track_id; available: track_id; hidden: artist_id; ignored: track_id."""

    tracks: DataFrame
    albums: DataFrame
    artists: DataFrame
    credits: DataFrame
    saved: DataFrame
    available: DataFrame
    hidden: DataFrame
    ignored: DataFrame


@dataclass(frozen=True)
class Request:
    pane: str = "songs"  # artists, albums, genres, songs
    sort: str = "title"  # albums: title, year, artist; songs: title, artist, album, genre, program
    artists: list = field(default_factory=list)
    albums: list = field(default_factory=list)
    genres: list = field(default_factory=list)
    tracks: list = field(default_factory=list)
    available: bool | None = None
    hide: bool = True
    ignored_only: bool = False
    saved_only: bool = True
    after: tuple | None = None
    limit: int | None = 50
    descending: bool = False
    reverse: bool = False
    inclusive: bool = False
    ids_only: bool = False


def scope(c: Catalogue, r: Request) -> DataFrame:
    """The tracks a request is about."""
    t = sets.having(c.tracks, c.saved, ["track_id"]) if r.saved_only and not r.ignored_only else c.tracks
    t = sets.matching(t, {"album_id": r.albums, "genre": r.genres, "track_id": r.tracks})
    if r.artists:
        t = t.join(sets.in_list(c.credits, "artist_id", r.artists).select("track_id").distinct(), "track_id", "left_semi")
    t = sets.having(t, c.available, ["track_id"], r.available)
    if r.ignored_only:
        return sets.having(t, c.ignored, ["track_id"])
    if r.hide:
        t = sets.having(t, c.ignored, ["track_id"], False)
        t = t.join(c.credits.join(c.hidden, "artist_id", "left_semi").select("track_id").distinct(), "track_id", "left_anti")
    return t


def song_keys(sort: str) -> dict[str, Column]:
    if sort == "program":
        return {"k_year": effective.year_key(F.col("album_year")), "k_title": F.lower("album_title"), "k_album": F.col("album_id"), "k_disc": F.coalesce("disc", F.lit(1)), "k_number": F.coalesce("number", F.lit(NO_NUMBER))}
    column = {"title": "title", "artist": "artist_names", "album": "album_title", "genre": "genre"}[sort]
    return {"k_text": F.lower(F.coalesce(column, F.lit("")))}


def _page(df: DataFrame, keys: list[str], r: Request) -> DataFrame:
    return keyset.page(df, keys, r.after, r.limit, r.descending, r.reverse, r.inclusive)


def browse(c: Catalogue, r: Request) -> DataFrame:
    """One page. Ids and keys are chosen first; display columns are joined to the chosen rows only."""
    t = scope(c, r)
    if r.pane == "genres":
        rows = t.where(F.col("genre").isNotNull()).select("genre").distinct().select(F.lower("genre").alias("k_text"), F.col("genre").alias("id"))
        return _page(rows, ["k_text", "id"], r)
    if r.pane == "artists":
        ids = c.credits.join(t.select("track_id"), "track_id", "left_semi").select("artist_id").distinct()
        ids = sets.having(ids, c.hidden, ["artist_id"], False) if r.hide else ids
        rows = c.artists.join(ids, "artist_id").select(F.lower("name").alias("k_text"), F.col("artist_id").alias("id"), F.col("name").alias("title"))
        return _page(rows, ["k_text", "id"], r)
    if r.pane == "albums":
        rows = c.albums.join(t.select("album_id").distinct(), "album_id", "left_semi")
        keys = {"year": {"k_year": effective.year_key(F.col("year")), "k_title": F.lower("title")}, "artist": {"k_artist": F.lower(F.coalesce("artist", F.lit(""))), "k_artist_id": F.coalesce("artist_id", F.lit(-1)), "k_title": F.lower("title")}}.get(r.sort, {"k_title": F.lower("title")})
        rows = rows.select(*[k.alias(n) for n, k in keys.items()], F.col("album_id").alias("id"), *([] if r.ids_only else ["title", "year"]))
        return _page(rows, [*keys, "id"], r)
    wide = t
    if r.sort in ("program", "album"):
        wide = t.join(c.albums.select("album_id", F.col("title").alias("album_title"), F.col("year").alias("album_year")), "album_id")
    if r.sort == "artist":
        names = c.credits.join(c.artists, "artist_id").groupBy("track_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("artist_names"))
        wide = t.join(names, "track_id", "left")
    keys = song_keys(r.sort)
    chosen = _page(wide.select(*[k.alias(n) for n, k in keys.items()], F.col("track_id").alias("id")), [*keys, "id"], r)
    if r.ids_only:
        return chosen
    shown = c.tracks.select(F.col("track_id").alias("id"), "title", F.col("album_id").alias("of_album"))
    albums = c.albums.select(F.col("album_id").alias("of_album"), F.col("title").alias("of_title"))
    out = chosen.join(shown, "id").join(albums, "of_album", "left")
    return sets.flagged(out, c.available.withColumnRenamed("track_id", "id"), ["id"], "is_available")


def queue(c: Catalogue, r: Request, explicit: DataFrame | None = None) -> DataFrame:
    """All tracks of a request in order, numbered from 0; ignored ones only where explicitly asked for. For playback: a queue is one user's list."""
    t = scope(c, r)
    if explicit is not None:
        t = t.unionByName(c.tracks.join(explicit, "track_id", "left_semi")).dropDuplicates(["track_id"])
    keys = song_keys("title")
    return t.select(*[k.alias(n) for n, k in keys.items()], F.col("track_id").alias("id")).orderBy(*keys, "id")
