"""Token-prefix search in sections with score tiers and contextual expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import matches_all_prefixes, query_tokens, score_tier, search_tokens
from tessera.operators import keyset
from tessera.operators.graph import cut

SECTION, SEEDS, CONTEXT_SCORE = 40, 16, 4


def prefix_hits(rows: DataFrame, id_col: str, title: str, text: str, searched: str | None = None) -> DataFrame:
    """(id, title, score) of rows in whose searched text every word of the query begins a word."""
    hits = rows.where(matches_all_prefixes(search_tokens(F.col(searched or title)), query_tokens(text)))
    return hits.select(F.col(id_col).alias("id"), F.col(title).alias("title"), score_tier(F.col(title), text).alias("score"))


def best(hits: DataFrame, limit: int = SECTION) -> DataFrame:
    """One row an id, with its best score; the first of the section by score, title and id."""
    one = hits.groupBy("id").agg(F.min("score").alias("score"), F.min("title").alias("title"))
    return one.withColumn("key", F.lower("title")).orderBy("score", "key", "id").limit(limit).drop("key")


def sections(artists: DataFrame, albums: DataFrame, tracks: DataFrame, credits: DataFrame, text: str) -> DataFrame:
    """(section, id, title, score), up to 40 rows each.

    artists (artist_id, name), albums (album_id, title), tracks (track_id, album_id, title), all of
    them saved; credits (track_id, artist_id). Tracks of the first 16 artists and albums that match, and
    albums of those artists' tracks, are hits of score 4.
    """
    artist_hits, album_hits = (cut(best(prefix_hits(rows, *names, text))) for rows, names in ((artists, ("artist_id", "name")), (albums, ("album_id", "title"))))  # a section each, used three times
    artist_seeds, album_seeds = (h.orderBy("score", F.lower("title"), "id").limit(SEEDS).select("id") for h in (artist_hits, album_hits))
    of_artists = credits.join(F.broadcast(artist_seeds.withColumnRenamed("id", "artist_id")), "artist_id", "left_semi").select("track_id").distinct()
    context = F.lit(CONTEXT_SCORE).alias("score")
    credited = tracks.join(of_artists, "track_id", "left_semi")
    of_albums = tracks.join(F.broadcast(album_seeds.withColumnRenamed("id", "album_id")), "album_id", "left_semi")
    song = lambda df: df.select(F.col("track_id").alias("id"), "title", context)
    songs = best(prefix_hits(tracks, "track_id", "title", text).unionByName(song(credited)).unionByName(song(of_albums)))
    more = albums.join(credited.select("album_id").distinct(), "album_id", "left_semi").select(F.col("album_id").alias("id"), "title", context)
    found = {"artist": artist_hits, "album": best(album_hits.unionByName(more)), "song": songs}
    parts = [df.select(F.lit(k).alias("section"), F.col("id").cast("string").alias("id"), "title", "score") for k, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def track_search(tracks: DataFrame, text: str, searched: str, title: str, id_col: str, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """A page of tracks by title and id whose searched text has all words of the query as prefixes; an empty query finds all."""
    hits = tracks.where(matches_all_prefixes(search_tokens(F.col(searched)), query_tokens(text))) if query_tokens(text) else tracks
    return keyset.page(hits, [title, id_col], after, min(limit, 200))


def ranked(hits: DataFrame, query: str, kind: str, title: str, ordinal: str, kinds: Sequence[str] = ("artist", "album")) -> DataFrame:
    """Provider hits by kind and textual tier (equal, contains, all words as prefixes, rest), in the provider's order within a tier."""
    wanted = " ".join(query.lower().split())
    t = F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))
    tier = F.when(t == wanted, 0).when(F.contains(t, F.lit(wanted)), 1).when(matches_all_prefixes(search_tokens(t), query_tokens(query)), 2).otherwise(3)
    order = F.lit(len(kinds))
    for i, k in reversed(list(enumerate(kinds))):
        order = F.when(F.col(kind) == k, i).otherwise(order)
    return hits.withColumn("kind_rank", order).withColumn("tier", tier).orderBy("kind_rank", "tier", ordinal)
