"""Local re-evaluation of album sets to a fixed point, by semi-naive iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import kept


def reevaluate(tracks: DataFrame, credits: DataFrame, programs: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Tracks with state and round, and (round, evaluated, accepted) for each round.

    tracks: track_id, album_id, trusted, excluded, song_ok (its kept search page would accept it under an established artist), placed
    (the album's kept programme has it in its place); credits: track_id, artist_id; programs: album_id, needed.

    A pending track is accepted if song_ok holds and one of its artists is established, that is credited on a trusted or accepted track,
    or if it is placed and its album has at least `needed` trusted or accepted tracks. Both only ever gain by further acceptances, so
    the result doesn't depend on their order. The first round evaluates all; each later one only the pending tracks of albums that the
    tracks accepted last touch, through their own album or through artists that they newly establish. States: trusted, excluded, accepted,
    unresolved, or needs_retry where neither a page nor a programme is kept. Null flags count as false; tracks without an album
    have no programme; repeated rows and credits count once. The log of the rounds is only counted if it is read.
    """
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    tracks = kept(tracks.groupBy("track_id").agg(F.min("album_id").alias("album_id"), *(F.max(no(c)).alias(c) for c in ("trusted", "excluded", "song_ok", "placed"))))
    needed = programs.groupBy("album_id").agg(F.min("needed").alias("needed"))
    # What tracks would establish, and what artists and albums could unlock; the rounds only read these.
    open_ = tracks.where("NOT trusted AND NOT excluded")
    credits = kept(credits.where("artist_id IS NOT NULL").select("track_id", "artist_id").distinct())
    wanted = kept(credits.join(open_.where("song_ok").select("track_id", "album_id"), "track_id"))
    placed = kept(open_.where("placed").join(needed.where("needed IS NOT NULL"), "album_id").select("track_id", "album_id", "needed"))
    albums = open_.select("track_id", "album_id")
    delta = kept(tracks.where("trusted AND NOT excluded").select("track_id", "album_id"))
    artists, anchors, done = None, None, None
    rounds: list[DataFrame] = []
    while len(rounds) < most_rounds:
        number = len(rounds) + 1
        fresh = delta.join(credits, "track_id").select("artist_id").distinct()
        if artists is not None:
            fresh = fresh.join(artists, "artist_id", "left_anti")
        fresh = kept(fresh)
        artists = fresh if artists is None else artists.unionByName(fresh)
        counted = delta.where("album_id IS NOT NULL").groupBy("album_id").agg(F.count("*").alias("anchors"))
        anchors = kept(counted if anchors is None else anchors.unionByName(counted).groupBy("album_id").agg(F.sum("anchors").alias("anchors")))
        # A pending track that an artist established earlier or an album's earlier anchors unlock was accepted then.
        unlocked = wanted.join(fresh, "artist_id", "left_semi").select("track_id", "album_id").distinct()
        enough = placed.join(anchors.join(counted.select("album_id"), "album_id", "left_semi"), "album_id").where("anchors >= needed").select("track_id", "album_id")
        if number == 1:
            enough = enough.unionByName(placed.where("needed <= 0").select("track_id", "album_id"))
        passed = unlocked.unionByName(enough).distinct()
        pending = albums if done is None else albums.join(done.select("track_id"), "track_id", "left_anti")
        if number == 1:
            evaluated = albums
        else:
            touched = counted.select("album_id").unionByName(unlocked.where("album_id IS NOT NULL").select("album_id")).distinct()
            evaluated = pending.join(touched, "album_id", "left_semi").select("track_id").unionByName(pending.where("album_id IS NULL").join(unlocked.select("track_id"), "track_id", "left_semi").select("track_id"))
        delta = kept(passed if done is None else passed.join(done.select("track_id"), "track_id", "left_anti"))
        rounds.append(evaluated.agg(F.lit(number).alias("round"), F.count("*").alias("evaluated")).crossJoin(delta.agg(F.count("*").alias("accepted"))))
        if delta.isEmpty():
            break
        accepted = delta.select("track_id", F.lit(number).alias("round"))
        done = accepted if done is None else done.unionByName(accepted)
    else:
        raise RuntimeError(f"albums did not settle in {most_rounds} rounds")
    spark = tracks.sparkSession
    if done is None:
        done = spark.createDataFrame([], delta.select("track_id", F.lit(1).alias("round")).schema)
    state = F.when(F.col("excluded"), "excluded").when(F.col("trusted"), "trusted").when(F.col("round").isNotNull(), "accepted").when(F.col("song_ok") | F.col("has_program"), "unresolved").otherwise("needs_retry")
    out = tracks.join(done, "track_id", "left").join(programs.select("album_id").distinct().withColumn("has_program", F.lit(True)), "album_id", "left").na.fill({"has_program": False})
    log = rounds[0]
    for row in rounds[1:]:
        log = log.unionByName(row)
    return out.select("track_id", "album_id", state.alias("state"), "round"), log
