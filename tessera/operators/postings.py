"""A sorted prefix index: postings range-partitioned by field and token, so that a prefix is a range the scan is pruned by."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import score_tier, search_tokens
from tessera.operators import incremental
from tessera.operators.graph import cut
from tessera.operators.search import CONTEXT_SCORE, SEEDS, best
from tessera.sources import segments

KEY = ["kind", "id"]
#: Above every letter and digit in UTF-8 order, so that [word, word + LAST) holds the tokens that begin with word.
LAST = "\U0010ffff"
WORD = "word"


def postings(rows: DataFrame) -> DataFrame:
    """(field, token, kind, id, position, title) of rows (kind, id, title, text, terms).

    Words of the text have the field 'word' and their position; terms, an array of (field, token), stand for exact links such as a track's
    artists. Null texts and terms have no postings. A row's text is split by one task, so texts may be long but their words aren't collected.
    """
    words = rows.select(*KEY, "title", F.posexplode(search_tokens(F.col("text"))).alias("position", "token")).withColumn("field", F.lit(WORD))
    terms = rows.select(*KEY, "title", F.explode(F.array_distinct("terms")).alias("t")).select(*KEY, "title", F.col("t.field").alias("field"), F.col("t.token").alias("token"), F.lit(0).alias("position"))
    columns = ["field", "token", *KEY, "position", "title"]
    return words.select(columns).unionByName(terms.where("token IS NOT NULL").select(columns))


def apply(spark: SparkSession, path: str, epoch: int, changes: DataFrame, links: DataFrame | None = None) -> None:
    """Takes a batch of changes (kind, id, title, text, terms, seq, deleted) into the index at path; into an empty one, the batch is its base.

    Of several changes of one (kind, id) the last by seq counts; null deleted is false. The batch becomes a segment with the ids it
    replaces; links (kind, id, field, token) are more terms of the batch's rows, for rows that have too many for an array; once segments are many or large, all of them and the batch are merged into one and the old postings go. A batch
    that runs again gives the same index; epochs must rise, but needn't start at 0 or be without gaps.
    """
    last = cut(incremental.latest(changes.withColumn("deleted", F.coalesce("deleted", F.lit(False))), KEY, ["seq", "deleted"]))  # read by both parts, and again to find their ranges
    before = segments.listed(spark, path, before=epoch)
    new = postings(last.where("NOT deleted"))
    if links is not None:
        named = links.where("token IS NOT NULL").select(*KEY, "field", "token").distinct().join(last.where("NOT deleted").select(*KEY, "title"), KEY)
        new = new.unionByName(named.withColumn("position", F.lit(0)).select(new.columns))
    if segments.due(before):
        replaced = last.select(KEY)
        new = new.unionByName(segments.live(spark, path, "postings", before).join(replaced, KEY, "left_anti").select(new.columns))
        before = []
    ids = last.select(*KEY)
    sort = ["field", "token", *KEY, "position"]
    segments.commit(spark, path, epoch, {"postings": segments.Part(new, sort), "ids": segments.Part(ids, KEY)}, before, "postings")


def live(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Postings that count."""
    return segments.live(spark, path, "postings", where=where)


def phrases(text: str, most: int = 12) -> list[list[str]]:
    """Words of each run between spaces: a run with inner punctuation is a phrase. At most so many words in all."""
    out, left = [], most
    for run in text.lower().split():
        if words := [w for w in re.split(r"[\W_]+", run) if w][:left]:
            out.append(words)
            left -= len(words)
    return out


def found(spark: SparkSession, path: str, text: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """(kind, id, title) of rows that have every phrase of the query: its words side by side, the last one as a prefix. An empty query finds none.

    All ranges are read in one pass; a posting gives the place where its phrase would begin, so the aggregate by row and phrase
    is combined before the shuffle and no list of positions is gathered.
    """
    wanted = phrases(text)
    token, rows = F.col("token"), []
    reach = lambda words, k: (token >= words[k]) & (token < words[k] + LAST) if k == len(words) - 1 else token == words[k]
    for p, words in enumerate(wanted):
        rows += [F.when(reach(words, k), F.struct(F.lit(p).alias("phrase"), F.lit(1 << k).alias("word"), (F.col("position") - k if len(words) > 1 else F.lit(0)).alias("start"))) for k in range(len(words))]
    ranges = reduce(lambda a, b: a | b, [reach(words, k) for words in wanted for k in range(len(words))], F.lit(False))
    where = (F.col("field") == WORD) & ranges
    if kinds is not None:
        where = where & F.col("kind").isin(*kinds)
    hits = live(spark, path, where=where)
    if not wanted:
        return hits.select(*KEY, "title")
    single = all(len(words) == 1 for words in wanted)
    if single:
        bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(reach(words, 0), 1 << p).otherwise(0) for p, words in enumerate(wanted)])
        return hits.groupBy(*KEY).agg(F.bit_or(bits).alias("__seen"), F.min("title").alias("title")).where(F.col("__seen") == (1 << len(wanted)) - 1).select(*KEY, "title")
    each = hits.select(*KEY, "title", F.explode(F.array_compact(F.array(*rows))).alias("h")).select(*KEY, "title", "h.*")
    size = F.element_at(F.array(*[F.lit((1 << len(words)) - 1) for words in wanted]), F.col("phrase") + 1)
    whole = each.groupBy(*KEY, "phrase", "start").agg(F.bit_or("word").alias("seen"), F.min("title").alias("title")).where(F.col("seen") == size)
    met = whole.groupBy(*KEY).agg(F.bit_or(F.element_at(F.array(*[F.lit(1 << p) for p in range(len(wanted))]), F.col("phrase") + 1)).alias("seen"), F.min("title").alias("title"))
    return met.where(F.col("seen") == (1 << len(wanted)) - 1).select(*KEY, "title")


def linked(spark: SparkSession, path: str, field: str, tokens: Sequence[object], kind: str) -> DataFrame:
    """(id, title) of rows of a kind that have one of the terms."""
    where = (F.col("field") == field) & F.col("token").isin(*[str(t) for t in tokens]) & (F.col("kind") == kind)
    return live(spark, path, where=where).select("id", "title").distinct()


def sections(spark: SparkSession, path: str, text: str) -> DataFrame:
    """What search.sections() gives, (section, id, title, score), out of the index alone.

    Kinds artist, album and song; songs have the terms (artist, id) of their credits and (album, id), albums (artist, id) of their songs'.
    A section has 40 rows at most and 32 seeds come to the driver, to be ranges of the next scan.
    """
    words = " ".join(w for p in phrases(text) for w in p)  # here every word is a prefix of its own
    hits = found(spark, path, words).withColumn("score", score_tier(F.col("title"), text))
    of = lambda kind: best(hits.where(F.col("kind") == kind).select("id", "title", "score"))
    firsts = of("artist").withColumn("section", F.lit("artist")).unionByName(of("album").withColumn("section", F.lit("album"))).collect()
    made = lambda section: spark.createDataFrame([(r.id, r.title, r.score) for r in firsts if r.section == section], "id long, title string, score int")
    order = lambda section: [r.id for r in sorted((r for r in firsts if r.section == section), key=lambda r: (r.score, r.title.lower(), r.id))][:SEEDS]
    context = lambda df: df.select("id", "title", F.lit(CONTEXT_SCORE).alias("score"))
    artists, albums = order("artist"), order("album")
    songs, more = hits.where("kind = 'song'").select("id", "title", "score"), made("album")
    if artists:
        songs = songs.unionByName(context(linked(spark, path, "artist", artists, "song")))
        more = more.unionByName(context(linked(spark, path, "artist", artists, "album")))
    if albums:
        songs = songs.unionByName(context(linked(spark, path, "album", albums, "song")))
    parts = [df.select(F.lit(k).alias("section"), F.col("id").cast("string").alias("id"), "title", "score") for k, df in {"artist": made("artist"), "album": best(more), "song": best(songs)}.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
