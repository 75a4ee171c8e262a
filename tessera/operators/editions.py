"""Editions and representations: which of several provider albums a local one is, and how they rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.linkage import MATCH_MS, certainty, within

#: Words that mark an edition, words that may stand beside them, endings without brackets, types that rank lower.
EDITION_MARKS = ["remaster", "remastered", "reissue", "deluxe", "expanded", "extended", "anniversary"]
EDITION_WORDS = ["edition", "version", "bonus", "tracks", "digital", "digitally"]
EDITION_ENDINGS = ["deluxe edition", "expanded edition", "extended edition", "anniversary edition", "remastered", "remaster", "reissue", "deluxe"]
SPECIAL_TYPES = ["Compilation", "Live", "Remix", "Soundtrack"]

#: Title classes with the weight they have in rankings.
TITLE_WEIGHT = {"exact": 5, "typography": 4, "release_type_suffix": 3, "artist_prefix": 3, "minor_typo": 2}


def _without_type(title: Column) -> tuple[Column, Column]:
    hint = F.nullif(F.regexp_extract(title, r"\S (ep|lp)$", 1), F.lit(""))
    return F.when(hint.isNotNull(), F.regexp_replace(title, r" (?:ep|lp)$", "")).otherwise(title), hint


def title_class(local: Column, provider: Column, primary_type: Column, single_as_ep: Column | bool = False) -> Column:
    """version_conflict, type_conflict, exact, release_type_suffix, typography, minor_typo or conflict. Titles must be in NFC."""
    a, b = text.album_representation_title(local, False), text.album_representation_title(provider, False)
    (x, xh), (y, yh) = _without_type(a), _without_type(b)
    kind = text.normalize(F.coalesce(primary_type, F.lit("")))
    fits = lambda h: h.isNull() | ((h == "ep") & ((kind == "ep") | (F.lit(single_as_ep) if isinstance(single_as_ep, bool) else single_as_ep) & (kind == "single"))) | ((h == "lp") & (kind == "album"))
    compatible = fits(xh) & fits(yh)
    strip = compatible & (xh.isNotNull() | yh.isNotNull())
    p, q = F.when(strip, x).otherwise(a), F.when(strip, y).otherwise(b)
    return (
        F.when(text.album_qualifiers(a) != text.album_qualifiers(b), "version_conflict").when(~compatible & (kind != ""), "type_conflict")
        .when(text.normalize(local) == text.normalize(provider), "exact").when(strip & (p == q), "release_type_suffix").when(a == b, "typography").when(text.edit_close(p, q, 1, 5), "minor_typo").otherwise("conflict")
    )


def edition_base(title: Column) -> Column:
    """The title's words without trailing edition annotations: bracketed, after a spaced dash, or one of the listed endings."""
    mark = "(?:" + "|".join(EDITION_MARKS) + ")"
    word = "(?:" + "|".join([*EDITION_MARKS, *EDITION_WORDS]) + "|[0-9]+(?:th|st|nd|rd)?)"
    gap = f"[^{text.ALNUM}()]+"
    note = f"(?:{word}{gap})*{mark}(?:{gap}{word})*"
    plain = F.regexp_replace(text.normalize(title), rf"(?<=\S)(?: \({note}\)| - {note})+$", "")
    return text.album_representation_title(F.regexp_replace(plain, r"(?<=\S) (?:" + "|".join(EDITION_ENDINGS) + ")$", ""), False)


def playable_edition_pair(local: Column, provider: Column) -> Column:
    """The same title once edition annotations are taken off, of which there is one at least."""
    a, b = edition_base(local), edition_base(provider)
    changed = (a != text.album_representation_title(text.normalize(local), False)) | (b != text.album_representation_title(text.normalize(provider), False))
    return changed & (a != "") & (a == b)


def title_query_variant(title: Column) -> Column:
    """One more title to search for: slashes between spaces, or without an edition annotation in brackets; else null."""
    spaced = F.array_join(F.transform(F.split(title, "/"), F.trim), " / ")
    base = F.regexp_extract(title, r"(?s)^(.*) \([^)]*\)$", 1)
    return F.when(spaced != title, spaced).when((base != "") & playable_edition_pair(title, base), base)


def release_type_compatible(known: Column, candidate: Column, single_as_ep: Column) -> Column:
    a, b = text.normalize(known), text.normalize(candidate)
    return (a == "") | (b == "") | (a == b) | (single_as_ep & (a == "ep") & (b == "single"))


def track_reports(pairs: DataFrame) -> DataFrame:
    """Pairs (local and c_ for the candidate: title, artist, recording, isrc, duration_ms; the candidate's may be null) with supported and contradiction."""
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    both = lambda c: known(c) & known(f"c_{c}")
    same = lambda c: F.coalesce(both(c) & (F.col(c) == F.col(f"c_{c}")), F.lit(False))
    differs = lambda c: F.coalesce(both(c) & (F.col(c) != F.col(f"c_{c}")), F.lit(False))
    titles = both("title") & (text.normalize(F.col("title")) == text.normalize(F.col("c_title")))
    artists = both("artist") & (text.normalize(F.col("artist")) != text.normalize(F.col("c_artist")))
    contradiction = differs("recording") | (~within(F.col("duration_ms"), F.col("c_duration_ms"), MATCH_MS) & ~same("recording"))
    no = lambda c: F.coalesce(c, F.lit(False))
    out = pairs.withColumn("contradiction", contradiction)
    return out.withColumn("supported", ~F.col("contradiction") & (same("recording") | (no(titles) & ~no(artists) & ~differs("isrc"))))


def editions(candidates: DataFrame) -> DataFrame:
    """(album, assessment) from candidates (album, candidate, kind, exact_identity, complete): kind is exact_edition, content_equivalent, album_only, insufficient or contradictory. A contradictory candidate that is positively identified blocks; content counts only as the one candidate of a complete page that isn't contradicted."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    is_ = lambda k: F.col("kind") == k
    g = candidates.groupBy("album").agg(
        n(is_("exact_edition")).alias("exact"), n(is_("content_equivalent")).alias("content"), n(~is_("contradictory")).alias("open"), F.count("*").alias("all"),
        n(is_("album_only")).alias("only"), n(is_("contradictory") & F.col("exact_identity")).alias("blocked"), F.min("complete").alias("complete"))
    c = F.col
    outcome = certainty({
        "contradictory": c("blocked") > 0, "ambiguous": c("exact") > 1, "exact_edition": c("exact") == 1, "ambiguous_content": c("content") > 1,
        "content_equivalent": (c("content") == 1) & c("complete") & (c("open") == 1), "ambiguous_open": c("content") == 1, "album_only": c("only") > 0, "all_contradictory": c("open") == 0,
    }, "insufficient_evidence")
    plain = F.when(outcome.startswith("ambiguous"), "ambiguous").when(outcome == "all_contradictory", "contradictory").otherwise(outcome)
    return g.select("album", plain.alias("assessment"))


def representation_fit(programs: DataFrame) -> DataFrame:
    """(group, candidate, fit) from programmes (group, candidate, program, complete, tracks, required, conflicts, unmatched, mismatches, local): supported if one explains all, uncertain if one leaves a little open or any is incomplete, else rejected."""
    rejected = (F.col("tracks") < F.col("required")) | (F.col("conflicts") > 0) | (F.col("unmatched") >= 2) | (F.col("mismatches") >= 2)
    g = programs.groupBy("group", "candidate").agg(F.min("complete").alias("complete"), F.max(~rejected & (F.col("local") > 0) & (F.col("unmatched") == 0)).alias("whole"), F.max(~rejected).alias("some"))
    return g.select("group", "candidate", F.when(~F.col("complete"), "uncertain").when(F.col("whole"), "supported").when(F.col("some"), "uncertain").otherwise("rejected").alias("fit"))


def ranked_report(candidates: DataFrame, group: str) -> DataFrame:
    """Adds place: by decision, artist, title class, anchors, fewer warnings, fewer reasons, identity."""
    decision = F.when(F.col("decision") == "accepted", 2).when(F.col("decision") == "rejected", 0).otherwise(1)
    weight = F.coalesce(F.create_map(*[F.lit(v) for kv in TITLE_WEIGHT.items() for v in kv])[F.col("title_class")], F.lit(0))
    order = [decision.desc(), F.col("artist_accepted").desc(), weight.desc(), F.col("anchors").desc(), F.col("warnings").asc(), F.col("reasons").asc(), F.col("candidate_id").asc()]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def discovery_rank(candidates: DataFrame, group: str) -> DataFrame:
    """Adds place: the artist's own, related titles, years within one, no special types, no other release type; ties by id."""
    year = F.coalesce(F.abs(F.col("year") - F.col("c_year")) <= 1, F.lit(False))
    plain = ~F.arrays_overlap("secondary_types", F.array(*map(F.lit, SPECIAL_TYPES)))
    order = [F.col("scoped").desc(), F.col("related").desc(), year.desc(), plain.desc(), (~F.col("type_conflict")).desc(), F.col("candidate_id").asc()]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def evaluation(rows: DataFrame) -> DataFrame:
    """Adds blocker: the first gate that stops a candidate from being accepted, null where none does. Gates are boolean columns, in this order."""
    gates = {
        "manually_excluded": F.col("excluded"), "invalid_candidate_identity": F.col("invalid_identity"), "recording_identity_conflict": F.col("recording_conflict"), "trusted_identity_conflict": F.col("trusted_conflict"),
        "existing_provider_association": F.col("existing"), "": F.col("accepted"), "competing_playable": F.col("playable") & F.col("page_complete"), "structural_conflict": F.col("reasons") > 0,
        "album_context_missing": F.trim("album") == "", "duration_threshold": ~F.col("duration_ok"), "incomplete_candidate_page": ~F.col("page_complete"), "stronger_candidate": F.col("dominated"),
        "competing_candidates": F.col("plausible") > 1, "artist_credit_incomplete": ~F.col("credits_ok"),
    }
    return rows.withColumn("blocker", F.when(~F.col("trusted_here"), F.nullif(certainty(gates, ""), F.lit(""))))


def consolidated(tracks: DataFrame) -> DataFrame:
    """Candidates of programmes by their recordings' identities, else their own, else alone: (key, programs, title, duration_ms, disc, number), the first by title, length, disc and number. tracks: program, index, recordings, identities, title, duration_ms, disc, number."""
    ids = F.when(F.size("recordings") > 0, F.col("recordings")).otherwise(F.col("identities"))
    kind = F.when(F.size("recordings") > 0, "r").when(F.size("identities") > 0, "i")
    key = F.when(kind.isNotNull(), F.concat_ws("|", kind, F.array_join(F.array_sort(F.array_distinct(ids)), ","))).otherwise(F.concat_ws("|", F.lit("n"), F.col("program").cast("string"), F.col("index").cast("string")))
    first = F.min(F.struct("title", "duration_ms", "disc", "number"))
    return tracks.groupBy(key.alias("key")).agg(F.countDistinct("program").alias("programs"), first.alias("f")).select("key", "programs", "f.*")


def gain(master: Column, decibels: Column) -> Column:
    """A level from 0 to 1 trimmed by decibels."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), master * F.pow(F.lit(10.0), decibels / 20)))
