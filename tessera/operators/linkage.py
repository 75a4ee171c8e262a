"""Record linkage that decides only where the evidence is complete and unambiguous.

Every decision is a grouped plan: candidates are joined on blocking keys, counted per subject, and the
count decides. Incomplete evidence withholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import graph

MATCH_MS, PROVIDER_MS = 3_000, 10_000


def within(a: Column, b: Column, most: int) -> Column:
    """True unless both are known and differ by more."""
    return F.coalesce(F.abs(a - b) <= most, F.lit(True))


def decided(pairs: DataFrame, subjects: DataFrame, subject: str, candidate: str, complete: str | None = None) -> DataFrame:
    """(subject, outcome, candidate): matched for exactly one distinct candidate, ambiguous for several, none; incomplete where the subject's page is."""
    counts = pairs.groupBy(subject).agg(F.countDistinct(candidate).alias("__n"), F.min(candidate).alias("__c"))
    out = subjects.join(counts, subject, "left")
    n = F.coalesce("__n", F.lit(0))
    outcome = F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("none")
    if complete:
        outcome = F.when(~F.col(complete), "incomplete").otherwise(outcome)
    return out.select(subject, outcome.alias("outcome"), F.when(outcome == "matched", F.col("__c")).alias(candidate))


def recordings(local: DataFrame, candidates: DataFrame) -> DataFrame:
    """local (track_id, title, artist, duration_ms, known, complete), candidates (track_id, candidate_id, title, artist, duration_ms): equal titles, equal usable artists, known lengths within 3 s."""
    a, b = local.alias("a"), candidates.alias("b")
    same = text.normalize(F.col("a.title")) == text.normalize(F.col("b.title"))
    artist = ~text.usable(F.col("a.artist")) | ~text.usable(F.col("b.artist")) | (text.normalize(F.col("a.artist")) == text.normalize(F.col("b.artist")))
    pairs = a.join(b, F.col("a.track_id") == F.col("b.track_id")).where(same & F.coalesce(artist, F.lit(True)) & within(F.col("a.duration_ms"), F.col("b.duration_ms"), MATCH_MS) & (F.col("candidate_id") != ""))
    out = decided(pairs.select("a.track_id", "candidate_id"), local, "track_id", "candidate_id", "complete")
    return out.join(local.select("track_id", "known"), "track_id").withColumn("outcome", F.when(F.col("known"), "already_matched").otherwise(F.col("outcome"))).withColumn("candidate_id", F.when(~F.col("known"), F.col("candidate_id"))).drop("known")


def artists(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """queries (query_id, name, complete), candidates (query_id, candidate_id, name, aliases). A unique exact name or alias wins; an alias can be vetoed by another candidate within one edit; incomplete pages stay ambiguous."""
    key = lambda c: text.name_key(c)
    names = candidates.where("candidate_id <> ''").select("query_id", "candidate_id", F.col("name").alias("main"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("any_name"))
    named = names.select("query_id", "candidate_id", key(F.col("main")).alias("main"), key(F.col("any_name")).alias("any_name"))
    asked = queries.select("query_id", "complete", key(F.col("name")).alias("wanted"))
    joined = named.join(asked, "query_id")
    each = joined.groupBy("query_id", "complete", "candidate_id").agg(F.max(F.col("any_name") == F.col("wanted")).alias("exact"), F.max(F.col("main") == F.col("wanted")).alias("by_main"), F.max(text.edit_close(F.col("wanted"), F.col("any_name"), 1, 1)).alias("close"))
    g = each.groupBy("query_id", "complete").agg(F.sum(F.col("exact").cast("int")).alias("n"), F.max(F.col("exact") & F.col("by_main")).alias("by_main"), F.sum((F.col("close") & ~F.col("exact")).cast("int")).alias("rivals"), F.min(F.when(F.col("exact"), F.col("candidate_id"))).alias("winner"))
    outcome = F.when(F.coalesce("n", F.lit(0)) == 0, "none").when((F.col("n") > 1) | (~F.col("by_main") & (F.col("rivals") > 0)) | ~F.col("complete"), "ambiguous").otherwise("matched")
    return asked.select("query_id").join(g, "query_id", "left").select("query_id", outcome.alias("outcome"), F.when(outcome == "matched", F.col("winner")).alias("candidate_id"))


def albums(queries: DataFrame, candidates: DataFrame, composed: bool = True) -> DataFrame:
    """queries (query_id, title, complete), candidates (query_id, candidate_id, title, primary_type): equal titles, else titles without a format suffix, else close ones. More than one of the best kind, or an incomplete page, is ambiguous."""
    form = lambda df: df.withColumn("title", text.nfc("title")) if composed else df
    asked = form(queries).select("*", text.normalize_album_title(F.col("title"), False).alias("own"))
    offered = form(candidates).select("query_id", "candidate_id", F.col("title").alias("c_title"), F.lower("primary_type").alias("kind"), text.normalize_album_title(F.col("title"), False).alias("other"))
    pairs = offered.join(asked, "query_id")
    own, other = F.col("own"), F.col("other")
    variant = F.exists(text.album_title_variants(F.col("title"), False), lambda v: (v["title"] == other) & (~v["requires_ep"] | (F.col("kind") == "ep")) & (~v["requires_album"] | (F.col("kind") == "album")))
    rank = F.when(own == other, 1).when(variant, 2).when(text.close_album_title(F.col("title"), F.col("c_title"), False), 3)
    ranked = pairs.withColumn("rank", rank).where("rank is not null").withColumn("best", F.min("rank").over(Window.partitionBy("query_id"))).where("rank = best")
    g = ranked.groupBy("query_id").agg(F.countDistinct("candidate_id").alias("n"), F.min("candidate_id").alias("winner"), F.min("rank").alias("rank"))
    out = queries.select("query_id", "complete").join(g, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    outcome = F.when(~F.col("complete") | (n > 1), "ambiguous").when(n == 0, "none").when(F.col("rank") == 1, "matched").otherwise("matched_close")
    return out.select("query_id", outcome.alias("outcome"), F.when(outcome.startswith("matched"), F.col("winner")).alias("candidate_id"))


def position_support(local: DataFrame, edition: DataFrame, group: Sequence[str] = ("album_id", "edition_id")) -> DataFrame:
    """(album_id, edition_id, supported): local (album_id, disc, number, title), edition (album_id, edition_id, disc, number, title). Each local position that the edition has must be unique there and have the same title, and one must."""
    at = edition.groupBy(*group, "disc", "number").agg(F.count("*").alias("n"), F.min("title").alias("e_title"))
    pairs = at.join(local, ["album_id", "disc", "number"])
    good = (F.col("n") == 1) & (F.col("e_title") == F.col("title"))
    checked = pairs.groupBy(*group).agg(F.min(good).alias("supported"))
    return edition.select(*group).distinct().join(checked, list(group), "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def alignment(local: DataFrame, program: DataFrame, group: str = "group_id") -> DataFrame:
    """(group_id, local_index, provider_index, kind): both sides have group_id, an index, title_key, duration_ms, disc, number and, if known, identity; program has complete.

    Titles agree and known lengths differ by 10 s at most, or identities are equal; different identities
    veto a pair. A pair counts if it is the only one of both sides. With three pairs that are four fifths
    of both sides an alignment is strong: in order, local rows without candidates were inserted; out of
    order, pairs are reordered; the rest is exact by position or by title, unmatched, or missing locally.
    """
    known = lambda df: F.col("identity").cast("string") if "identity" in df.columns else F.lit(None).cast("string")
    left = local.select(group, F.col("index").alias("local_index"), F.col("title_key").alias("l_title"), F.col("duration_ms").alias("l_ms"), F.col("disc").alias("l_disc"), F.col("number").alias("l_number"), known(local).alias("l_id"))
    right = program.select(group, F.col("index").alias("provider_index"), F.col("title_key").alias("r_title"), F.col("duration_ms").alias("r_ms"), F.col("disc").alias("r_disc"), F.col("number").alias("r_number"), known(program).alias("r_id"), "complete")
    by_title = left.join(right.withColumnRenamed("r_title", "l_title"), [group, "l_title"]).where(within(F.col("l_ms"), F.col("r_ms"), PROVIDER_MS) & (F.col("l_id").isNull() | F.col("r_id").isNull() | (F.col("l_id") == F.col("r_id"))))
    pairs = by_title.select(group, "local_index", "provider_index", "l_disc", "l_number", "r_disc", "r_number")
    if "identity" in local.columns and "identity" in program.columns:
        by_identity = left.join(right.withColumnRenamed("r_id", "l_id"), [group, "l_id"])
        pairs = pairs.unionByName(by_identity.select(*pairs.columns)).distinct()
    pairs = pairs.withColumn("of_l", F.count("*").over(Window.partitionBy(group, "local_index"))).withColumn("of_r", F.count("*").over(Window.partitionBy(group, "provider_index")))
    tried = pairs.select(group, "local_index").distinct().withColumn("tried", F.lit(True))
    unique = pairs.where("of_l = 1 and of_r = 1").select(group, "local_index", "provider_index", ((F.col("l_disc") == F.col("r_disc")) & (F.col("l_number") == F.col("r_number"))).alias("same_place"))
    unique = unique.withColumn("falls", F.coalesce(F.col("provider_index") <= F.lag("provider_index").over(Window.partitionBy(group).orderBy("local_index")), F.lit(False)))
    sizes = left.groupBy(group).agg(F.count("*").alias("n_local")).join(right.groupBy(group).agg(F.count("*").alias("n_program"), F.min("complete").alias("complete")), group)
    of_group = sizes.join(unique.groupBy(group).agg(F.count("*").alias("matched"), F.max("falls").alias("fell")), group, "left").na.fill({"matched": 0}).withColumn("ordered", ~F.coalesce("fell", F.lit(False)))
    of_group = of_group.withColumn("strong", F.col("complete") & (F.col("matched") >= 3) & (F.col("matched") * 5 >= F.col("n_local") * 4) & (F.col("matched") * 5 >= F.col("n_program") * 4)).select(group, "strong", "ordered")
    rows = left.select(group, "local_index").join(of_group, group).join(unique, [group, "local_index"], "left").join(tried, [group, "local_index"], "left")
    kind = F.when(F.col("provider_index").isNull(), F.when(F.col("strong") & F.col("ordered") & F.col("tried").isNull(), "inserted_local").otherwise("unmatched")).when(~F.col("ordered"), "reordered").when(F.coalesce("same_place", F.lit(False)), "exact").otherwise("title_normalized")
    found = rows.select(group, "local_index", "provider_index", kind.alias("kind"))
    missing = right.select(group, "provider_index").join(unique.select(group, "provider_index"), [group, "provider_index"], "left_anti")
    return found.unionByName(missing.select(group, F.lit(None).cast(left.schema["local_index"].dataType).alias("local_index"), "provider_index", F.lit("missing_local").alias("kind")))


def correspondence(alignment_rows: DataFrame) -> DataFrame:
    """Aligned pairs, and what only the provider has."""
    return alignment_rows.where("provider_index is not null").withColumn("provider_only", F.col("local_index").isNull())


def fit(mapped: DataFrame, group: str, program: str) -> DataFrame:
    """Counters of how a programme fits: mapped has one row a local track with choices, exact_title, position, identity_conflict, duration_mismatch, trusted."""
    one = F.col("choices") == 1
    count = lambda c: F.sum(F.when(one & c, 1).otherwise(0)).alias
    return mapped.groupBy(group, program).agg(
        F.sum(F.when(~one, 1).otherwise(0)).alias("unmatched"), count(F.col("identity_conflict"))("identity_conflicts"),
        count(F.col("duration_mismatch") & ~F.col("trusted"))("duration_mismatches"),
        F.countDistinct(F.when(one & F.col("exact_title") & F.col("position"), F.col("place"))).alias("exact_positions"),
        count(~F.col("exact_title") & F.col("position"))("tolerant_positions"))


def component_families(pairs: DataFrame, group: str, a: str, b: str, member: str) -> DataFrame:
    """(group, member, representative): each member of the components of compatible pairs within a group whose members are all pairwise compatible. The representative is the smallest member."""
    linked = pairs.select(F.struct(F.col(group).alias("g"), F.least(a, b).alias("m")).alias("a"), F.struct(F.col(group).alias("g"), F.greatest(a, b).alias("m")).alias("b")).where("a <> b").distinct()
    vertices = graph.canonical(linked)
    sizes = vertices.groupBy("canonical").agg(F.count("*").alias("n"))
    found = linked.join(vertices, F.col("a") == F.col("id")).groupBy("canonical").agg(F.count("*").alias("pairs"))
    whole = sizes.join(found, "canonical").where("pairs = n * (n - 1) div 2").select("canonical")
    return vertices.join(whole, "canonical", "left_semi").select(F.col("id.g").alias(group), F.col("id.m").alias(member), F.col("canonical.m").alias("representative"))


def established(programs: DataFrame, subject: str, program: str, identity: str) -> DataFrame:
    """(subject, identity): the one identity that all of a subject's programmes share."""
    total = programs.groupBy(subject).agg(F.countDistinct(program).alias("of"))
    shared = programs.groupBy(subject, identity).agg(F.countDistinct(program).alias("in")).join(total, subject).where("`in` = of")
    return shared.groupBy(subject).agg(F.count("*").alias("n"), F.min(identity).alias(identity)).where("n = 1").drop("n")


def unique_positions(local: DataFrame, provider: DataFrame, group: str) -> DataFrame:
    """Local and provider tracks at positions that are unique on both sides: (group, disc, number, track_id, candidate_id)."""
    one = lambda df, c: df.groupBy(group, "disc", "number").agg(F.count("*").alias("n"), F.min(c).alias(c)).where("n = 1").drop("n")
    return one(local, "track_id").join(one(provider, "candidate_id"), [group, "disc", "number"])


def anchors_needed(title_class: Column, required: Column) -> Column:
    """How many anchored tracks a title class asks for."""
    return F.when(title_class.isin("exact", "typography"), 0).when(title_class == "edition", 3).otherwise(F.greatest(F.lit(3), required - 1))


def winners_only(candidates: DataFrame, group: str) -> DataFrame:
    """Candidates, without complete ones that anchor under half their tracks where a complete one anchors all."""
    won = F.max(F.col("complete") & (F.col("anchors") == F.col("tracks"))).over(Window.partitionBy(group))
    return candidates.withColumn("__won", won).where(~(F.col("__won") & F.col("complete") & (F.col("anchors") * 2 < F.col("tracks")))).drop("__won")


def certainty(flags: dict[str, Column], default: str) -> Column:
    """The first outcome whose flag holds: precedence is the order of the dictionary."""
    out = F.lit(default)
    for name, flag in reversed(list(flags.items())):
        out = F.when(flag, name).otherwise(out)
    return out
