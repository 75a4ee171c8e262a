"""Album programmes: how a set of local tracks fits the track lists of a provider, and what that decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import linkage
from tessera.operators.linkage import MATCH_MS

MISSING, BY_TITLE, TOLERANT, BY_POSITION, TRUSTED = range(5)


def inspected(pairs: DataFrame) -> DataFrame:
    """Pairs (group, program, track, p_index, exact_title, near_title, disc, number, p_disc, p_number, trusted, identity_conflict, credit, duration_ms, p_duration_ms) with position, duration_mismatch, occurrence_supported and considered."""
    disc = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1))
    position = F.coalesce(((F.col("number") == F.col("p_number")) & (disc("disc") == disc("p_disc"))) | ((disc("disc") == 1) & (F.col("number") == F.col("p_index") + 1)), F.lit(False))
    out = pairs.withColumn("position", position).withColumn("duration_mismatch", F.coalesce(F.abs(F.col("duration_ms") - F.col("p_duration_ms")) > MATCH_MS, F.lit(False)))
    additional = F.col("credit") == "different_additional"
    out = out.withColumn("occurrence_supported", F.col("trusted") | ~additional)
    exact, at, trusted = F.col("exact_title"), F.col("position"), F.col("trusted")
    title = trusted | exact | (at & F.col("near_title"))
    credit = trusted | ((F.col("credit") != "contradictory") & (~additional | (exact & at)))
    length = trusted | ~F.col("duration_mismatch") | F.col("identity_conflict") | exact
    return out.withColumn("considered", title & credit & length)


def mapped(checks: DataFrame) -> DataFrame:
    """What is left of the considered pairs: trusted ones where there are any, else exact titles, then those in position."""
    by_track = Window.partitionBy("group", "program", "track")
    rows = checks.where("considered").withColumn("t", F.max("trusted").over(by_track)).withColumn("e", F.max("exact_title").over(by_track))
    rows = rows.where(F.when(F.col("t"), F.col("trusted")).when(F.col("e"), F.col("exact_title")).otherwise(True))
    return rows.withColumn("p", F.max("position").over(by_track)).where(F.col("position") | ~F.col("p")).drop("t", "e", "p")


def agreements(checks: DataFrame, tracks: DataFrame) -> DataFrame:
    """(group, program, track, agreement, conflict, mismatch, exact_place): one row for each of tracks (group, program, track)."""
    one = mapped(checks).groupBy("group", "program", "track").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("trusted", "exact_title", "position", "identity_conflict", "duration_mismatch")]).where("n = 1")
    rows = tracks.join(one, ["group", "program", "track"], "left")
    level = F.when(F.col("n").isNull() | F.col("identity_conflict"), MISSING).when(F.col("trusted"), TRUSTED).when(F.col("exact_title") & F.col("position"), BY_POSITION).when(F.col("position"), TOLERANT).otherwise(BY_TITLE)
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("group", "program", "track", level.alias("agreement"), no(F.col("identity_conflict")).alias("conflict"), no(F.col("duration_mismatch") & ~F.col("trusted")).alias("mismatch"), no(F.col("exact_title") & F.col("position")).alias("exact_place"))


def selected(rows: DataFrame, programs: DataFrame) -> DataFrame:
    """(group, program) of complete programmes that no better one displaces. A better one has three exact positions at least and more than the other, no more mismatches, and no track that agrees less; programmes with conflicts go if one without them agrees anywhere. programs has group, program, complete."""
    fit = rows.groupBy("group", "program").agg(F.sum(F.col("conflict").cast("int")).alias("conflicts"), F.sum(F.col("mismatch").cast("int")).alias("mismatches"), F.sum(F.col("exact_place").cast("int")).alias("exact"), F.max("agreement").alias("top"))
    fit = fit.join(programs, ["group", "program"])
    clean = F.max(F.col("complete") & (F.col("conflicts") == 0) & (F.col("top") > MISSING)).over(Window.partitionBy("group"))
    viable = fit.withColumn("clean", clean).where(F.col("complete") & (~F.col("clean") | (F.col("conflicts") == 0)))
    left, right = viable.select("group", "program", "exact", "mismatches"), viable.select("group", F.col("program").alias("rival"), F.col("exact").alias("r_exact"), F.col("mismatches").alias("r_mismatches"))
    pairs = left.join(right, "group").where((F.col("rival") != F.col("program")) & (F.col("r_exact") >= 3) & (F.col("r_exact") > F.col("exact")) & (F.col("r_mismatches") <= F.col("mismatches")))
    worse = pairs.select("group", "program", "rival").join(rows.select("group", "program", "track", "agreement"), ["group", "program"]).join(rows.select("group", F.col("program").alias("rival"), "track", F.col("agreement").alias("r_agreement")), ["group", "rival", "track"])
    displaced = worse.groupBy("group", "program", "rival").agg(F.min(F.col("r_agreement") >= F.col("agreement")).alias("all")).where("all").select("group", "program").distinct()
    return left.join(displaced, ["group", "program"], "left_anti").select("group", "program")


def album_outcomes(checks: DataFrame, tracks: DataFrame, programs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(group, track, withheld, outcome, recording_status, recording) for each of tracks (group, track), decided for an album's tracks together.

    checks are inspected() pairs with recording, occurrence (ids, null: none given) and p_key (the provider's title as a key); programs has group,
    program, complete; chosen, the programmes of selected(), group and program. One incomplete programme withholds every track of its album: it could
    hold a second mapping of any. Of the others, a track that one chosen programme maps twice is ambiguous, one that none maps has no confident match, one
    with a contradicting identity is conflicting. Titles that differ with no exact one and no id that all mappings share are ambiguous too. A recording
    is named only if all mappings give it, all occurrences are supported and no length speaks against it; a length doesn't where the title is exact and the
    only such one, or the identity is trusted. Null flags count as false. Outcome and status names are fixed.
    """
    partial = programs.groupBy("group").agg(F.max(~F.coalesce("complete", F.lit(False))).alias("withheld"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    key = ["group", "program", "track"]
    exact = checks.groupBy(*key).agg(F.sum(no("exact_title").cast("int")).alias("exacts"))
    rows = mapped(checks.join(chosen.select("group", "program").distinct(), ["group", "program"], "left_semi")).join(exact, key)
    blocked = no("duration_mismatch") & ~no("trusted") & ~((F.col("exacts") == 1) & no("exact_title"))
    known = lambda c: [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count(c).alias(f"{c}_n")]
    per = rows.groupBy(*key).agg(F.count("*").alias("n"), F.max(no("identity_conflict")).alias("conflict"), F.max(blocked).alias("blocked"), F.min(no("occurrence_supported")).alias("supported"), F.max(no("exact_title")).alias("exact"), *known("recording"), *known("occurrence"), *known("p_key"))
    joined = lambda c: [F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"), F.sum(f"{c}_n").alias(f"{c}_n")]
    one = per.groupBy("group", "track").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.max("conflict").alias("conflict"), F.max("blocked").alias("blocked"), F.min("supported").alias("supported"), F.max("exact").alias("exact"), *joined("recording"), *joined("occurrence"), *joined("p_key"))
    same = lambda c: F.coalesce((F.col(f"{c}_n") == F.col("n")) & (F.col(f"{c}_min") == F.col(f"{c}_max")), F.lit(False))
    out = tracks.select("group", "track").distinct().join(one, ["group", "track"], "left").join(partial, "group", "left").withColumn("withheld", no("withheld"))
    unclear = ~same("recording") & ~(same("occurrence") & F.col("supported")) & ~F.col("exact") & ~same("p_key")
    outcome = F.when(F.col("withheld") | F.col("n").isNull(), "no_confident_match").when(F.col("most") > 1, "ambiguous").when(F.col("conflict"), "conflicting_identity").when(unclear, "ambiguous").otherwise("matched")
    apart = F.coalesce(F.col("recording_min") != F.col("recording_max"), F.lit(False))
    status = F.when(F.col("recording_n") == 0, "not_provided").when(apart | ~F.col("supported"), "ambiguous").when(F.col("blocked"), "duration_mismatch").when(same("recording"), "identified").otherwise("ambiguous")
    out = out.withColumn("outcome", outcome).withColumn("recording_status", F.when(F.col("outcome") == "matched", status))
    return out.select("group", "track", "withheld", "outcome", "recording_status", F.when(F.col("recording_status") == "identified", F.col("recording_min")).alias("recording"))


def recording_certainty(rows: DataFrame) -> DataFrame:
    """(track, certainty, recording): rows are corresponding programme rows of a track: recording (null: none given), complete, context, artist_trusted, version, duration, conflict, known (array of the track's own). Observations of incomplete programmes count against, never for."""
    full = F.col("complete")
    g = rows.groupBy("track").agg(
        F.array_sort(F.collect_set("recording")).alias("ids"), F.max("conflict").alias("conflict"), F.max(full & F.col("recording").isNull()).alias("lacks"), F.sum(full.cast("int")).alias("support"), F.max(~full).alias("sampled"),
        F.min(~full | F.col("context")).alias("context"), F.min(~full | F.col("artist_trusted")).alias("artist"), F.max(full & F.col("version")).alias("version"), F.max(full & F.col("duration")).alias("duration"), F.first("known").alias("known"))
    clash = F.exists("ids", lambda i: F.exists("known", lambda k: k != i))
    some = F.size("ids")
    certainty = (
        F.when(F.col("conflict") | clash, "conflicting_identity").when((some > 1) | F.col("lacks"), "recording_ambiguous").when(F.col("support") == 0, F.when(F.col("sampled"), "incomplete_evidence").otherwise("no_correspondence"))
        .when(~F.col("context"), "insufficient_context").when(~F.col("artist"), "artist_untrusted").when(F.col("version"), "version_uncertain").when(F.col("duration"), "duration_conflict")
        .when(some != 1, "recording_ambiguous").when(F.array_contains("known", F.get("ids", F.lit(0))), "already_known").otherwise("supported"))
    return g.select("track", certainty.alias("certainty"), F.when(certainty.isin("supported", "already_known"), F.get("ids", F.lit(0))).alias("recording"))


def _aligned(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, local_index, agreed, agreed_clash, elsewhere, m) of local tracks that meet a provider's by title or identity. m is the counterpart by the rule of linkage.alignment, found in the one join that also tells which titles agree; null: none."""
    title = lambda p: F.struct(F.lit(0).alias("kind"), F.col(f"{p}_title").cast("string").alias("a"), F.col(f"{p}_version").cast("string").alias("b"))
    identity = lambda p: F.struct(F.lit(1).alias("kind"), F.col(f"{p}_id").cast("string").alias("a"), F.lit("").alias("b"))
    keyed = lambda df, p: df.withColumn("k", F.explode(F.filter(F.array(title(p), identity(p)), lambda k: k["a"].isNotNull() & k["b"].isNotNull()))).select("*", "k.*").drop("k")
    met = keyed(left, "l").join(keyed(right.drop("complete"), "r"), [group, "kind", "a", "b"])
    agreed, same = F.col("kind") == 0, F.coalesce(F.col("l_id") == F.col("r_id"), F.lit(False))
    agrees = F.coalesce((F.col("l_title") == F.col("r_title")) & (F.col("l_version") == F.col("r_version")), F.lit(False))
    met = met.where(agreed | ~agrees)  # a pair that both keys bring counts once
    met = met.withColumn("pair", same | (linkage.within(F.col("l_ms"), F.col("r_ms"), linkage.PROVIDER_MS) & (F.col("l_id").isNull() | F.col("r_id").isNull())))
    n = lambda index: F.count(F.when(F.col("pair"), 1)).over(Window.partitionBy(group, index))
    met = met.withColumn("of_r", n("provider_index")).withColumn("of_l", n("local_index"))
    to = F.struct(F.col("provider_index").alias("mapped"), *[F.col(f"r_{c}").alias(f"m_{c}") for c in ("title", "version", "id", "place")])
    of = lambda c: F.max(F.when(agreed, c))
    return met.groupBy(group, "local_index").agg(
        F.max(agreed).alias("agreed"), of(F.coalesce(F.col("l_id") != F.col("r_id"), F.lit(False))).alias("agreed_clash"), of(F.col("r_place").isNull() | (F.col("r_place") != F.col("l_place"))).alias("elsewhere"),
        F.first(F.when(F.col("pair") & (F.col("of_l") == 1) & (F.col("of_r") == 1), to), True).alias("m"))


def positioned_program(local: DataFrame, program: DataFrame, group: str = "group_id", fragments: bool = False) -> DataFrame:
    """(group, local_index, provider_index, decision, anchors, duplicates, strong): a decision for each local track about its place in a provider's programme.

    Both sides have group, an index, title_key, version, duration_ms, disc, number, identity (one, or
    null); program has complete. Titles agree if key and version are equal and contradict each other if
    versions differ. In a strong alignment, or one whose pairs lie at other positions, a track's
    counterpart is the aligned one, else the one at its position. Anchors are agreeing titles in
    position, or aligned pairs if the alignment is strong; three of them corroborate a position, unless
    fragments is set and one title is a part of the other. Identities that differ are conflicts.
    """
    disc = F.coalesce(F.nullif(F.col("disc"), F.lit(0)), F.lit(1)).cast("long")
    place = F.when(F.col("number").isNotNull(), disc * (1 << 31) + F.col("number"))
    side = lambda df, index, p, *more: df.where(F.col(group).isNotNull()).select(group, F.col("index").alias(index), F.col("title_key").alias(f"{p}_title"), F.col("version").alias(f"{p}_version"), F.col("identity").alias(f"{p}_id"), place.alias(f"{p}_place"), F.col("duration_ms").alias(f"{p}_ms"), *more)
    left, right = side(local, "local_index", "l"), side(program, "provider_index", "r", "complete")
    by_group = Window.partitionBy(group)
    aligned = _aligned(left, right, group)
    aligned = aligned.withColumns({"matched": F.count("m").over(by_group), "falls": F.coalesce(F.col("m.mapped") <= F.last("m", True).over(by_group.orderBy("local_index").rowsBetween(Window.unboundedPreceding, -1))["mapped"], F.lit(False))})
    aligned = aligned.withColumn("fell", F.max("falls").over(by_group)).select(group, "local_index", "agreed", "agreed_clash", "elsewhere", "m.*", "matched", "fell")

    at = F.max_by(F.struct(F.col("provider_index").alias("at"), F.col("r_title").alias("a_title"), F.col("r_version").alias("a_version"), F.col("r_id").alias("a_id"), F.col("r_place").alias("a_place")), "provider_index")
    places = right.where("r_place is not null").groupBy(group, F.col("r_place").alias("l_place")).agg(at.alias("a")).select(group, "l_place", "a.*")
    sizes = right.groupBy(group).agg(F.count("*").alias("n_program"), F.min("complete").alias("complete"), (F.count("r_place") - F.countDistinct("r_place")).alias("duplicates"))
    no = lambda c: F.coalesce(c, F.lit(False))
    at_agrees = no((F.col("l_title") == F.col("a_title")) & (F.col("l_version") == F.col("a_version")))
    at_clash, mapped_clash = (no(F.col("l_id") != F.col(c)) for c in ("a_id", "m_id"))
    rows = left.join(places, [group, "l_place"], "left").withColumn("fits", at_agrees & ~at_clash)
    rows = rows.withColumn("anchor", F.col("fits") & (F.row_number().over(Window.partitionBy(group, "l_place").orderBy(F.desc("fits"))) == 1))
    rows = rows.join(aligned, [group, "local_index"], "left").join(sizes, group, "left").na.fill({"duplicates": 0})
    matched, size = F.max("matched").over(by_group), F.count("*").over(by_group)
    rows = rows.withColumns({
        "in_place": F.count(F.when(F.col("anchor"), 1)).over(by_group), "in_line": F.count(F.when(F.col("mapped").isNotNull() & ~mapped_clash, 1)).over(by_group),
        "shifted": F.max(F.col("at").isNotNull() & ~at_agrees & no(F.col("elsewhere"))).over(by_group), "reordered": F.max(no(F.col("fell")) & F.col("mapped").isNotNull()).over(by_group),
        "differs": F.max(F.col("mapped").isNotNull() & ~F.col("l_place").eqNullSafe(F.col("m_place"))).over(by_group),
        "strong": no(F.col("complete") & (matched >= 3) & (matched * 5 >= size * 4) & (matched * 5 >= F.col("n_program") * 4))})
    anchors = F.when(F.col("strong"), F.col("in_line")).otherwise(F.col("in_place"))
    by_line = F.col("strong") | F.col("differs")
    chosen = {c: F.when(by_line, F.col(f"m_{c}")).otherwise(F.col(f"a_{c}")).alias(f"c_{c}") for c in ("title", "version", "id", "place")}
    rows = rows.select("*", anchors.alias("anchors"), F.when(by_line, F.col("mapped")).otherwise(F.col("at")).alias("provider_index"), *chosen.values())
    strong, other_place = F.col("strong"), ~F.col("l_place").eqNullSafe(F.col("c_place"))
    agree, contradict = (F.col("l_title") == F.col("c_title")) & (F.col("l_version") == F.col("c_version")), F.col("l_version") != F.col("c_version")
    part = (text.exact_alternate_component(F.col("l_title"), F.col("c_title"), False) | text.arbitrary_title_fragment(F.col("l_title"), F.col("c_title"), False)) if fragments else F.lit(False)
    alone = F.when(F.coalesce("agreed_clash", F.lit(False)), "trusted_identity_conflict").when(strong & F.col("agreed").isNotNull(), "ambiguous_correspondence").when(strong, "local_only").otherwise("position_mismatch")
    moved = F.when(F.col("reordered"), "reordered_track").otherwise("aligned_after_insertion")
    decision: Column = (
        F.when(F.col("provider_index").isNull(), alone).when(F.col("duplicates") > 0, "position_mismatch").when(F.coalesce(F.col("l_id") != F.col("c_id"), F.lit(False)), "trusted_identity_conflict")
        .when(~strong & (F.col("l_place").isNull() | F.col("c_place").isNull() | other_place), "position_mismatch").when(F.col("shifted") & ~strong, "shifted_program").when(contradict, "version_conflict")
        .when(agree & strong & other_place, moved).when(agree, "exact_anchor").when((F.col("anchors") >= 3) & ~F.coalesce(part, F.lit(False)), "corroborated_position").otherwise("insufficient_anchors"))
    return rows.select(group, "local_index", "provider_index", decision.alias("decision"), "anchors", "duplicates", "strong")


#: Decisions under which a track doesn't speak against a programme.
FITTING = ["exact_anchor", "corroborated_position", "local_only", "aligned_after_insertion", "reordered_track"]


def compatible_programs(decisions: DataFrame, complete: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, compatible): complete programmes without duplicate positions all of whose decisions fit."""
    g = decisions.groupBy(group).agg((F.min(F.col("decision").isin(FITTING)) & (F.max("duplicates") == 0)).alias("fits"))
    return g.join(complete.groupBy(group).agg(F.min("complete").alias("complete")), group).select(group, (F.col("fits") & F.col("complete")).alias("compatible"))
