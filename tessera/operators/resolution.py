"""Which of a page's candidates represents a catalogue entry: elimination in steps, each verdict changing what the others may still claim.

A group is one entry with one page of candidates, as providers list them; nothing here compares candidates of
different groups. All steps are windows and joins by group, so they share one partitioning.

candidates: group, candidate, title_class, artist_accepted, artist_ids (array), year, month, day, kind, title_key, tracks (null: unknown),
required, local_tracks, local_usable, local_year, local_month, local_day, more_pages, edition_pair, type_conflict, unsystematic.
programs: group, candidate, program, complete, strong, anchors, listed, duplicates, matched, usable, over_3s, over_10s and the flags
trusted_conflict, displaced, version_conflict, unanchored.
tracks: group, candidate, program, index, disc, number, track_id (null unless it has exactly one), title_key, artist_ids (all, sorted), lead_ids, credits (how many artists), known_credits, recordings, isrcs, duration_ms, approximate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import released, together

#: So many candidates of a page have their programmes examined.
MOST_EXAMINED = 4
#: The reason that each title class is accepted for.
ACCEPTED = {
    "exact": "accepted_exact_title", "typography": "accepted_normalized_title", "boilerplate": "accepted_artist_boilerplate", "release_type_suffix": "accepted_release_type_suffix",
    "playable_edition": "accepted_playable_edition", "shared_title_span": "accepted_normalized_title",
}
_KEY = ["group", "candidate"]
_DATES = [f"{side}{part}" for side in ("", "local_") for part in ("year", "month", "day")]


def _listed(flags: dict[str, Column], evidence: dict[str, Column] | None = None) -> Column:
    """All reasons whose flags hold, in the dictionary's order, with their evidence if any is given."""
    item = lambda name: F.struct(F.lit(name).alias("reason"), evidence[name].cast("string").alias("evidence")) if evidence else F.lit(name)
    return F.array_compact(F.array(*(F.when(F.coalesce(flag, F.lit(False)), item(name)) for name, flag in flags.items())))


def _flags() -> dict[str, Column]:
    c = F.col
    short = (c("tracks") < c("required")) & ~((c("local_tracks") >= 3) & (c("tracks") * 5 >= c("local_tracks") * 4))
    return {
        "artist_mismatch": ~c("artist_accepted"), "album_title_mismatch": c("title_class") == "conflict", "album_version_mismatch": c("title_class") == "version_conflict",
        "release_type_mismatch": (c("title_class") == "type_conflict") | c("type_conflict"), "track_count_mismatch": short,
    }


def candidate_reasons(candidates: DataFrame) -> DataFrame:
    """(group, candidate, reasons): every reason against a candidate before its programmes are read, in a fixed order, each with the values that it comes from."""
    c = lambda *names: F.concat_ws("|", *(F.coalesce(F.col(n).cast("string"), F.lit("?")) for n in names))
    evidence = {
        "artist_mismatch": F.array_join(F.col("artist_ids").cast("array<string>"), ","), "album_title_mismatch": c("title_class"), "album_version_mismatch": c("title_class"),
        "release_type_mismatch": c("title_class", "kind"), "track_count_mismatch": c("tracks", "required", "local_tracks"),
    }
    return candidates.select(*_KEY, _listed(_flags(), evidence).alias("reasons"))


def date_agreement(year: Column, month: Column, day: Column, other_year: Column, other_month: Column, other_day: Column) -> Column:
    """0 if years differ or are unknown, else 1, with months 2, with days 3; months and days that differ give 0."""
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    depth = F.when(~both(month, other_month), 1).when(~both(day, other_day), 2).otherwise(3)
    return F.when(~F.coalesce(year == other_year, F.lit(False)) | differs(month, other_month) | (both(month, other_month) & differs(day, other_day)), 0).otherwise(depth)


def related_programs(candidates: DataFrame, programs: DataFrame, tracks: DataFrame) -> DataFrame:
    """(group, a, b, same, comparable, equivalent) for a < b of a group, if any holds.

    Only candidates with one complete programme are compared. Their whole track lists make an order-aware signature, a sum of
    hashes by place, that needs no list gathered; only lists with one signature and length meet, and then track by track.
    same: one identity a track, positions, titles and credits are all equal. comparable: at least three tracks, lengths within 3 s, a
    shared leading artist, no recording that differs. equivalent: dates, kinds, credits and titles agree and the programmes are
    the same, or with equal dates have distinct titles and positions, equal known credits, exact lengths within 0.1 s and no
    conflicting recordings.
    """
    one = programs.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("complete").alias("whole"), F.min("program").alias("program")).where("n = 1 AND whole").select(*_KEY, "program")
    lists = tracks.join(one, [*_KEY, "program"])
    own = Window.partitionBy("group", "candidate")
    in_order = own.orderBy("index", "disc", "number", "title_key")
    lists = lists.withColumn("place", F.row_number().over(in_order))
    mark = lambda *seed: F.sum(F.xxhash64(*seed, "place", "disc", "number", "title_key").cast("decimal(20,0)"))
    # Distinct values as ranks in the candidate's own order, nulls first and not counted: no rows are dealt again for them.
    position = F.when(F.col("disc").isNotNull() & F.col("number").isNotNull(), F.struct("disc", "number"))
    ranked = lists.withColumns({"position": position, "title_rank": F.dense_rank().over(own.orderBy("title_key"))}).withColumn("position_rank", F.dense_rank().over(own.orderBy("position")))
    distinct = lambda rank, value: (F.max(rank) - F.max(F.col(value).isNull().cast("int"))).cast("long")
    signed = ranked.groupBy(*_KEY, "program").agg(
        F.count("*").alias("size"), mark().alias("sign"), mark(F.lit("second")).alias("sign_2"), distinct("title_rank", "title_key").alias("titles"), distinct("position_rank", "position").alias("places"),
        F.min(F.coalesce(F.col("number") > 0, F.lit(False))).alias("placed"), F.min(F.col("track_id").isNotNull()).alias("identified"), F.min(F.col("known_credits") & (F.col("credits") > 0)).alias("credited"), F.min(F.col("title_key") != "").alias("titled"),
        F.min(~F.col("approximate") & F.coalesce(F.col("duration_ms") > 0, F.lit(False))).alias("timed"))
    block = ["group", "size", "sign", "sign_2"]
    met = F.count("*").over(Window.partitionBy(*block))
    signed = released(signed.withColumn("met", met).where("met > 1").drop("met")).repartition("group")  # only these meet another
    lists = tracks.join(signed.select(*block, "candidate", "program"), [*_KEY, "program"]).withColumn("place", F.row_number().over(in_order))
    sides = [lists.select(*block, F.col("candidate").alias(p), "place", *(F.col(c).alias(f"{p}_{c}") for c in ("disc", "number", "title_key", "track_id", "artist_ids", "lead_ids", "recordings", "isrcs", "duration_ms"))) for p in ("a", "b")]
    pairs = sides[0].join(sides[1], [*block, "place"]).where("a < b")
    a, b = (lambda c, p=p: F.col(f"{p}_{c}") for p in "ab")
    equal = lambda c: a(c).eqNullSafe(b(c))
    gap = F.abs(a("duration_ms") - b("duration_ms"))
    some = lambda c: (F.size(a(c)) > 0) & (F.size(b(c)) > 0)
    listed = equal("disc") & equal("number") & equal("title_key")
    many = some("recordings") & (F.size(F.array_union(a("recordings"), b("recordings"))) > 1)
    clash = (some("recordings") & ((F.size(F.array_except(a("recordings"), b("recordings"))) > 0) | (F.size(F.array_except(b("recordings"), a("recordings"))) > 0))) | (some("isrcs") & ~F.arrays_overlap(a("isrcs"), b("isrcs")))
    met = pairs.groupBy("group", "a", "b", "size").agg(
        F.min(listed & (F.coalesce(a("track_id") == b("track_id"), F.lit(False))) & equal("artist_ids")).alias("same"),
        F.min(listed & F.coalesce(gap <= 3000, F.lit(True)) & F.coalesce(F.arrays_overlap(a("lead_ids"), b("lead_ids")), F.lit(False)) & ~many).alias("comparable"),
        F.min(listed & F.coalesce(gap <= 100, F.lit(False)) & equal("artist_ids") & ~clash).alias("supported"))
    head = lambda p: candidates.select("group", F.col("candidate").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("year", "month", "day", "kind", "artist_ids", "title_key"))).join(signed.select("group", F.col("candidate").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("titles", "places", "placed", "identified", "credited", "titled", "timed"))), ["group", p])
    rows = met.join(head("a"), ["group", "a"]).join(head("b"), ["group", "b"])
    both = lambda c: a(c) & b(c)
    same = F.col("same") & both("placed") & both("identified")
    strict = F.col("supported") & (F.col("size") >= 3) & both("placed") & both("identified") & both("credited") & both("titled") & both("timed") & (a("titles") == F.col("size")) & (a("places") == F.col("size"))
    dated = equal("year") & (a("month").isNull() | b("month").isNull() | equal("month"))
    alike = dated & equal("kind") & (F.array_sort(a("artist_ids")) == F.array_sort(b("artist_ids"))) & equal("title_key")
    full_date = a("year").isNotNull() & equal("year") & equal("month") & equal("day")
    out = rows.select("group", "a", "b", same.alias("same"), (F.col("comparable") & (F.col("size") >= 3)).alias("comparable"), (alike & (same | (full_date & strict))).alias("equivalent"))
    return out.where("same OR comparable OR equivalent")


def _program_verdicts(programs: DataFrame) -> DataFrame:
    """Per candidate what its programmes, in order, say against it, and what all or any of them have."""
    c = F.col
    reason = (
        F.when(~c("complete"), "incomplete_program").when(c("trusted_conflict"), "trusted_identity_conflict").when((c("listed") < c("required")) & ~c("strong"), "track_count_mismatch")
        .when((c("duplicates") > 0) | c("displaced"), "position_mismatch").when(c("version_conflict"), "album_version_mismatch").when(c("unanchored"), "insufficient_program_anchors"))
    thin = (c("matched") < 3) | (c("matched") * 5 < c("local_tracks") * 4)
    winning = c("complete") & c("strong") & (c("anchors") >= 3) & (c("anchors") == c("local_tracks"))
    said = F.transform(F.array_sort(F.collect_list(F.when(reason.isNotNull(), F.struct("program", reason.alias("r"))))), lambda x: x["r"])  # a candidate's own few programmes
    return programs.groupBy(*_KEY).agg(
        said.alias("against"), F.min("anchors").alias("least_anchors"), F.max("anchors").alias("most_anchors"), F.max("over_3s").alias("over_3s"), F.max("over_10s").alias("over_10s"), F.max(thin).alias("thin"), F.min(winning).alias("winning"),
        F.min(c("complete") & (c("anchors") * 2 < c("local_tracks")) & c("usable")).alias("foreign"))


def resolve(candidates: DataFrame, programs: DataFrame, tracks: DataFrame) -> DataFrame:
    """(group, candidate, title_class, decision, reasons, equivalent_to, outcome, outcome_reason): every candidate with the verdict on it and its group's.

    Steps: reasons against each; a candidate that only its credit order speaks against is freed by an equivalent accepted one; the
    only compatible edition stands in where nothing else is left; programmes are examined (of four candidates at most, as the
    rule is); a fully matching programme rejects foreign ones; single credits beat the same programme with more credits; of
    comparable programmes those with fewer credits stay; equivalent ones collapse; dates decide between what remains. A page
    with more to come vetoes all but a fully matching programme. Verdicts that several later steps read are written once, with what
    these steps need, and dealt by group once for all of a step's windows and joins; so is the result, which is computed at once.
    """
    with together(candidates.sparkSession):
        return _resolved(candidates, programs, tracks)


def _resolved(candidates: DataFrame, programs: DataFrame, tracks: DataFrame) -> DataFrame:
    c, no = F.col, F.lit(False)
    group = Window.partitionBy("group")
    count = lambda flag: F.sum(F.coalesce(flag, no).cast("int")).over(group)
    candidates = candidates.withColumns({"artist_ids": F.array_sort("artist_ids"), "agreement": date_agreement(*(c(d) for d in _DATES))})
    pairs = released(related_programs(*(x.repartition("group") for x in (candidates, programs, tracks))))
    both_ways = pairs.select("group", c("a").alias("candidate"), c("b").alias("other"), "same", "comparable", "equivalent").unionByName(pairs.select("group", c("b").alias("candidate"), c("a").alias("other"), "same", "comparable", "equivalent")).repartition("group")
    rows = candidates.drop(*_DATES).repartition("group").withColumn("reasons", _listed(_flags())).drop("kind", "title_key", "tracks", "type_conflict")

    # Credit order alone: the first accepted candidate with the same credits must be equivalent.
    free = rows.where(c("artist_accepted") & (F.size("reasons") == 0)).groupBy("group", "artist_ids").agg(F.min("candidate").alias("other"))
    alike = both_ways.where("equivalent").select(*_KEY, "other", F.lit(True).alias("freed"))
    rows = rows.join(free, ["group", "artist_ids"], "left").join(alike, [*_KEY, "other"], "left").withColumn("page", F.count("*").over(group))
    freed = F.coalesce("freed", no) & ~c("more_pages") & (c("page") <= MOST_EXAMINED) & (c("reasons") == F.array(F.lit("artist_mismatch")))
    rows = rows.withColumn("freed", freed).withColumns({"artist_accepted": c("artist_accepted") | c("freed"), "reasons": F.when(c("freed"), F.array().cast("array<string>")).otherwise(c("reasons"))})
    rows = rows.withColumn("decision", F.when(F.size("reasons") > 0, "rejected").otherwise("withheld")).drop("other", "page")

    # The only compatible edition.
    titles_only = F.forall("reasons", lambda r: r.isin("album_version_mismatch", "album_title_mismatch"))
    edition = ~c("more_pages") & (count(F.size("reasons") == 0) == 0) & c("artist_accepted") & (F.size("reasons") > 0) & titles_only & c("edition_pair")
    rows = rows.withColumn("edition", (c("local_tracks") > 0) & edition).withColumn("edition", c("edition") & (count(c("edition")) == 1))
    rows = rows.withColumns({"title_class": F.when(c("edition"), "playable_edition").otherwise(c("title_class")), "reasons": F.when(c("edition"), F.array().cast("array<string>")).otherwise(c("reasons")), "decision": F.when(c("edition"), "withheld").otherwise(c("decision"))})
    rows = rows.withColumn("viable", F.size("reasons") == 0)
    stopped = F.when(c("local_tracks") == 0, "insufficient_program_anchors").when((count(c("viable")) > MOST_EXAMINED) & ~c("more_pages"), "candidate_limit").when(
        c("more_pages") & ((count(c("viable")) > MOST_EXAMINED) | (count(c("viable") & (c("title_class") != "playable_edition")) == 0)), "incomplete_candidate_page")
    rows = rows.withColumn("stopped", stopped)

    # Programmes.
    facts = _program_verdicts(programs.repartition("group").join(candidates.select(*_KEY, "required", "local_tracks").repartition("group"), _KEY))
    rows = rows.join(facts, _KEY, "left").withColumn("seen", c("viable") & c("stopped").isNull())
    needed = F.when(c("title_class").isin("exact", "typography"), 0).when(c("title_class") == "playable_edition", 3).otherwise(F.greatest(F.lit(3), c("required") - 1))
    compatible = c("against").isNotNull() & (F.size("against") == 0)
    against = F.when(F.size(F.coalesce("against", F.array().cast("array<string>"))) > 0, c("against")).otherwise(F.array(F.lit("incomplete_program")))
    unsure = F.forall(against, lambda r: r.isin("incomplete_program", "insufficient_program_anchors"))
    slow = ((c("title_class") == "minor_typo") & c("over_3s")) | ((c("title_class") == "playable_edition") & c("over_10s"))
    only = lambda r: F.struct(F.array(F.lit(r)).alias("reasons"), F.lit("rejected").alias("decision"), no.alias("examined"))
    verdict = (
        F.when((c("title_class") == "boilerplate") & c("unsystematic"), only("album_version_mismatch"))
        .when((c("title_class") == "playable_edition") & F.coalesce("thin", no), F.struct(F.array(F.lit("insufficient_program_anchors")).alias("reasons"), F.lit("withheld").alias("decision"), no.alias("examined")))
        .when(~compatible, F.struct(against.alias("reasons"), F.when(unsure, "withheld").otherwise("rejected").alias("decision"), unsure.alias("examined")))
        .when((needed != 0) & (c("least_anchors") < needed), only("insufficient_program_anchors")).when(slow, only("duration_conflict"))
        .otherwise(F.struct(c("reasons"), c("decision"), F.lit(True).alias("examined"))))
    rows = rows.withColumn("v", F.when(c("seen"), verdict).otherwise(F.struct("reasons", "decision", no.alias("examined")))).withColumns({"reasons": c("v.reasons"), "decision": c("v.decision"), "examined": c("v.examined")}).drop("v")

    # A fully matching programme rejects foreign ones.
    won = (count(c("examined") & (F.size("reasons") == 0) & F.coalesce("winning", no)) > 0) & c("local_usable")
    rows = rows.withColumn("foreign", won & c("examined") & (F.size("reasons") > 0) & F.coalesce("foreign", no))
    rows = rows.withColumns({"reasons": F.when(c("foreign"), F.array(F.lit("track_title_mismatch"))).otherwise(c("reasons")), "decision": F.when(c("foreign"), "rejected").otherwise(c("decision")), "examined": c("examined") & ~c("foreign")})

    rows = released(rows.select(*_KEY, "title_class", "artist_accepted", "artist_ids", "more_pages", "local_tracks", "agreement", "reasons", "decision", "examined", "stopped", "winning", "least_anchors", "most_anchors")).repartition("group")

    # Single credits beat the same programme with more; then fewer credits beat comparable programmes.
    single = rows.where(c("examined") & (F.size("reasons") == 0) & (F.size("artist_ids") == 1)).select("group", c("candidate").alias("other"))
    beaten = both_ways.where("same").join(single, ["group", "other"]).select(*_KEY).distinct().withColumn("beaten", F.lit(True))
    rows = rows.join(beaten, _KEY, "left").withColumn("examined", c("examined") & ((F.size("artist_ids") == 1) | F.coalesce(~c("beaten"), F.lit(True))))
    extra = tracks.groupBy(*_KEY).agg(F.sum(F.greatest(c("credits") - 1, F.lit(0))).alias("extra"))
    rows = rows.join(extra.repartition("group"), _KEY, "left").na.fill({"extra": 0}).drop("beaten")
    rows = released(rows).repartition("group")
    live = rows.where(c("examined") & (F.size("reasons") == 0)).select("group", c("candidate").alias("other"), c("artist_ids").alias("o_ids"), c("extra").alias("o_extra"), c("most_anchors").alias("o_anchors"))
    weaker = rows.where(c("examined") & (F.size("reasons") == 0)).join(both_ways.where("comparable"), _KEY).join(live, ["group", "other"])
    weaker = weaker.where((c("o_ids") == c("artist_ids")) & (c("o_extra") < c("extra")) & (c("o_anchors") >= c("most_anchors"))).select(*_KEY).distinct().withColumn("weaker", F.lit(True))
    rows = rows.join(weaker, _KEY, "left").na.fill({"weaker": False})
    rows = rows.withColumns({"reasons": F.when(c("weaker"), F.array(F.lit("weaker_artist_credit"))).otherwise(c("reasons")), "decision": F.when(c("weaker"), "rejected").otherwise(c("decision")), "examined": c("examined") & ~c("weaker")})

    rows = released(rows.drop("extra", "most_anchors", "weaker")).repartition("group")

    # Equivalent ones collapse: each joins the first class all of whose members it is equivalent to. At most four a group are left.
    links = both_ways.where("equivalent").groupBy(*_KEY).agg(F.collect_set("other").alias("alike"))
    left = rows.where("examined").join(links, _KEY, "left").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("candidate", F.coalesce("alike", F.array().cast("array<bigint>")).alias("alike")))).alias("all"))
    kind = "array<struct<candidate:bigint,class:bigint>>"

    def place(done: Column, x: Column) -> Column:
        heads = F.array_sort(F.array_distinct(F.transform(done, lambda d: d["class"])))
        fits = F.filter(heads, lambda h: F.forall(F.filter(done, lambda d: d["class"] == h), lambda d: F.array_contains(x["alike"], d["candidate"])))
        return F.concat(done, F.array(F.struct(x["candidate"].alias("candidate"), F.coalesce(F.get(fits, F.lit(0)), x["candidate"]).alias("class"))))

    classes = left.select("group", F.explode(F.aggregate("all", F.array().cast(kind), place)).alias("x")).select("group", "x.candidate", "x.class")
    rows = rows.join(classes, _KEY, "left")
    mine = Window.partitionBy("group", "class")
    first = F.row_number().over(mine.orderBy(c("agreement").desc(), "candidate")) == 1
    rows = rows.withColumns({"leads": c("examined") & first, "members": F.count("*").over(mine), "class_agreement": F.max("agreement").over(mine)})
    supported = count(c("examined") & (F.size("reasons") > 0)) == 0
    best = F.max(F.when(c("examined"), c("class_agreement"))).over(group)
    rows = rows.withColumns({"supported": supported, "classes": count(c("leads")), "best": best, "kept": count(c("examined"))})
    rows = rows.withColumns({"at_best": count(c("leads") & (c("class_agreement") == c("best"))), "typos": count(c("examined") & (c("title_class") == "minor_typo")), "weak": count(c("examined") & (c("least_anchors") < 3))})
    by_date = (c("typos") == 0) & (c("best") > 0) & (c("at_best") == 1) & (c("weak") == 0) & (c("class_agreement") == c("best"))
    rows = rows.withColumn("wins", c("examined") & c("supported") & ((c("classes") == 1) | by_date))
    plain = c("title_class").isin("exact", "typography", "release_type_suffix") & F.coalesce("winning", no)
    rows = rows.withColumn("veto", c("stopped").isNull() & c("more_pages") & (count(c("wins") & c("leads") & plain) == 0)).withColumn("wins", c("wins") & ~c("veto"))
    rows = rows.withColumns({
        "won": count(c("wins")) > 0, "chosen": F.max(F.when(c("wins") & c("leads"), c("candidate"))).over(group), "by": F.max(F.when(c("wins") & c("leads"), c("title_class"))).over(group), "with": F.max(F.when(c("wins"), c("members"))).over(group),
    })
    accepted = F.when(c("with") > 1, "equivalent_candidates_collapsed")
    for title_class, reason in ACCEPTED.items():
        accepted = accepted.when(c("by") == title_class, reason)
    accepted = accepted.otherwise("accepted_minor_typo")
    leading = F.min_by(F.get("reasons", F.lit(0)), F.struct(~c("artist_accepted"), c("candidate"))).over(group)
    sole = F.max(F.when(c("examined"), F.get("reasons", F.lit(0)))).over(group)
    open_reason = F.when((c("kept") == 1) & ~c("supported"), sole).when(c("kept") == 0, F.coalesce(leading, F.lit("no_candidates"))).otherwise("competing_candidates")
    outcome_reason = F.coalesce(c("stopped"), F.when(c("veto"), "incomplete_candidate_page").when(c("won"), accepted).otherwise(open_reason))
    outcome = (
        F.when(c("local_tracks") == 0, "no_confident_match").when(c("stopped").isNotNull() | c("veto"), "ambiguous").when(c("won") & (c("by") == "exact"), "matched").when(c("won"), "matched_close")
        .when((c("kept") == 0) | ((c("kept") == 1) & ~c("supported")), "no_confident_match").otherwise("ambiguous"))
    settled = c("examined") & ~c("veto")
    reasons = F.when(c("wins"), F.array(accepted)).when(settled & (c("won") | (F.size("reasons") == 0)), F.array(F.lit("competing_candidates"))).otherwise(c("reasons"))
    return released(rows.select(
        *_KEY, "title_class", F.when(c("wins"), "accepted").when(c("won") & c("examined"), "withheld").otherwise(c("decision")).alias("decision"), reasons.alias("reasons"),
        F.when(c("wins") & (c("candidate") != c("chosen")), c("chosen")).alias("equivalent_to"), outcome.alias("outcome"), outcome_reason.alias("outcome_reason")))
