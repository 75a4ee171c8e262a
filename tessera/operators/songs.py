"""Song resolution: which provider occurrence, if any, is a given track.

Pairs have subject, candidate_id and, for the track and with c_ for the candidate: title, artists (array of
credits), album, disc, number, duration_ms, date (text), and the forms that prepared() adds to either side
before the join; complete says whether the subject's page held all.
Titles must be in NFC, as lambdas can't hold the conversion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import credits as cr
from tessera.functions import dates, text
from tessera.operators.linkage import PROVIDER_MS, within

PLAYABLE_MS = 100


def _names(artists: Column) -> Column:
    return F.transform(artists, lambda a: a["name"])


def prepared(tracks: DataFrame, prefix: str = "") -> DataFrame:
    """Adds the forms that comparisons use to tracks or candidates (title, artists, album, date, each with the prefix), before they are paired, so that a form is made once a row and not once a pair."""
    c = lambda name: F.col(prefix + name)
    new = lambda **made: {f"{prefix}_{k}": v for k, v in made.items()}
    brackets = lambda x: F.regexp_replace(text.normalize_album_title(x, False), r"\s+(?=[\[\]{}()/])|(?<=[\[\]{}()/])\s+", "")
    df = tracks.withColumns(new(musical=cr.musical_title(c("title"), _names(c("artists")))))
    df = df.withColumns(new(shown=text.presentation_title(c("_musical")), words=F.trim(F.regexp_replace(F.lower(c("_musical")), f"[^{text.ALNUM}]+", " ")), compared=text.comparison_title(c("_musical"), False)))
    return df.withColumns(new(
        brackets=F.when(c("_shown").rlike(r"[\[\]{}]"), brackets(c("_shown"))), bare=brackets(c("_shown")), number=text.numeric_title(c("_compared")), qualifiers=text.track_qualifiers(c("_compared")),
        keyed=cr.keyed(c("artists")), key=text.normalize_album_title(c("title"), False), album_key=text.normalize_album_title(c("album"), False), base=playable_base(c("title")), day=dates.parse_date(c("date"))))


def title_relation(c: str = "c_") -> Column:
    """Of prepared pairs: agrees, contradictory (version words differ) or uncorroborated; featured credits that the artists explain don't count."""
    m, n = F.col("_compared"), F.col(f"{c}_compared")
    bracketed = (F.col("_brackets").isNotNull() | F.col(f"{c}_brackets").isNotNull()) & (F.col("_bare") != F.col(f"{c}_bare"))
    worded = (F.trim("_musical") != "") & (F.col("_words") == F.col(f"{c}_words"))
    agrees = (m != "") & ((m == n) | worded | (F.col("_number") == F.col(f"{c}_number")))
    return F.when(bracketed, "uncorroborated").when(agrees, "agrees").when(F.col("_qualifiers") != F.col(f"{c}_qualifiers"), "contradictory").otherwise("uncorroborated")


def evidence(pairs: DataFrame) -> DataFrame:
    """Adds to prepared pairs: same_title, primary, credit, same_album, position_differs, date_agreement, credits_ok, duration_ok."""
    differs = lambda a, b: F.coalesce((F.col(a) > 0) & (F.col(b) > 0) & (F.col(a) != F.col(b)), F.lit(False))
    a, b = F.col("_keyed"), F.col("c__keyed")
    out = pairs.withColumns({
        "same_title": title_relation() == "agrees",
        "primary": F.coalesce(cr.same_artist(F.get(a, F.lit(0)), F.get(b, F.lit(0))), F.lit(False)), "credit": cr.compare_credits(a, b),
        "same_album": (F.trim("album") != "") & (F.col("_album_key") == F.col("c__album_key")), "position_differs": differs("disc", "c_disc") | differs("number", "c_number"),
        "date_agreement": dates.date_agreement(F.col("_day"), F.col("c__day")), "dated": F.col("_day").isNotNull(),
        "duration_ok": within(F.nullif("duration_ms", F.lit(0)), F.nullif("c_duration_ms", F.lit(0)), PROVIDER_MS),
    })
    return out.withColumn("credits_ok", F.col("primary") & (F.col("credit") == "equivalent"))


def feasible(rows: DataFrame) -> DataFrame:
    """Adds reasons and class: infeasible with any reason, alternate where another candidate's date agrees better or none does, else preferred."""
    far = F.coalesce(F.abs(F.col("duration_ms") - F.col("c_duration_ms")) > 30_000, F.lit(False)) & (F.col("duration_ms") > 0) & (F.col("c_duration_ms") > 0)
    reasons = F.array_compact(F.array(
        F.when(~F.col("primary"), "different primary artist"), F.when(F.col("credit") == "contradictory", "contradictory credits"), F.when(~F.col("same_title"), "different title or version"),
        F.when((F.trim("album") != "") & ~F.col("same_album"), "different album"), F.when(F.col("position_differs"), "different position")))
    out = rows.withColumn("reasons", reasons).withColumn("reasons", F.when((F.size("reasons") > 0) & far, F.array_append("reasons", F.lit("very different length"))).otherwise(F.col("reasons")))
    ok = F.size("reasons") == 0
    best = F.max(F.when(ok, F.col("date_agreement"))).over(Window.partitionBy("subject"))
    kind = F.when(~ok, "infeasible").when((F.col("dated") & (F.col("date_agreement") == 0)) | (F.col("date_agreement") < best), "alternate").otherwise("preferred")
    return out.withColumn("class", kind)


def assessed(pairs: DataFrame) -> DataFrame:
    """(subject, outcome, candidate_id): unique where the page is complete and one candidate with equivalent credits is left that no other dominates; needs_selection where a title and primary artist fit; no_match."""
    rows = feasible(evidence(pairs))
    plausible = rows.where((F.col("class") != "infeasible") & (F.trim("album") != "") & F.col("duration_ok") & (F.col("credit") != "contradictory"))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")
    tests = {"e1": F.col("credits_ok").cast("int"), "e2": (F.trim("title") == F.trim("c_title")).cast("int"), "e3": (F.trim("album") == F.trim("c_album")).cast("int"), "e4": same("disc", "c_disc"), "e5": same("number", "c_number")}
    plausible = plausible.select("subject", "candidate_id", "credit", "credits_ok", "date_agreement", "complete", *[c.cast("int").alias(k) for k, c in tests.items()])
    rivals = plausible.select(F.col("subject").alias("s"), F.col("candidate_id").alias("c"), F.col("date_agreement").alias("d"), *[F.col(k).alias(f"r{k}") for k in tests])
    all_at_least, some_more = F.lit(True), F.lit(False)
    for k in tests:
        all_at_least, some_more = all_at_least & (F.col(f"r{k}") >= F.col(k)), some_more | (F.col(f"r{k}") > F.col(k))
    beaten = (F.col("s") == F.col("subject")) & (F.col("c") != F.col("candidate_id")) & (F.col("credit") != "different_additional") & all_at_least & some_more & (F.col("d") >= F.col("date_agreement"))
    strongest = plausible.join(rivals, beaten, "left_anti").groupBy("subject").agg(F.countDistinct("candidate_id").alias("n"), F.min("candidate_id").alias("winner"), F.min("credits_ok").alias("credits_ok"))
    facts = rows.groupBy("subject").agg(F.min("complete").alias("complete"), F.max(F.col("same_title") & F.col("primary")).alias("some"))
    joined = facts.join(strongest, "subject", "left")
    unique = F.coalesce((F.col("n") == 1) & F.col("credits_ok") & F.col("complete"), F.lit(False))
    return joined.select("subject", F.when(unique, "unique").when(F.col("some"), "needs_selection").otherwise("no_match").alias("outcome"), F.when(unique, F.col("winner")).alias("candidate_id"))


def playable_base(title: Column) -> Column:
    """The normalized title without an annotation of version words and years only."""
    word, version = r"(?:live|acoustic|demo|remaster|remastered|remix|radio|edit|version|[0-9]{4})", r"(?:live|acoustic|demo|remaster|remastered|remix|edit)"
    t = text.normalize(title)
    note = rf"(?:{word} )*{version}(?: {word})*"
    return text.normalize_album_title(F.regexp_replace(F.regexp_replace(t, rf" \({note}\)$", ""), rf" - {note}$", ""), False)


def playable(pairs: DataFrame) -> DataFrame:
    """(subject, outcome, candidate_id): the best playable candidate by exact title and equivalent credits. Equals with a shared recording (column recording) and length within 100 ms count as one; others are left to select."""
    rows = evidence(pairs).where(F.col("primary") & ~F.col("credit").isin("contradictory", "different_additional") & F.col("duration_ok") & (F.col("same_title") | (F.col("_base") == F.col("c__base"))))
    score = F.struct(((F.trim("title") != "") & (F.col("_key") == F.col("c__key"))).alias("t"), F.col("credits_ok").alias("c"))
    top = rows.withColumn("score", score).withColumn("best", F.max("score").over(Window.partitionBy("subject"))).where("score = best")
    merged = top.groupBy("subject", F.coalesce("recording", "candidate_id").alias("r")).agg(F.min("candidate_id").alias("candidate_id"), F.max("c_duration_ms").alias("hi"), F.min("c_duration_ms").alias("lo"), F.count("*").alias("n"))
    one = merged.withColumn("k", F.when(F.col("hi") - F.col("lo") <= PLAYABLE_MS, 1).otherwise(F.col("n")))
    found = one.groupBy("subject").agg(F.sum("k").alias("k"), F.min("candidate_id").alias("winner"))
    facts = pairs.groupBy("subject").agg(F.min("complete").alias("complete")).join(found, "subject", "left")
    outcome = F.when(~F.col("complete"), "needs_selection").when(F.col("k").isNull(), "no_match").when(F.col("k") == 1, "unique").otherwise("needs_selection")
    return facts.select("subject", outcome.alias("outcome"), F.when(outcome == "unique", F.col("winner")).alias("candidate_id"))


def visible(rows: DataFrame) -> DataFrame:
    """Candidates that aren't infeasible, in order of class, title, credits, album, length, position and id."""
    rank = F.when(F.col("class") == "preferred", 0).otherwise(1)
    order = [rank, ~F.col("same_title"), ~F.col("credits_ok"), ~F.col("same_album"), ~F.col("duration_ok"), F.coalesce(F.col("number") != F.col("c_number"), F.lit(True)), F.col("candidate_id")]
    return rows.where("class <> 'infeasible'").withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy(*order)))
