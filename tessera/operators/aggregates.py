"""Grouped answers: credits, coverage, conflicts, completeness, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_text(position: str, text: Column, join: Column | None = None, between: str = " / ") -> Column:
    """Aggregate: texts in order of position, each followed by its join phrase, or `between` where it has none, except the last's."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), text.alias("t"), (join if join is not None else F.lit(None).cast("string")).alias("j"))))
    return F.aggregate(rows, F.struct(F.lit("").alias("t"), F.lit("").alias("j")), lambda a, x: F.struct(F.concat(a["t"], a["j"], x["t"]).alias("t"), F.coalesce(x["j"], F.lit(between)).alias("j")), lambda a: a["t"])


def distinct_text(text: Column, between: str = " · ") -> Column:
    """Aggregate: distinct texts in order."""
    return F.array_join(F.array_sort(F.collect_set(text)), between)


def json_list(value: Column) -> Column:
    """Aggregate: the values, in order, as a JSON array."""
    return F.to_json(F.sort_array(F.collect_list(value)))


def agreed(value: Column) -> Column:
    """Aggregate: the value all have that have one, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def list_details(entries: DataFrame, list_col: str, duration: str, approximate: str) -> DataFrame:
    """Per list: entries, known length, entries of unknown length, of approximate length."""
    known = F.col(duration) >= 0
    return entries.groupBy(list_col).agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.when(known, F.col(duration)).otherwise(0)), F.lit(0)).alias("known_length"),
        (F.count("*") - F.count(F.when(known, 1))).alias("unknown_lengths"),
        F.count(F.when(known & F.col(approximate), 1)).alias("approximate_lengths"),
    )


def coverage(members: DataFrame, group: str, connected: str, marked: str) -> DataFrame:
    """One row: members, connected, missing, marked, groups with something missing."""
    return members.agg(
        F.count("*").alias("saved"), F.coalesce(F.sum(F.col(connected).cast("long")), F.lit(0)).alias("connected"),
        (F.count("*") - F.coalesce(F.sum(F.col(connected).cast("long")), F.lit(0))).alias("missing"),
        F.coalesce(F.sum(F.col(marked).cast("long")), F.lit(0)).alias("marked"),
        F.countDistinct(F.when(~F.col(connected), F.col(group))).alias("groups_missing"),
    )


def coverage_by_group(members: DataFrame, group: str, connected: str, relevant: str) -> DataFrame:
    return members.groupBy(group).agg(F.sum(F.col(connected).cast("long")).alias("matched"), F.count("*").alias("total"), F.sum(F.col(relevant).cast("long")).alias("relevant"))


def review_status(state: Column, reason: Column, cooling: Column, retryable: Column) -> Column:
    """Aggregate: a group's status by the first that holds for any of its rows, or for all for the last but one."""
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    retry = some(state == "needs_retry")
    return (
        F.when(retry & some(cooling), "waiting for provider").when(some(reason == "provider_unavailable"), "waiting for provider")
        .when(some(reason == "provider_search_deferred"), "search deferred").when(retry & some(retryable), "needs retry").when(retry, "manual review required")
        .when(some(reason == "no_candidates"), "no candidates").when(some(reason == "artist_unresolved"), "artist needs review")
        .when(F.min(F.coalesce(reason == "not_evaluated", F.lit(False))), "not searched").otherwise("needs review")
    )


def conflicting(rows: DataFrame, namespace: Sequence[str], value: str) -> DataFrame:
    """Namespaces with more than one distinct value, with their values in order."""
    return rows.groupBy(*namespace).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def repeated(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have."""
    return rows.groupBy(*key).agg(F.count("*").alias("owners")).where("owners > 1")


def consistent(observations: DataFrame, namespace: Sequence[str], value: str, many: Column) -> DataFrame:
    """Observations of namespaces with one value, or of those that may hold many. Never a majority vote."""
    counts = observations.groupBy(*namespace).agg(F.countDistinct(value).alias("__n"))
    return observations.join(counts, list(namespace)).where((F.col("__n") == 1) | many).drop("__n")


def claim_decisions(claims: DataFrame, namespace: Sequence[str], value: str, invalid: Column, independent: DataFrame) -> DataFrame:
    """Per namespace: conflicting_observations, invalid, conflicting_independent or accepted. independent has the namespace and a value column."""
    grouped = claims.groupBy(*namespace).agg(F.array_sort(F.collect_set(value)).alias("values"), F.max(invalid).alias("__invalid"))
    others = independent.groupBy(*namespace).agg(F.collect_set(value).alias("__known"))
    clash = F.coalesce(F.exists("__known", lambda k: k != F.get("values", F.lit(0))), F.lit(False))
    decision = F.when(F.size("values") != 1, "conflicting_observations").when(F.col("__invalid"), "invalid").when(clash, "conflicting_independent").otherwise("accepted")
    return grouped.join(others, list(namespace), "left").select(*namespace, "values", decision.alias("decision"))


def completeness(rows: DataFrame, group: str, disc: str, discs: str, track: str, tracks: str) -> DataFrame:
    """(group, complete): all positions known, positive, in range and distinct, totals agreed and reached."""
    good = F.coalesce((F.col(disc) > 0) & (F.col(discs) > 0) & (F.col(track) > 0) & (F.col(tracks) > 0) & (F.col(disc) <= F.col(discs)) & (F.col(track) <= F.col(tracks)), F.lit(False))
    each = rows.withColumn("__good", good).groupBy(group, disc).agg(
        F.min("__good").alias("good"), F.min(discs).alias("a"), F.max(discs).alias("b"), F.min(tracks).alias("c"), F.max(tracks).alias("d"), F.countDistinct(track).alias("n"), F.count("*").alias("rows"))
    full = F.col("good") & (F.col("c") == F.col("d")) & (F.col("n") == F.col("rows")) & (F.col("n") == F.col("c"))
    done = F.min(F.coalesce(full, F.lit(False))) & (F.min("a") == F.max("b")) & (F.count("*") == F.min("a"))
    return each.groupBy(group).agg(F.coalesce(done, F.lit(False)).alias("complete"))


def required_tracks(rows: DataFrame, group: str, disc: str, number: str, title_key: str) -> DataFrame:
    """(group, required): a lower bound of a programme's length from distinct positions, or titles where there are none, and the greatest number unless numbers look malformed."""
    numbered = F.coalesce(F.col(number) > 0, F.lit(False))
    key = F.when(numbered, F.concat_ws(":", F.coalesce(F.col(disc), F.lit(1)).cast("string"), F.col(number).cast("string"))).when(F.col(title_key) != "", F.concat(F.lit("title:"), F.col(title_key)))
    size = F.count("*")
    g = rows.withColumn("__key", key).groupBy(group).agg(F.countDistinct("__key").alias("keys"), size.alias("n"), F.max(number).alias("top"), F.array_sort(F.collect_list(number)).alias("numbers"))
    malformed = (F.size(F.filter("numbers", lambda v: v > F.col("n") * 4)) * 2 >= F.col("n")) & (F.col("n") >= 3)
    return g.select(group, F.when(malformed, F.col("keys")).otherwise(F.greatest(F.col("keys"), F.coalesce(F.col("top"), F.lit(0)))).cast("long").alias("required"))


def all_ignored(targets: DataFrame, target: str, ignored: str) -> DataFrame:
    """(target, all_ignored): true for targets with rows, all of them ignored."""
    return targets.groupBy(target).agg(F.min(ignored).alias("all_ignored"))


def representative(rows: DataFrame, group: str, order: Sequence[Column], id_col: str) -> DataFrame:
    """(group, id): the row of each group that comes first by the order, ties to the smaller id."""
    return rows.groupBy(group).agg(F.min_by(F.col(id_col), F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*order, F.col(id_col)])])).alias(id_col))
