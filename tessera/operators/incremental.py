"""Incremental upkeep: upserts, scans, staleness, caches, diffs against a managed state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import keyset


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the last by order. Max of a struct, so it is partially aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def upserted(current: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """current with the batch's rows in place of those with the same key."""
    return current.join(batch.select(*key).distinct(), list(key), "left_anti").unionByName(batch)


def changed(listing: DataFrame, known: DataFrame, path: str, stamp: Sequence[str]) -> DataFrame:
    """Listed files that are new or whose size or time differs from what is known: the only ones to be read."""
    return listing.join(known.select(path, *stamp), [path, *stamp], "left_anti")


def reconciled(known: DataFrame, seen: DataFrame, key: Sequence[str], complete: bool) -> DataFrame:
    """known with available false for what a complete scan didn't see; an incomplete scan takes nothing away. What was seen is available."""
    marks = seen.select(*key).distinct().withColumn("__seen", F.lit(True))
    out = known.join(marks, list(key), "left")
    gone = F.lit(False) if complete else F.col("available")
    return out.withColumn("available", F.when(F.col("__seen"), True).otherwise(gone)).drop("__seen")


def stale(evaluated: DataFrame, changes: DataFrame, dependencies: DataFrame, subject: str, depends_on: str) -> DataFrame:
    """Subjects to evaluate again: those that depend on anything that changed."""
    return evaluated.join(dependencies.join(changes.select(depends_on).distinct(), depends_on, "left_semi").select(subject).distinct(), subject, "left_semi")


def needs_evaluation(rows: DataFrame, fingerprint: Column, version: int, age: Column, ttl: int, run: str | None = None) -> Column:
    """Fingerprint or version differ, the answer is too old, or it is in flight in another run."""
    test = (F.col("fingerprint") != fingerprint) | (F.col("version") < version) | (age >= ttl)
    return test | ((F.col("state") == "in_flight") & (F.col("run") != run)) if run is not None else test


def work(rows: DataFrame, keys: Sequence[str], after: tuple | None, limit: int) -> DataFrame:
    """The next bounded batch of work after a cursor."""
    return keyset.page(rows, keys, after, limit)


def evicted(cache: DataFrame, observed: str, now: Column, ttl: int, most: int = 32, tie: Sequence[str] = ()) -> DataFrame:
    """The oldest expired entries, of which at most `most` go at a time; equally old ones in order of tie."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp(observed) >= ttl).orderBy(observed, *tie).limit(most)


def cooldowns(events: DataFrame, provider: str, until: str) -> DataFrame:
    """(provider, until): a later cooldown extends an earlier one and never shortens it."""
    return events.groupBy(provider).agg(F.max(until).alias(until))


def managed_changes(desired: DataFrame, managed: DataFrame, independent: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, change): insert what is desired and neither managed nor there independently; delete what is managed and no longer desired."""
    k = list(key)
    add = desired.select(*k).distinct().join(managed.select(*k), k, "left_anti").join(independent.select(*k), k, "left_anti")
    drop = managed.select(*k).distinct().join(desired.select(*k), k, "left_anti")
    return add.withColumn("change", F.lit("insert")).unionByName(drop.withColumn("change", F.lit("delete")))


def fingerprint(*columns: str) -> Column:
    """Equal for equal values of the columns; nulls count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def still_current(replies: DataFrame, inputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replies whose input fingerprint is still the one they answered."""
    return replies.join(inputs.select(*key, F.col("fingerprint").alias("__now")), list(key)).where("fingerprint = __now").drop("__now")


def grouped_candidates(files: DataFrame, directory: Column, title_key: Column, credit_key: Column, id_col: str) -> DataFrame:
    """Files that make up one release: same directory, title and credit."""
    return files.groupBy(directory.alias("directory"), title_key.alias("title_key"), credit_key.alias("credit_key")).agg(F.count("*").alias("files"), F.min(id_col).alias("first_file"))


def admitted(batch: DataFrame, path: str, known: DataFrame, suppressed: DataFrame) -> DataFrame:
    """batch with its class: suppressed, ambiguous (the path came twice with different content), known or new. known and suppressed have path."""
    seen = batch.groupBy(path).agg(F.countDistinct("content").alias("__n"), F.min("content").alias("content"))
    mark = lambda df, name: df.select(path).distinct().withColumn(name, F.lit(True))
    out = seen.join(mark(known, "__k"), path, "left").join(mark(suppressed, "__s"), path, "left")
    kind = F.when(F.col("__s"), "suppressed").when(F.col("__n") > 1, "ambiguous").when(F.col("__k"), "known").otherwise("new")
    return out.select(path, kind.alias("class"))


def route(local: Column, identities: Column, valid: Column, remote_up: Column) -> Column:
    """Where to play a track from: local, remote (exactly one valid identity), or why not."""
    return F.when(local, "local").when(~remote_up, "unavailable").when(valid == 1, "remote").when(identities > 0, "needs correction").otherwise("enrich")
