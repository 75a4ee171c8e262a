"""Catalogue entities: identities, membership, removal and reuse, merging, fallback between providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, sets
from tessera.operators.graph import cut

IDENTITY = ["provider", "kind", "external_id"]


def attached(identities: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """identities with the new ones; what was there is not repeated."""
    return identities.unionByName(new).dropDuplicates([owner, *IDENTITY])


def owners(identities: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """All owners of each wanted identity."""
    return wanted.select(*IDENTITY).distinct().join(identities, IDENTITY).select(*IDENTITY, owner)


def single_reference(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The one value a key refers to; keys with several have none."""
    return sets.unique_or_none(rows, key, value)


def removal_preview(affected: DataFrame, saved: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """One row: how many saved tracks a removal takes and whether any has local sources."""
    hit = sets.flagged(sets.having(affected.select(key).distinct(), saved, [key]), local, [key], "__local")
    return hit.agg(F.count("*").alias("saved_tracks"), F.coalesce(F.max("__local"), F.lit(False)).alias("has_local_sources"))


def removed(saved: DataFrame, affected: DataFrame, key: str) -> DataFrame:
    return sets.having(saved, affected, [key], False)


def suppressed(suppressions: DataFrame, affected: DataFrame, sources: DataFrame, key: str, source: str) -> DataFrame:
    """Suppressions with the sources of removed tracks, so that a scan doesn't bring them back."""
    return suppressions.select(source).unionByName(sources.join(affected.select(key).distinct(), key, "left_semi").select(source)).distinct()


def restored(saved: DataFrame, sources: DataFrame, suppressions: DataFrame, key: str, source: str) -> DataFrame:
    """Membership with the tracks of available sources that aren't suppressed."""
    back = sets.having(sources.where("available"), suppressions, [source], False).select(key)
    return saved.select(key).unionByName(back).distinct()


def saved_positions(wanted: DataFrame, tracks: DataFrame, saved: DataFrame, by_identity: DataFrame) -> DataFrame:
    """(disc, number) of a release's positions that are saved: by the position in the known edition, or by a track's identity. wanted: disc, number, external_id; tracks: track_id, disc, number; by_identity: track_id, external_id."""
    mine = sets.having(tracks, saved, ["track_id"])
    known = sets.having(by_identity, saved, ["track_id"])
    return sets.distinct_union(wanted.join(mine, ["disc", "number"], "left_semi").select("disc", "number"), wanted.join(known, ["external_id"], "left_semi").select("disc", "number"))


def mergeable(identities: DataFrame, owner: str, first: int = 512) -> DataFrame:
    """(owner, into): owners that share an identity and are merged into the smallest; a pair whose identities of some namespace differ without one in common is vetoed.

    Owners are numbered in order and cut into blocks that double in size. A round joins the identities of the
    owners not merged yet with those of one block, which gives all that a pair shares at once; owners that a
    round merges need no later block, as those only hold larger ones. So each shared identity of a pair is met
    once at most, and the rounds are as many as owners have binary digits.
    """
    ids = identities.select(F.col(owner).alias("x"), *IDENTITY).where(F.col("x").isNotNull()).distinct()
    numbers = graph.numbered(ids.select("x").distinct(), "x", "n")
    # Blocks 1, 2, 3, ...: the first owners, as many again, twice as many and so on.
    ids = cut(ids.join(numbers.withColumn("block", F.length(F.bin((F.col("n") / first).cast("long"))) + (F.col("n") >= first).cast("int")), "x").drop("x"))
    spaces = cut(ids.where("provider is not null and kind is not null").groupBy("n").agg(F.collect_set(F.struct("provider", "kind")).alias("spaces")))
    last = ids.agg(F.max("block")).first()[0] or 0
    known = []
    for block in range(1, last + 1):
        open_ = ids.where(F.col("block") >= block)
        for done in known:
            open_ = open_.join(done, "n", "left_anti")
        smaller = ids.where(F.col("block") == block).select(F.col("n").alias("m"), *IDENTITY)
        pairs = open_.join(smaller, IDENTITY).where("m < n").groupBy("n", "m").agg(F.countDistinct("provider", "kind").alias("shared"))
        common = F.size(F.array_intersect("spaces", "m_spaces"))
        judged = pairs.join(spaces, "n").join(spaces.select(F.col("n").alias("m"), F.col("spaces").alias("m_spaces")), "m").where(common == F.col("shared"))
        known.append(cut(judged.groupBy("n").agg(F.min("m").alias("m"))))
    found = known[0] if known else ids.select("n", F.col("n").alias("m")).limit(0)
    for more in known[1:]:
        found = found.unionByName(more)
    names = lambda n, name: numbers.select(F.col("n").alias(n), F.col("x").alias(name))
    return found.join(names("n", owner), "n").join(names("m", "into"), "m").select(owner, "into")


def fallback(attempts: DataFrame, subject: str) -> DataFrame:
    """(subject, provider, state): the provider chain's result from attempts (subject, priority, provider, state, pinned). Providers are tried in order, only the pinned one if there is one; success, a skip or a programme ends the chain; a deferral goes on, to be tried again; errors go on."""
    pins = attempts.where("pinned").groupBy(subject).agg(F.min("priority").alias("__pin"))
    rows = attempts.join(pins, subject, "left").where("__pin is null or priority = __pin")
    ends = F.col("state").isin("success", "skip", "program")
    return rows.groupBy(subject).agg(F.coalesce(F.min(F.when(ends, F.struct("priority", "provider", "state"))), F.max(F.struct("priority", "provider", "state"))).alias("r"), F.max((F.col("state") == "deferred")).alias("retry")).select(subject, "r.provider", "r.state", "retry")


def trusted_tracks(manual: DataFrame, direct: DataFrame, accepted: DataFrame) -> DataFrame:
    """(external_id, track_id) that one track alone has: manual associations, then direct ones of tracks without a manual one, then accepted ones of tracks without either."""
    by_track = sets.first_of([manual, direct, accepted], ["track_id"])
    return sets.unique_or_none(by_track, ["external_id"], "track_id")
