"""Projections kept up by signed deltas: what a row gave is taken back with weight -1, what it gives now is added with +1."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import incremental
from tessera.operators.graph import cut
from tessera.sources import segments

#: Rows of the base table to (grp, value), both strings; each row of the result weighs one.
View = Callable[[DataFrame], DataFrame]

REVISION = "revision"
_WEIGHT = ["view", "grp", "value"]


def apply(spark: SparkSession, path: str, epoch: int, changes: DataFrame, key: Sequence[str], views: Mapping[str, View], revised: Sequence[str] = ()) -> None:
    """Takes a batch of changes (the key, the base table's columns, seq, deleted) into the base rows and projections kept at path.

    Of several changes of one key the last by seq counts, and it must be later than the kept one's, or it changes nothing: late rows are
    dropped, deleted rows are remembered for that. Null deleted is false; rows with a null key are refused. Views must be row by row (projections, filters,
    explode), so that the deltas of a batch come from the batch's rows, old and new, and from nothing else. revised names columns of which
    each value's changes are counted in the view "revision": a row that is inserted, deleted or differs is one change, for the old and the new value of
    the column if they differ. Batches that run again write the same. Both tables are in segments that are merged as they grow; merging drops
    weights that cancelled out, and replaced rows.
    """
    rows = incremental.latest(changes.withColumn("deleted", F.coalesce("deleted", F.lit(False))), key, ["seq", "deleted"])
    segments.refuse_nulls(rows, key)
    base, weights = f"{path}/base", f"{path}/weights"
    before = segments.listed(spark, base, before=epoch)
    columns = [c for c in rows.columns if c not in (*key, "seq", "deleted")]
    now = F.struct(*columns)
    new = rows.select(*key, F.col("seq").alias("new_seq"), F.col("deleted").alias("gone"), now.alias("new"))
    if before:
        old = segments.of_keys(spark, base, "rows", before, rows.select(*key)).select(*key, F.col("seq").alias("old_seq"), F.col("deleted").alias("was_gone"), now.alias("old"))
        both = new.join(old, list(key), "left").where("old_seq IS NULL OR new_seq > old_seq")
    else:
        both = new.withColumns({"old_seq": F.lit(None).cast("long"), "was_gone": F.lit(True), "old": F.lit(None).cast(rows.select(now.alias("s")).schema["s"].dataType)})
    both = both.withColumns({"old": F.when(~F.coalesce("was_gone", F.lit(True)), F.col("old")), "kept": F.when(~F.col("gone"), F.col("new"))})
    both = cut(both)  # every view reads it twice
    side = lambda c: both.where(F.col(c).isNotNull() & ~F.col("old").eqNullSafe(F.col("kept"))).select(*key, f"{c}.*")
    signed = [_given(view, side(c)).select(F.lit(name).alias("view"), "grp", "value", F.lit(sign).alias("weight")) for name, view in views.items() for c, sign in (("old", -1), ("kept", 1))]
    for column in revised:
        touched = F.explode(F.array_distinct(F.array(*[F.when(F.col(c).isNotNull(), F.col(f"{c}.{column}").cast("string")) for c in ("old", "kept")])))
        counted = both.where(~F.col("old").eqNullSafe(F.col("kept"))).select(touched.alias("grp")).where("grp IS NOT NULL")
        signed.append(counted.select(F.lit(REVISION).alias("view"), "grp", F.lit(column).alias("value"), F.lit(1).alias("weight")))
    delta = _summed(reduce(DataFrame.unionByName, signed))
    kept = segments.listed(spark, weights, before=epoch)
    if segments.due(kept):
        delta, kept = _summed(reduce(DataFrame.unionByName, [segments.read(spark, weights, s, "weights") for s in kept], delta)), []
    segments.commit(spark, weights, epoch, {"weights": segments.Part(delta, _WEIGHT)}, kept, "weights")
    taken = both.select(*key, F.col("new_seq").alias("seq"), F.col("gone").alias("deleted"), "new.*").select(rows.columns)
    ids = taken.select(*key)
    if segments.due(before):
        taken, before = taken.unionByName(segments.live(spark, base, "rows", before).join(ids, list(key), "left_anti").select(taken.columns)), []
    segments.commit(spark, base, epoch, {"rows": segments.Part(taken, key), "ids": segments.Part(ids, key)}, before, "rows")


def _given(view: View, rows: DataFrame) -> DataFrame:
    return view(rows).select(F.col("grp").cast("string").alias("grp"), F.col("value").cast("string").alias("value"))


def _summed(rows: DataFrame) -> DataFrame:
    """Partial sums are taken before the shuffle, so a hot group costs one row a task."""
    return rows.groupBy(*_WEIGHT).agg(F.sum("weight").alias("weight")).where("weight <> 0")


def contents(spark: SparkSession, path: str, view: str, groups: Sequence[str] | None = None) -> DataFrame:
    """(grp, value, weight) of a view, or of some groups: view and groups are ranges of the sorted segments that the scans are pruned by."""
    listed = segments.listed(spark, f"{path}/weights")
    if not listed:
        raise FileNotFoundError(f"no projections at {path}")
    where = F.col("view") == view if groups is None else (F.col("view") == view) & F.col("grp").isin(*groups)
    return _summed(reduce(DataFrame.unionByName, [segments.read(spark, f"{path}/weights", s, "weights").where(where) for s in listed])).drop("view")


def first_values(spark: SparkSession, path: str, view: str) -> DataFrame:
    """(grp, value, n): the smallest value that a group still has, and how many rows give any. Works after deletions too, as all values are kept with their weights."""
    return contents(spark, path, view).groupBy("grp").agg(F.min("value").alias("value"), F.sum("weight").alias("n"))


def base(spark: SparkSession, path: str) -> DataFrame:
    """The base table's rows that aren't deleted."""
    return segments.live(spark, f"{path}/base", "rows").where("NOT deleted").drop("deleted", "seq")
