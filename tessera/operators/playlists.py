"""Ordered lists with repeats and gaps in their positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import keyset
from tessera.operators.graph import cut


def ordinals(entries: DataFrame, list_col: str, position: str) -> DataFrame:
    """Adds ordinal, from 1 in each list, whatever the gaps."""
    return entries.withColumn("ordinal", F.row_number().over(Window.partitionBy(list_col).orderBy(position)))


def overall(entries: DataFrame, order: Sequence[str], ranges: int | None = None, rows_a_range: int = 1_000_000) -> DataFrame:
    """Adds overall, from 1 over all lists in the given order. Rows are range-partitioned and counted, and each range numbers its own rows after those before it, so no task holds all rows. The ranges are checkpointed: Spark samples their bounds, and counts and rows must see the same ones."""
    ranges = ranges or max(1, -(-entries.count() // rows_a_range))
    ranged = cut(entries.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return numbered.join(F.broadcast(before), "__range").withColumn("overall", (F.col("__k") + F.col("__before")).cast("long")).drop("__range", "__k", "__before")


def entry_range(entries: DataFrame, list_col: str, position: str, first: int, last: int) -> DataFrame:
    """Entries of each list from one ordinal to another, in either order of the two."""
    return ordinals(entries, list_col, position).where(F.col("ordinal").between(min(first, last), max(first, last)))


def view(entries: DataFrame, sort: Column, tie: Sequence[str], after: tuple | None = None, limit: int | None = 50, reverse: bool = False) -> DataFrame:
    """A page of entries in another order than their positions; nulls must be mapped by the caller (an unknown length to -1)."""
    return keyset.page(entries.withColumn("sort_key", sort), ["sort_key", *tie], after, limit, reverse=reverse)


def append_plan(entries: DataFrame, added: DataFrame, list_col: str, item: str, position: str, order: str, include_existing: bool = False) -> DataFrame:
    """(list, item, position) of the rows to add: items that a list has are left out unless wanted, repeats within the added stay, positions follow the last one."""
    new = added if include_existing else added.join(entries.select(list_col, item).distinct(), [list_col, item], "left_anti")
    last = entries.groupBy(list_col).agg(F.max(position).alias("__last"))
    number = F.row_number().over(Window.partitionBy(list_col).orderBy(order))
    return new.withColumn("__k", number).join(last, list_col, "left").select(list_col, item, (F.coalesce("__last", F.lit(-1)) + F.col("__k")).cast("long").alias(position))


def moved(entries: DataFrame, list_col: str, position: str, moves: DataFrame) -> DataFrame:
    """Entries with ordinals after each list's move (list, from_ordinal, to_ordinal); others keep their order."""
    numbered = ordinals(entries, list_col, position).join(moves, list_col, "left")
    k, a, b = F.col("ordinal"), F.col("from_ordinal"), F.col("to_ordinal")
    new = F.when(k == a, b).when((a < b) & (k > a) & (k <= b), k - 1).when((a > b) & (k < a) & (k >= b), k + 1).otherwise(k)
    return numbered.withColumn("ordinal", F.coalesce(new, k).cast("int")).drop("from_ordinal", "to_ordinal")


def removed(entries: DataFrame, list_col: str, position: str, gone: DataFrame) -> DataFrame:
    """Entries without those in gone (list, position); positions keep their gaps."""
    return entries.join(gone.select(list_col, position), [list_col, position], "left_anti")


def revision(entries: DataFrame, list_col: str, position: str, item: str) -> DataFrame:
    """(list, revision): changes whenever a list's items or their order do. A sum of the hashes of items with their ordinals, so no list is gathered in a row; gaps and shifts of positions that keep the order don't count."""
    numbered = ordinals(entries.select(list_col, position, item), list_col, position)
    digest = F.md5(F.concat_ws(":", F.col("ordinal").cast("string"), F.coalesce(F.concat(F.lit("="), F.col(item).cast("string")), F.lit("null"))))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    return numbered.groupBy(list_col).agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(half(1)).cast("string"), F.sum(half(16)).cast("string")).alias("revision"))


def next_eligible(entries: DataFrame, list_col: str, position: str, eligible: str) -> DataFrame:
    """Adds next_position and previous_position: the nearest eligible entries after and before each one."""
    own = F.when(F.col(eligible), F.col(position))
    order = Window.partitionBy(list_col).orderBy(position)
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("next_position", F.min(own).over(after)).withColumn("previous_position", F.max(own).over(before))
