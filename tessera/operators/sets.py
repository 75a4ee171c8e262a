"""Set-shaped operators: membership, tri-state filters, unions with precedence, unique-or-none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_list(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Rows whose column is in a list; a list of over 200 becomes a join."""
    if len(values) <= 200:
        return df.where(F.col(column).isin(list(values)))
    listed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], [column]).select(F.col(column).cast(df.schema[column].dataType))
    return df.join(listed, column, "left_semi")


def matching(df: DataFrame, filters: Mapping[str, Sequence[Any] | None]) -> DataFrame:
    """OR within a column's values, AND across columns; None or an empty list filters nothing."""
    tests = [F.col(c).isin(list(v)) for c, v in filters.items() if v]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def having(df: DataFrame, other: DataFrame, on: Sequence[str], wanted: bool | None = True) -> DataFrame:
    """Rows with (True) or without (False) a partner in other; None keeps all."""
    if wanted is None:
        return df
    return df.join(other.select(*on), list(on), "left_semi" if wanted else "left_anti")


def flagged(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Adds a boolean: whether other has a partner. other is reduced to its keys first, so rows aren't repeated."""
    keys = other.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(keys, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def distinct_union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def first_of(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union in which, for each key, only the rows of the earliest part that has the key stay."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("__priority", F.lit(i)) for i, p in enumerate(parts)])
    return ranked.withColumn("__best", F.min("__priority").over(Window.partitionBy(*key))).where("__priority = __best").drop("__priority", "__best")


def unique_or_none(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row for each key with a single distinct value; ambiguous keys are withheld."""
    return df.groupBy(*key).agg(F.min(value).alias(value), F.countDistinct(value).alias("__n")).where("__n = 1").drop("__n")


def unique_on_both_sides(pairs: DataFrame, left: str, right: str, within: Sequence[str] = ()) -> DataFrame:
    """Pairs that are the only one of their left and of their right side."""
    counted = pairs.withColumn("__l", F.count("*").over(Window.partitionBy(*within, left))).withColumn("__r", F.count("*").over(Window.partitionBy(*within, right)))
    return counted.where("__l = 1 and __r = 1").drop("__l", "__r")


def undominated(df: DataFrame, within: Sequence[str], key: str, evidence: Sequence[str]) -> DataFrame:
    """Rows of each group that no other row equals or beats in all evidence and beats in some."""
    names = [*within, key, *evidence]
    rivals = df.select(*[F.col(c).alias(f"__{c}") for c in names])
    at_least = reduce(Column.__and__, [F.col(f"__{c}") >= F.col(c) for c in evidence])
    better = reduce(Column.__or__, [F.col(f"__{c}") > F.col(c) for c in evidence])
    same = reduce(Column.__and__, [F.col(f"__{c}") == F.col(c) for c in within])
    return df.join(rivals, same & (F.col(f"__{key}") != F.col(key)) & at_least & better, "left_anti")


def toggled(selected: Column, value: Column) -> Column:
    """A selection with a value added, or removed if it was there."""
    return F.when(F.array_contains(selected, value), F.array_remove(selected, value)).otherwise(F.array_append(selected, value))
