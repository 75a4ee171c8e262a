"""Effective values: overrides over observations over defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tri_state(base: Column, is_set: Column, value: Column) -> Column:
    """An override that is set replaces the base, by null too; one that isn't leaves it."""
    return F.when(F.coalesce(is_set, F.lit(False)), value).otherwise(base)


def with_overrides(rows: DataFrame, overrides: DataFrame, key: Sequence[str], fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """fields: column to (its set flag, its value) in overrides, which has one row a key at most."""
    names = [x for pair in fields.values() for x in pair]
    out = rows.join(overrides.select(*key, *names), list(key), "left")
    return out.withColumns({c: tri_state(F.col(c), F.col(flag), F.col(value)) for c, (flag, value) in fields.items()}).drop(*names)


def only_source(rows: DataFrame, sources: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows with the columns of their source if they have exactly one, else nulls."""
    single = sources.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in columns]).where("__n = 1").drop("__n")
    return rows.join(single, key, "left")


def genre_list(text: Column, separator: str = "·") -> Column:
    """Trimmed parts of a joined genre text, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(text, f"\\Q{separator}\\E"), lambda g: F.regexp_replace(g, r"(?U)^\s+|\s+$", "")), lambda g: g != ""))


def first_known(*values: Column, default: str = "") -> Column:
    return F.coalesce(*values, F.lit(default))


def best_duration(observations: DataFrame, key: str, duration: str, exact: str, order: str) -> DataFrame:
    """(key, duration): an exact observation before an approximate one, then the first in order."""
    return observations.where(F.col(duration).isNotNull()).groupBy(key).agg(F.min_by(F.col(duration), F.struct(F.when(F.col(exact), 0).otherwise(1).alias("a"), F.col(order).alias("b"))).alias(duration))


def year_key(year: Column) -> Column:
    """Text that sorts later years first and unknown ones last."""
    return F.when(year.isNotNull(), F.format_string("%012d", F.lit(999999).cast("long") - year.cast("long"))).otherwise("999999999999")


def album_key(year: Column, title: Column) -> Column:
    return F.concat_ws("\x1f", year_key(year), F.lower(title))
