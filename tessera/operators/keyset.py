"""Keyset pages: filter on a cursor, order by the keys, take a few rows.

Keys must be free of nulls (coalesce them first) and end in a unique one. Beside the comparison of all
keys each page filters on the first key alone, which file sources can push down.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 201


def clamp(limit: int, most: int = MOST) -> int:
    return max(1, min(limit, most))


def _literals(df: DataFrame, keys: Sequence[str], values: Sequence[Any]) -> list[Column]:
    return [F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, values, strict=True)]


def beyond(df: DataFrame, keys: Sequence[str], cursor: Sequence[Any], down: bool = False, inclusive: bool = False) -> Column:
    """Rows after the cursor in key order, or before it for down."""
    values = _literals(df, keys, cursor)
    row, mark, first = F.struct(*keys), F.struct(*[v.alias(k) for k, v in zip(keys, values, strict=True)]), F.col(keys[0])
    if down:
        return (first <= values[0]) & (row <= mark if inclusive else row < mark)
    return (first >= values[0]) & (row >= mark if inclusive else row > mark)


def page(df: DataFrame, keys: Sequence[str], after: Sequence[Any] | None = None, limit: int | None = 50, descending: bool = False, reverse: bool = False, inclusive: bool = False) -> DataFrame:
    """A page in key order. reverse reads towards the start, nearest rows first; limit None reads all."""
    down = descending != reverse
    rows = df if after is None else df.where(beyond(df, keys, after, down, inclusive))
    rows = rows.orderBy(*[F.col(k).desc() if down else F.col(k).asc() for k in keys])
    return rows if limit is None else rows.limit(clamp(limit))


def around(df: DataFrame, keys: Sequence[str], target: Sequence[Any], preceding: int = 100, limit: int = MOST) -> DataFrame:
    """Up to `preceding` rows before a target and the rest of the limit from the target on."""
    before = page(df, keys, target, max(1, min(preceding, 100)), reverse=True)
    return before.unionByName(page(df, keys, target, clamp(limit), inclusive=True)).orderBy(*keys)


def between(df: DataFrame, keys: Sequence[str], first: Sequence[Any], last: Sequence[Any]) -> DataFrame:
    """All rows from one anchor to another, both included, whichever comes first."""
    low, high = sorted([tuple(first), tuple(last)])
    return df.where(beyond(df, keys, low, inclusive=True) & beyond(df, keys, high, down=True, inclusive=True))


def cursor_of(df: DataFrame, id_col: str, value: Any, keys: Sequence[str]) -> DataFrame:
    """The keys of one row."""
    return df.where(F.col(id_col) == F.lit(value)).select(*keys)


def top_of_each(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def more_than(df: DataFrame, n: int = 1000) -> bool:
    """Whether there are more than n rows, reading n + 1 at most."""
    return df.limit(n + 1).count() > n
