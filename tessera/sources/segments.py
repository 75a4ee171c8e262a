"""Tables in segments: a batch adds a sorted segment, a manifest says which segments count, compaction merges them.

path/data/<segment>/<part> holds a segment's parts as Parquet, path/manifest/e=<epoch> the segments that count once that epoch is in, oldest first.
A manifest is written last, so readers see a batch whole or not at all, and a batch that runs again starts from the manifest before it and
writes the same. What neither of the two newest manifests names is deleted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import incremental
from tessera.operators.graph import cut


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int


@dataclass(frozen=True)
class Part:
    """Rows to be written, range-partitioned and sorted by some columns; leading ones give row groups narrow ranges for filters to prune."""

    rows: DataFrame
    sort: Sequence[str]


def listed(spark: SparkSession, path: str, before: int | None = None) -> list[Segment]:
    """The segments that count, oldest first: by the newest manifest, of the epochs before one if given. None yet: an empty list."""
    epochs = [e for e in _epochs(spark, path) if before is None or e < before]
    return _manifest(spark, path, max(epochs)) if epochs else []


def read(spark: SparkSession, path: str, segment: Segment, part: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data/{segment.name}/{part}")


def live(spark: SparkSession, path: str, part: str, segments: Sequence[Segment] | None = None, where: Column | None = None) -> DataFrame:
    """Rows of a part that count: of each segment those whose keys, in its part "ids", no later one has. The filter goes to each scan."""
    out, later = None, None
    for segment in reversed(listed(spark, path) if segments is None else segments):
        rows, ids = read(spark, path, segment, part), read(spark, path, segment, "ids")
        rows = rows if where is None else rows.where(where)
        rows = rows if later is None else rows.join(later, ids.columns, "left_anti").select(rows.columns)
        later = ids if later is None else ids.unionByName(later)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(f"no segments at {path}")
    return out


def of_keys(spark: SparkSession, path: str, part: str, segments: Sequence[Segment], keys: DataFrame) -> DataFrame:
    """live() for the given keys (one row each) only. The range of their first column is taken first, so that scans skip what lies outside it."""
    first = keys.columns[0]
    low, high = keys.agg(F.min(first), F.max(first)).first()
    return live(spark, path, part, segments, F.lit(False) if low is None else F.col(first).between(low, high)).join(keys, keys.columns, "left_semi")


def refuse_nulls(rows: DataFrame, key: Sequence[str]) -> None:
    if not rows.where(" OR ".join(f"`{c}` IS NULL" for c in key)).isEmpty():
        raise ValueError("null in a key")


def upsert(spark: SparkSession, path: str, epoch: int, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> None:
    """Keeps a table of the last row of each key by order, in the part "rows"; late rows change nothing. Keys must not be null: rows with a null one are refused."""
    rows = incremental.latest(batch, key, order)
    refuse_nulls(rows, key)
    before = listed(spark, path, before=epoch)
    if before:
        old = live(spark, path, "rows", before) if due(before) else of_keys(spark, path, "rows", before, rows.select(*key))
        rows = incremental.latest(old.unionByName(rows), key, order)
    rows = cut(rows)
    commit(spark, path, epoch, {"rows": Part(rows, key), "ids": Part(rows.select(*key), key)}, [] if due(before) else before, "rows")


def commit(spark: SparkSession, path: str, epoch: int, parts: Mapping[str, Part], keep: Sequence[Segment], sized_by: str) -> Segment:
    """Writes a segment and the manifest of the epoch: the segments to keep and this one. sized_by is the part whose rows count as the segment's size."""
    name = f"e={epoch}"
    for part, p in parts.items():
        p.rows.repartitionByRange(*p.sort).sortWithinPartitions(*p.sort).write.mode("overwrite").parquet(f"{path}/data/{name}/{part}")
    segment = Segment(name, spark.read.parquet(f"{path}/data/{name}/{sized_by}").count())
    rows = [(k, s.name, s.rows) for k, s in enumerate([*keep, segment])]
    spark.createDataFrame(rows, "place int, name string, rows long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{name}")
    _clear(spark, path)
    return segment


def due(segments: Sequence[Segment], most: int = 8, share: float = 0.25) -> bool:
    """Whether to compact: many segments beside the first, or later ones that are large against it. Work per row stays logarithmic in the number of batches that way."""
    return len(segments) >= most or (len(segments) > 1 and sum(s.rows for s in segments[1:]) > share * segments[0].rows)


def _manifest(spark: SparkSession, path: str, epoch: int) -> list[Segment]:
    return [Segment(r.name, r.rows) for r in spark.read.schema("place int, name string, rows long").json(f"{path}/manifest/e={epoch}").orderBy("place").collect()]


def _clear(spark: SparkSession, path: str) -> None:
    newest = sorted(_epochs(spark, path))[-2:]
    used = {s.name for e in newest for s in _manifest(spark, path, e)}
    _delete(spark, [f"{path}/manifest/e={e}" for e in _epochs(spark, path) if e not in newest] + [f"{path}/data/{n}" for n in _names(spark, f"{path}/data") if n not in used])


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose manifest is there: Spark moves its one file into place when it is whole."""
    names = _names(spark, f"{path}/manifest")
    return [int(n[2:]) for n in names if n.startswith("e=") and any(f.startswith("part-") for f in _names(spark, f"{path}/manifest/{n}"))]


def _names(spark: SparkSession, folder: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def _delete(spark: SparkSession, folders: Sequence[str]) -> None:
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
