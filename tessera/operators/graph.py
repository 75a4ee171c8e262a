"""Closures over undirected edge lists, and maps to canonical ids."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set already; where both are unset, a folder of its own on a local master only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Writes rows to the shared folder and reads them again: compressed, by column and of a known size, so that small ones are broadcast unshuffled."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleaned(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def released(df: DataFrame) -> DataFrame:
    """kept, and lets Spark's cleaner delete the shuffle files behind it, which nothing refers to any more."""
    out = kept(df)
    cleaned(df.sparkSession)
    return out


def buckets(rows: DataFrame, rows_each: int = 100_000) -> int:
    """How many buckets to deal rows into: as many as shuffles have partitions, more if a bucket would have more rows than rows_each."""
    conf = rows.sparkSession.conf
    return min(max(int(conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_each)), int(conf.get("spark.sql.sources.bucketing.maxBuckets")))


def dealt(df: DataFrame, by: str, number: int, lying: bool = False) -> DataFrame:
    """Writes rows to the shared folder in buckets by a column: groupings, windows and joins by it, within together() also by it and others, read them unshuffled. lying: rows come from tables with as many buckets by it and aren't shuffled first."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    rows = df if lying else df.repartition(number, by)
    rows.write.bucketBy(number, by).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the table is external, its files stay
    cleaned(spark)
    return out


@contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """released, only until what reads it is written: its files are deleted at the end."""
    spark = df.sparkSession
    rows = released(df)
    folders = {f.rpartition("/")[0] for f in rows.inputFiles()}
    yield rows
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """Within, joins by several keys take rows as they lie if they are dealt by some of these keys; what is planned later isn't affected."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(rows: DataFrame, by: str, number: str) -> DataFrame:
    """rows with their number in the order of a column, from 0, counted in ranges of it side by side."""
    parts = cut(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return cut(parts.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").select(*rows.columns, (within + F.col("__before")).cast("long").alias(number)))


def reachable(edges: DataFrame, seeds: DataFrame, a: str = "a", b: str = "b", seed: str = "seed") -> DataFrame:
    """(seed, node) for all nodes reachable from each seed over undirected edges, itself included: the members of its component, found by doubling steps however long the chains are."""
    labels = canonical(edges, a, b)
    own = seeds.select(F.col(seed).alias("seed")).distinct().join(labels.select(F.col("id").alias("seed"), "canonical"), "seed", "left")
    members = labels.select(F.col("id").alias("node"), "canonical")
    return own.join(members, "canonical", "left").select("seed", F.coalesce("node", "seed").alias("node"))


def canonical(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(id, canonical): each vertex of an edge with the smallest id of its component, by smallest neighbour and pointer jumping."""
    both = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    label = cut(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("canonical")))
    for _ in range(most_rounds):
        offered = both.join(label.select(F.col("id").alias("y"), "canonical"), "y").groupBy(F.col("x").alias("id")).agg(F.min("canonical").alias("offer"))
        hooked = label.join(offered, "id").select("id", F.col("canonical").alias("old"), F.least("canonical", "offer").alias("c"))
        jumped = hooked.join(hooked.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c").select("id", "old", F.col("cc").alias("canonical"))
        new = cut(jumped)
        if new.where("old <> canonical").isEmpty():
            return new.select("id", "canonical")
        label = new.select("id", "canonical")
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")


def repointed(rows: DataFrame, column: str, canonical_ids: DataFrame) -> DataFrame:
    """rows with ids replaced by their canonical ones, and rows that became equal merged."""
    merged = rows.join(canonical_ids.select(F.col("id").alias(column), F.col("canonical").alias("__c")), column, "left")
    return merged.withColumn(column, F.coalesce("__c", column)).select(*rows.columns).distinct()


def shared_value_edges(rows: DataFrame, id_col: str, value: list[str]) -> DataFrame:
    """A star of edges for each value that several ids share, so a hot value has as many edges as ids."""
    ids = rows.select(id_col, *value).distinct()
    hubs = ids.groupBy(*value).agg(F.min(id_col).alias("a"))
    return ids.join(hubs, value).where(F.col(id_col) != F.col("a")).select("a", F.col(id_col).alias("b")).distinct()
