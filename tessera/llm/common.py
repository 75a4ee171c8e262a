"""Shared pieces: lineage cuts, packed shuffles' helpers, connected components."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset a fresh local one, on a local master only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if set_dir is None and current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if current is None:
        context.setCheckpointDir(set_dir)
    return set_dir or current


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Holds the session's Arrow batches to 8 MB, from Spark's 64 MB, so that long texts and packs stay small in Python workers. It stays set, as plans run later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > most:
        spark.conf.set(name, f"{most}b")


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that nothing refers to any more, such as those before a cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: rows (id, component), component the smallest id.

    Minimum-label hooking of parents and grandparents with pointer jumping; every round is joins
    and partial aggregates over distributed tables and ends in a checkpoint. Vertices without an edge
    are not returned; self-loops, repeated edges and an empty list are fine; null ends are ignored.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parent = cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("p")))
    for _ in range(max_rounds):
        up = parent.select(F.col("id").alias("p"), F.col("p").alias("gp"))
        grand = cut(parent.join(up, "p").select("id", "p", "gp"))
        seen = both.join(grand.select(F.col("id").alias("v"), F.col("gp").alias("vgp")), "v").groupBy("u").agg(F.min("vgp").alias("m"))
        hooked = grand.join(seen, grand.id == seen.u).select("id", "p", "gp", F.least("m", "gp").alias("m"))
        offers = hooked.select(F.inline(F.array(
            F.struct(F.col("id").alias("id"), F.col("m").alias("p"), F.col("p").alias("old")),
            F.struct(F.col("p").alias("id"), F.col("m").alias("p"), F.lit(None).cast("long").alias("old")),
        )))
        new = cut(offers.groupBy("id").agg(F.min("p").alias("p"), F.max("old").alias("old")))
        moved = new.agg(F.sum((F.col("p") != F.col("old")).cast("long"))).first()[0]
        parent = new.select("id", "p")
        if not moved:
            return parent.select("id", F.col("p").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
