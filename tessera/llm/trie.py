"""The prefix trie of conversations, by partition refinement.

All conversations start in one class. Each round splits the active classes by their members' next turn; a
class is named by its smallest member and is a node. A class of one member is retired: the rest of that
conversation is a chain of nodes without branches, made for all retired ones at once, without rounds. So
there are as many rounds as turns that conversations share, and they read ever fewer members. Going back from
the deepest round, classes fold what lies below them into their own figures.

A class may hold any share of all conversations: members are joined to their classes by class and turn, never
gathered, and the digest of the ids that end in a class is fed from sorted ranges.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, shared_dir

_NONE = hashlib.sha256(b"").hexdigest()
_SCHEMA = "conv long, depth long, turn string, chars long"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv, depth, role, text): the turns of each conversation numbered from 1 by turn, null first, ties by role and text; null ids go, null role and text become empty."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    window = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("depth", F.row_number().over(window).cast("long")).drop("turn")


def splice_heads(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another one's turns: of c, first those of c - c % every, h of them at most, then its own after its first h; h is the CRC-32 of its id modulo most + 1.

    Gives the turns, and all ids: a conversation may be left without turns.
    """
    base, head = F.col("conv") - F.col("conv") % every, F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    own = turns.groupBy("conv").agg(F.count("*").alias("size"))
    ids = own.select("conv", "size", base.alias("base"), head.alias("h"))
    sizes = own.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    ids = ids.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    heads = turns.where((F.col("conv") % every == 0) & (F.col("depth") <= most)).withColumnRenamed("conv", "base")
    first = ids.select("conv", "base", "taken").join(heads, "base").where("depth <= taken").select("conv", "depth", "role", "text")
    rest = turns.join(ids.select("conv", "h", "taken"), "conv").where("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    return first.unionByName(rest), ids.select("conv", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))


def _digests(ends: DataFrame) -> DataFrame:
    """For rows (conv, depth, id), the SHA-256 of each node's ids, rising and joined by commas.

    Ranges of sorted rows become one text a node and task, in parallel; a node's texts are then hashed in order, a batch at a time.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, node, ids = TaskContext.get().partitionId(), 0, None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, (task << 32) + number, ",".join(map(str, ids)))], ["conv", "depth", "number", "ids"])

        for batch in batches:
            for conv, depth, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (node != (conv, depth) or len(ids) >= 65536):
                    yield row()
                    number, ids = number + 1, []
                node = (conv, depth)
                ids.append(own)
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv", "depth", "ends_sha256"])
        for batch in batches:
            for conv, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != (conv, depth):
                    if node:
                        done.append((node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield out(done)
                done = []
        if node:
            yield out([(node, state.hexdigest())])

    texts = ends.repartitionByRange("conv", "depth", "id").sortWithinPartitions("conv", "depth", "id").mapInArrow(joined, "conv long, depth long, number long, ids string")
    return texts.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "number").mapInArrow(hashed, "conv long, depth long, ends_sha256 string")


def _turn_key(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: rows (conv, depth, role, text), depths without gaps from 1; lengths: rows (conv, length), each conversation
    once, those without turns too. A node is a sequence of turns that its members begin with, down from the root at
    depth 0, which has no parent. saved_tokens sums (n_convs - 1) times the code points of a node's last turn over its
    subtree; ends_sha256 is of the ids of the members with no further turn. Turns are compared by SHA-256 of role and
    text; nulls in them, empty and very long texts are as good as others; repeated conversations share all nodes; other
    columns aren't read. An empty table gives no nodes, not even the root.
    """
    spark = turns.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    keyed = turns.select(F.col("conv").cast("long").alias("conv"), F.col("depth").cast("long").alias("depth"), _turn_key(role, text).alias("turn"), F.length(text).cast("long").alias("chars"))
    # By depth, so that a round's filter skips the files and row groups of all others.
    keyed.repartitionByRange("depth", "conv").sortWithinPartitions("depth", "conv").write.parquet(f"{folder}/turns")
    turns = spark.read.schema(_SCHEMA).parquet(f"{folder}/turns")
    lengths = cut(lengths.select(F.col("conv").cast("long").alias("conv"), F.col("length").cast("long").alias("length")))
    root = cut(lengths.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).where("n > 0"))

    top = root.first()  # one row at most
    members = lengths.select("conv", "length", F.lit(top and top["conv"]).cast("long").alias("node")).where(F.lit(bool(top) and top["n"] > 1))
    single = root.where("n = 1").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("chars"))
    levels, singles, ends = [root.where("n > 1").select("conv", F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("chars"))], [single], []
    while True:
        depth = len(levels)
        ends.append(members.where(F.col("length") == depth - 1).select(F.col("node").alias("conv"), F.lit(depth - 1).cast("long").alias("depth"), F.col("conv").alias("id")))
        active = members.where(F.col("length") >= depth)
        step = active.join(turns.where(F.col("depth") == depth).select("conv", "turn", "chars"), "conv")
        split = cut(step.groupBy("node", "turn").agg(F.min("conv").alias("class"), F.count("*").alias("n"), F.min("chars").alias("chars")))
        if split.isEmpty():
            break
        classes = split.where("n > 1")
        levels.append(classes.select(F.col("class").alias("conv"), F.col("node").alias("parent"), "n", "chars"))
        singles.append(split.where("n = 1").select(F.col("class").alias("conv"), F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), "chars"))
        members = cut(step.join(classes.select("node", "turn", "class"), ["node", "turn"]).select("conv", "length", F.col("class").alias("node")))

    below = None
    folded = []
    for depth in reversed(range(len(levels))):
        alone = [singles[depth + 1].groupBy("parent").agg(F.count("*").alias("children"), F.count("*").alias("leaves"), F.lit(0).cast("long").alias("saved"))] if depth + 1 < len(singles) else []
        parts = alone + ([below.groupBy("parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))] if below is not None else [])
        level = levels[depth]
        if parts:
            under = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            under = under.groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved"))).withColumnRenamed("parent", "conv")
            level = level.join(under, "conv", "left")
        else:
            level = level.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        below = cut(level.select(
            "conv", F.lit(depth).cast("long").alias("depth"), "parent", "n", F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        ))
        folded.append(below)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    shared = union(folded).join(_digests(union(ends)), ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )
    retired = union(singles).select("conv", "depth", "parent")
    tails = retired.withColumnRenamed("depth", "since").join(turns.select("conv", "depth"), "conv").where("depth > since").select("conv", "depth", F.col("conv").alias("parent"))
    last = F.col("depth") == F.col("length")
    chains = retired.unionByName(tails).join(lengths, "conv").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NONE)).alias("ends_sha256"),
    )
    return shared.unionByName(chains)
