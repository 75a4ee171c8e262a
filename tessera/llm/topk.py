"""Exact top-k by integer inner product with the threshold algorithm over sorted per-dimension lists.

Rows are dealt into blocks of bounded size; a block holds, for each dimension, its rows in order of that
component. For a query, lists are read from the top where the query's component is positive and from the
bottom where it is negative, some entries of all lists at a time. Rows seen first are scored whole; the
sum of the query's components times the components at the depth reached bounds every row not yet seen.
Reading stops when that bound cannot beat the k-th score, nor tie with it. All queries meet one block
first; the k-th score they find there is where they start in every other block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

_MOST = 1 << 62
_NONE = -(1 << 63)


def dense(column: pa.Array, width: int, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) of vectors without nulls or non-finite numbers, padded with zeros to width; raises if a component reaches 62 bits."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= _MOST:
        raise OverflowError("a component times the scale has more than 62 bits")
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64)
    return out


def exact_form(matrix: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the fastest numbers in which all sums of products are exact: doubles, 64-bit integers or Python's."""
    most = int(np.abs(matrix).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, matrix.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < _MOST else object
    return matrix.astype(kind), queries.astype(kind)


def threshold_top(matrix: np.ndarray, order: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, step: int = 32, floor: int = _NONE) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the best k rows of a block but the query's own, ties to smaller ids, and how many rows were scored. Rows under floor don't count.

    order[d]: rows by rising component d. The depth grows by half each time.
    """
    up, down, n = np.flatnonzero(query > 0), np.flatnonzero(query < 0), len(matrix)
    seen = ids == own
    left = n - int(seen.sum())
    scored, depth = 0, 0
    best, scores = np.zeros(0, np.int64), np.zeros(0, matrix.dtype)
    while left:
        end = min(n, depth + step)
        fresh = np.zeros(n, bool)
        fresh[order[up, n - end : n - depth]] = True
        fresh[order[down, depth:end]] = True
        if not len(up) and not len(down):
            fresh[:] = True
        fresh = np.flatnonzero(fresh & ~seen)
        seen[fresh] = True
        left -= len(fresh)
        scored += len(fresh)
        new = matrix[fresh] @ query
        least = max(floor, scores[-1]) if len(best) == k else floor
        good = new >= least
        if len(best) < k and good.sum() > 8 * k:
            good = new >= np.partition(new, len(new) - k)[len(new) - k]
        best, scores = np.concatenate((best, ids[fresh][good])), np.concatenate((scores, new[good]))
        keep = np.lexsort((best, -scores))[:k]
        best, scores = best[keep], scores[keep]
        bound = matrix[order[up, n - end], up] @ query[up] + matrix[order[down, end - 1], down] @ query[down]
        if (len(best) == k and scores[-1] > bound) or floor > bound:
            break
        depth, step = end, step + step // 2
    return best, scores, scored


def top_products(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, rows_a_block: int | None = None, queries_a_block: int = 4096, with_scored: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score[, scored]: for each row whose id is divisible by every, its k best other rows.

    Vectors that are null or hold null or non-finite components and rows without an id take no part, so
    an id's valid vector counts beside invalid ones; shorter vectors count as padded with zeros; rows with
    equal ids count once, with the smallest valid vector; empty tables give no rows; other columns aren't
    read. Scores are exact: where sums may exceed 62 bits they are made of Python's integers, and a score
    among the k best that isn't a long, or a component times 1,024 of 62 bits or more, raises
    OverflowError. A block holds a share of the rows for each core, between 1,024 and 32,768, and meets
    queries_a_block queries at a time, so a row moves once for so many queries. scored counts the rows
    of all blocks that a query was multiplied with.
    """
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = cut(rows.where(usable).groupBy("id").agg(F.min("v").alias("v")))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.sum((F.col("id") % every == 0).cast("long")).alias("q")).first()
    cores = table.sparkSession.sparkContext.defaultParallelism
    rows_a_block = rows_a_block or min(32768, max(1024, -(-facts["n"] // (2 * cores))))
    n_blocks, q_blocks, width = max(1, -(-facts["n"] // rows_a_block)), max(1, -(-(facts["q"] or 0) // queries_a_block)), max(1, facts["size"] or 1)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ids, matrix = b.column("id").to_numpy().astype(np.int64), dense(b.column("v"), width)
            order = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").astype(np.int32).T)
            matrix, questions = exact_form(matrix, dense(a.column("q"), width))
            for query, floor, q in zip(a.column("query").to_pylist(), a.column("floor").to_pylist(), questions, strict=True):
                best, scores, scored = threshold_top(matrix, order, ids, q, query, k, floor=_NONE if floor is None else floor)
                scores = [int(x) for x in scores]
                if scores and max(map(abs, scores)) >= -_NONE:
                    raise OverflowError(f"a score of query {query} has more than 63 bits")
                out += [(query, x, y, 0) for x, y in zip(best.tolist(), scores, strict=True)] + [(query, None, None, scored)] * with_scored
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score", "scored"))})

    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("v").alias("q"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("queries"))

    def against(asked: DataFrame, first: int, last: int) -> DataFrame:
        pairs = q_blocks * (last - first + 1)
        tasks = min(2 * pairs, cores + pairs // 4)  # by count: searching takes time, not bytes
        left = asked.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last))))
        right = blocks.where(F.col("block").between(first, last)).withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        left = left.select(F.col("queries").alias("at"), F.col("block").alias("against"), "query", "q", "floor").repartition(tasks, "at", "against")
        right = right.select("queries", "block", "id", "v").repartition(tasks, "queries", "block")
        return left.groupBy("at", "against").cogroup(right.groupBy("queries", "block")).applyInArrow(search, "query_id long, vec_id long, score long, scored long")

    found = against(asked.withColumn("floor", F.lit(None).cast("long")), 0, 0)
    if n_blocks > 1:
        found = cut(found)
        floors = found.where("vec_id is not null").groupBy(F.col("query_id").alias("query")).agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).drop("n")
        found = found.union(against(asked.join(floors, "query", "left"), 1, n_blocks - 1))
    if with_scored:
        found = cut(found)
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    ranked = ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if not with_scored:
        return ranked
    return ranked.join(found.where("vec_id is null").groupBy("query_id").agg(F.sum("scored").alias("scored")), "query_id")
