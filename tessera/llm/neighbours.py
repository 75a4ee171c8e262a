"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one class. A first neighbour graph comes from sorted random-hyperplane
hashes; then every class compares its neighbours and reverse neighbours with each other and each takes
the best into its list. Lists that hold links only are saturated and get twice the length. Links that the
graph proposes are checked in double precision, and an audit compares every 50th vector with all rows of
its label: links it finds between different components are added, and while it finds any, lists are
enlarged and refined again. Links are counted within components, tile against tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, cut


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def vector_classes(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Checkpointed rows (id, key, copies, unit, half, v): the distinct usable vectors of each label, key the label and the vector's size."""
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(usable)
    distinct = rows.groupBy("label", "v").agg(F.min("vec").alias("id"), F.count("*").alias("copies"))
    distinct = distinct.select("id", F.concat_ws(":", F.size("v").cast("string"), "label").alias("key"), "copies", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            for x in batch.column(3).to_pylist():
                u = np.array(x)
                u = u / np.abs(u).max()
                units.append(u / np.sqrt(u @ u))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([u.tobytes() for u in units], pa.binary()), pa.array([u.astype(np.float16).tobytes() for u in units], pa.binary())], [*batch.schema.names, "unit", "half"])

    return cut(distinct.mapInArrow(run, "id long, key string, copies long, v array<double>, unit binary, half binary"))


def _best(row: np.ndarray, src: np.ndarray, dst: np.ndarray, est: np.ndarray, keep: np.ndarray | int) -> np.ndarray:
    """Positions of the best `keep` distinct dst of each row, none of them src."""
    order = np.lexsort((dst, -est, row))
    r, d = row[order], dst[order]
    by_dst = np.lexsort((np.arange(len(r)), d, r))
    first = np.ones(len(r), bool)
    first[by_dst[1:]] = (r[by_dst][1:] != r[by_dst][:-1]) | (d[by_dst][1:] != d[by_dst][:-1])
    order = order[first & (d != src[order])]
    r = row[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(r)), bool), r[1:] != r[:-1])))
    place = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    return order[place < (keep[r] if isinstance(keep, np.ndarray) else keep)]


def _offers(src: np.ndarray, a: np.ndarray, b: np.ndarray, est: np.ndarray, keep: int) -> pa.RecordBatch:
    """For each row a of src its best `keep` of the rows b."""
    at = _best(a, src[a], src[b], est, keep)
    rows, sizes = np.unique(a[at], return_counts=True)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(src[rows]), pa.ListArray.from_arrays(offsets, pa.array(src[b[at]])), pa.ListArray.from_arrays(offsets, pa.array(est[at], pa.float32()))], ["id", "dst", "est"])


_OFFER = "id long, dst array<long>, est array<float>"


def first_offers(classes: DataFrame, tables: int = 16, near: int = 8, keep: int = 3, group: int = 1024, seed: int = 1) -> DataFrame:
    """Offers from sorted hashes: rows of a label with a common hash prefix lie in one group, split at random when it is large; each compares with its nearest `near` in hash order on either side."""
    sizes = classes.groupBy("key").agg(F.count("*").alias("of_key"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                by_size: dict[int, list[int]] = {}
                halves = part.column(2).to_pylist()
                for k, h in enumerate(halves):
                    by_size.setdefault(len(h) // 2, []).append(k)
                out = [[] for _ in range(len(halves))]
                for size, rows in by_size.items():
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).standard_normal((size, tables * 24)).astype(np.float32)
                    x = np.frombuffer(b"".join(halves[k] for k in rows), np.float16).reshape(-1, size).astype(np.float32)
                    bits = (x @ planes[size] > 0).reshape(len(rows), tables, 24)
                    code = bits @ (1 << np.arange(23, -1, -1))
                    for k, c in zip(rows, code.tolist(), strict=True):
                        out[k] = c
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(out, pa.list_(pa.int32()))], ["id", "key", "half", "codes"])

    coded = classes.select("id", "key", "half").mapInArrow(hashed, "id long, key string, half binary, codes array<int>").join(sizes, "key")
    rows = coded.select("id", "key", "half", "of_key", F.posexplode("codes").alias("t", "code"))
    bits = F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.col("of_key") / group)))).cast("int")
    rows = rows.withColumn("prefix", F.call_function("shiftright", F.col("code"), F.lit(24) - bits)).drop("of_key")
    counts = rows.groupBy("key", "t", "prefix").agg(F.ceil(F.count("*") / (4 * group)).cast("int").alias("salts"))
    rows = rows.join(counts, ["key", "t", "prefix"]).withColumn("salt", F.pmod(F.xxhash64("id", "t"), "salts"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("code", "ascending"), ("id", "ascending")])
        src, x = table.column("id").to_numpy(), _matrix(table.column("half"), np.float16).astype(np.float32)
        a, b, est = [], [], []
        for step in range(1, min(near, len(src) - 1) + 1):
            s, i = (x[:-step] * x[step:]).sum(1), np.arange(len(src) - step)
            a += [i, i + step]
            b += [i + step, i]
            est += [s, s]
        if not a:
            return pa.table({"id": pa.array([], pa.int64()), "dst": pa.array([], pa.list_(pa.int64())), "est": pa.array([], pa.list_(pa.float32()))})
        return pa.Table.from_batches([_offers(src, np.concatenate(a), np.concatenate(b), np.concatenate(est), keep)])

    return rows.select("key", "t", "prefix", "salt", "id", "code", "half").groupBy("key", "t", "prefix", "salt").applyInArrow(compare, _OFFER)


def merged(offers: DataFrame, sizes: DataFrame | None, length: int, threshold: float) -> DataFrame:
    """Checkpointed lists of the best offers; n is a list's length, doubled where all it held were links. A hub that many lists name is sorted, never gathered whole."""
    each = offers.select("id", F.explode(F.arrays_zip("dst", "est")).alias("x")).where("x.dst <> id").groupBy("id", F.col("x.dst").alias("dst")).agg(F.max("x.est").alias("est"))
    each = each.join(sizes, "id", "left") if sizes is not None else each.withColumn("n", F.lit(None).cast("int"))
    each = each.withColumn("n", F.coalesce("n", F.lit(length))).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("est"), "dst")))
    best = each.where("place <= n").groupBy("id").agg(F.max("n").alias("n"), F.collect_list(F.struct("dst", "est")).alias("x"), F.min("est").alias("least"))
    n = F.when((F.col("least") >= threshold) & (F.size("x") >= F.col("n")), F.col("n") * 2).otherwise(F.col("n"))
    return cut(best.select("id", n.cast("int").alias("n"), F.col("x.dst").alias("dst"), F.col("x.est").alias("est")))


def neighbour_offers(lists: DataFrame, classes: DataFrame, keep: int = 3, together: int = 128) -> DataFrame:
    """Neighbours of neighbours: the class, its neighbours and its reverse neighbours are compared with each other; a class with very many is dealt into groups."""
    edges = lists.select("id", F.explode("dst").alias("dst"))
    pairs = edges.select(F.col("id").alias("b"), F.col("dst").alias("m")).union(edges.select(F.col("dst").alias("b"), F.col("id").alias("m"))).distinct()
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / together).cast("int").alias("groups"))
    pairs = pairs.join(groups, "b").withColumn("g", F.pmod(F.xxhash64("b", "m"), "groups")).select("b", "g", "m")
    members = pairs.join(classes.select(F.col("id").alias("m"), "half"), "m")
    joined = members.groupBy("b", "g").agg(F.collect_list(F.struct("m", "half")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ids, halves, ends = lists.flatten().field(0).to_numpy(), lists.flatten().field(1), np.cumsum(lists.value_lengths().to_numpy())
            begin = 0
            out: list[list[np.ndarray]] = [[], [], [], []]
            base = 0
            for end in ends.tolist():
                x = _matrix(halves[begin:end], np.float16).astype(np.float32)
                near = x @ x.T
                np.fill_diagonal(near, -2)
                k = min(keep, len(x) - 1)
                if k > 0:
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    out[0].append(np.repeat(np.arange(len(x)), k) + base)
                    out[1].append(top.ravel() + base)
                    out[2].append(np.take_along_axis(near, top, 1).ravel())
                out[3].append(ids[begin:end])
                base += end - begin
                begin = end
            if out[0]:
                yield _offers(np.concatenate(out[3]), np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2]), keep)

    return joined.select("x").mapInArrow(run, _OFFER)


def checked(lists: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Checkpointed links (a, b) among listed neighbours, each verified in double precision."""
    x = lists.select("id", F.explode(F.arrays_zip("dst", "est")).alias("x")).where(F.col("x.est") >= threshold - 0.01)
    pairs = x.select(F.least("id", "x.dst").alias("a"), F.greatest("id", "x.dst").alias("b")).distinct()
    unit = lambda name, own: classes.select(F.col("id").alias(name), F.col("unit").alias(own))
    both = pairs.join(unit("a", "ua"), "a").join(unit("b", "ub"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = np.array([np.frombuffer(p) @ np.frombuffer(q) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(cos >= threshold))

    return cut(both.select("a", "b", "ua", "ub").mapInArrow(run, "a long, b long"))


def labelled_components(links: DataFrame, classes: DataFrame) -> DataFrame:
    return cut(classes.join(components(links), "id", "left").select("id", "key", "copies", "unit", F.coalesce("component", "id").alias("component")))


def audit(members: DataFrame, threshold: float, every: int = 50, least: int = 64, rows_a_block: int = 4096, queries_a_block: int = 4096) -> DataFrame:
    """Checkpointed (query, links, found, other): audited classes against all rows of their label in blocks; a row for each component that a link leads to, other one row of it. Found links are those inside the query's component.

    Audited are, by the hash of their ids, one class in `every`, in small labels about `least` of them, and in each label one at least.
    """
    own = F.xxhash64("id")
    facts = members.groupBy("key").agg(F.min_by("id", own).alias("first"), F.greatest(F.lit(1 / every), least / F.count("*")).alias("share"))
    marked = members.join(facts, "key").withColumn("audited", (F.pmod(own, F.lit(1 << 20)) < F.col("share") * (1 << 20)) | (F.col("id") == F.col("first"))).drop("first", "share")
    blocks = marked.groupBy("key").agg(F.ceil(F.count("*") / rows_a_block).cast("int").alias("blocks"), F.ceil(F.count(F.when(F.col("audited"), 1)) / queries_a_block).cast("int").alias("asks"))
    rows = members.join(blocks, "key").withColumn("block", F.pmod(own, "blocks").cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    asked = marked.where("audited").join(blocks, "key").withColumn("ask", F.pmod(F.xxhash64("id", F.lit(1)), "asks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["key", "block", "ask", "id", "component", "unit"]

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and r.num_rows:
            asking, answering = _matrix(q.column("q_unit"), np.float64), _matrix(r.column("unit"), np.float64)
            ids, own = r.column("id").to_numpy(), r.column("component").to_numpy()
            for k, (query, component) in enumerate(zip(q.column("q_id").to_pylist(), q.column("q_component").to_pylist(), strict=True)):
                if k % 256 == 0:
                    near = asking[k : k + 256] @ answering.T >= threshold
                at = np.flatnonzero(near[k % 256] & (ids != query))
                for c in np.unique(own[at]).tolist():
                    there = at[own[at] == c]
                    out.append((query, len(there), len(there) if c == component else 0, int(ids[there].min())))
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("query", "links", "found", "other"))})

    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in names])
    found = asked.groupBy("q_key", "q_block", "q_ask").cogroup(rows.select(*names).groupBy("key", "block", "ask")).applyInArrow(compare, "query long, links long, found long, other long")
    return cut(found)


def link_counts(members: DataFrame, threshold: float, tile: int = 8192, least_tile: int = 256, rows_a_bucket: int = 4096) -> DataFrame:
    """(id, n): for each class in a component of several, the vectors of other classes linked with it.

    Components of at most least_tile rows share groups, as many as the rows need. Larger ones are compared
    tile against tile: four tiles at first, then tiles of `tile` rows, so a row of a component of n rows
    moves n / 8,192 times, four at least.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    rows = members.join(sizes, "component")
    buckets = max(1, -(-members.count() // rows_a_bucket))
    tiles = F.when(F.col("size") <= least_tile, 1).otherwise(F.greatest(F.least(F.lit(4), F.ceil(F.col("size") / least_tile)), F.ceil(F.col("size") / tile))).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = F.when(F.col("tiles") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets)))
    pairs = rows.select((F.col("tiles") > 1).alias("large"), spread.alias("bucket"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "component", "id", "copies", "unit")

    def linked(x: np.ndarray, y: np.ndarray, copies: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[at : at + 512] @ y.T >= threshold) @ copies for at in range(0, len(x), 512)] or [np.zeros(0, np.int64)])

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("component", "ascending"), ("tile", "ascending")])
        ids, copies, tiles, own = (table.column(c).to_numpy() for c in ("id", "copies", "tile", "component"))
        units = table.column("unit").to_pylist()
        out = np.zeros(len(ids), np.int64)
        edges = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            x = np.frombuffer(b"".join(units[s:e])).reshape(e - s, -1)
            second = int(np.searchsorted(tiles[s:e], tiles[s], "right"))
            if second < e - s:
                out[s:e] = np.concatenate((linked(x[:second], x[second:], copies[s + second : e]), linked(x[second:], x[:second], copies[s : s + second])))
            else:
                itself = np.concatenate([(x[at : at + 512] * x[at : at + 512]).sum(1) for at in range(0, len(x), 512)]) >= threshold
                out[s:e] = linked(x, x, copies[s:e]) - itself * copies[s:e]
        return pa.table({"id": ids, "n": out})

    return pairs.groupBy("large", "bucket", "i", "j").applyInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, length: int = 12, rounds: int = 2, most_rounds: int = 6, least_recall: float = 0.9, with_recall: bool = False, report: Callable[[dict], None] | None = None) -> DataFrame:
    """One row for each input row: id_col, n_links, component_id, kept[, audit_recall].

    Vectors are compared within a label (and a size) only; those that are null, empty or zero or hold
    null or non-finite components, and those without a label or an id, link with nothing. Rows with equal
    vectors are links of each other; rows with equal ids are vectors of their own; empty tables give no
    rows; other columns aren't read. A component of n rows costs n squared, in tiles. Rounds go on while
    the audit finds links between components, most_rounds at most; if it then had less than least_recall
    of the audited links, RuntimeError is raised. audit_recall is the last audit's figure, null if no audited
    vector has a link; report gets those of each: links, found, recall, and by_vector, the mean over vectors with links.
    """
    classes = vector_classes(table, id_col, vec_col, label_col)
    lists = merged(first_offers(classes), None, length, threshold)
    done, links = 0, None
    while True:
        for _ in range(rounds if links is None else 1):
            offers = neighbour_offers(lists, classes).unionByName(lists.select("id", "dst", "est"))
            lists = merged(offers, lists.select("id", "n"), length, threshold)
            done += 1
        own = checked(lists, classes, threshold)
        links = own if links is None else links.union(own)
        members = labelled_components(links, classes)
        found = audit(members, threshold)
        of_query = found.groupBy("query").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
        facts = of_query.agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0)), F.avg(F.col("found") / F.col("links"))).first()
        recall = facts[1] / facts[0] if facts[0] else None
        if report:
            report({"links": facts[0], "found": facts[1], "recall": recall, "by_vector": facts[2]})
        if facts[0] == facts[1]:
            break
        links = links.union(found.where("found = 0").select(F.col("query").alias("a"), F.col("other").alias("b")))
        if done >= most_rounds:
            if recall < least_recall:
                raise RuntimeError(f"after {done} rounds the graph has {recall:.3f} of the audited links")
            members = labelled_components(links, classes)
            break
        lists = cut(lists.withColumn("n", F.col("n") * 2))
    counted = members.join(link_counts(members, threshold), "id", "left").select(F.col("id").alias("class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component"))
    counted = counted.join(classes.select(F.col("id").alias("class"), "key", "v"), "class")
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.concat_ws(":", F.size(v).cast("string"), F.col(label_col).cast("string")).alias("key"), v.alias("v"), F.col(label_col).isNotNull().alias("usable"))
    joined = rows.join(counted, (rows.key == counted.key) & (rows.v == counted.v) & rows.usable & rows.id.isNotNull(), "left")
    component = F.coalesce(F.col("component"), rows.id)
    extra = [F.lit(recall).cast("double").alias("audit_recall")] if with_recall else []
    return joined.select(rows.id.alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (rows.id == component).alias("kept"), *extra)
