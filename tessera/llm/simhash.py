"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Fingerprints are compared tile against tile with numpy exclusive-or and bit counts. A tile holds
fingerprints of one population count and of a range of low-half population counts; as the Hamming
distance is at least the sum of the differences of the two halves' counts, tile pairs whose counts
differ beyond the radius are never formed. Equal fingerprints are collapsed first; a tile pair
gives a spanning forest of its links instead of all pairs, so a hot group stays linear in its size
per tile pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bound_batches, components, cut


def text_fingerprint(text: bytes | None, shingle_words: int = 4, seed: int = 42) -> int:
    """SimHash of one UTF-8 text; 0 for null or no words; shorter texts are one shingle."""
    import xxhash

    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle_words] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)], np.uint64)
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        part = hashes[at : at + 16384]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


_LOWER = bytes(range(256)).lower()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """Rows (id, fp): one for each input row, fp the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t, shingle_words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, chunk: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Positions (into a followed by b) of the links of a spanning forest of all pairs of a tile pair within radius; b None: within a."""
    right, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(a) + (0 if b is None else len(b)))
    for at in range(0, len(a), chunk):
        near = np.bitwise_count(a[at : at + chunk, None] ^ right[None, :]) <= radius
        if b is None:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        for k in np.flatnonzero(near.any(axis=1)):
            found = label[np.flatnonzero(near[k]) + shift]
            own = label[at + k]
            if (found != own).any():
                roots = np.unique(np.append(found, own))
                label[np.isin(label, roots)] = roots[0]
    linked = np.flatnonzero(label != np.arange(len(label)))
    return label[linked], linked


def tile_plan(cells: list[tuple[int, int, int]], tile_rows: int, radius: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Merges (population count, low-half count, rows) cells to units and pairs units within the radius.

    Units: (unit, population count, first low-half count, number of tiles). Pairs: (unit, other unit >= it, tiles of the other). At most 1,089 cells exist.
    """
    units: list[list[int]] = []
    for count, low, rows in sorted(cells):
        if units and units[-1][0] == count and units[-1][3] + rows <= tile_rows:
            units[-1][2], units[-1][3] = low, units[-1][3] + rows
        else:
            units.append([count, low, low, rows])
    tiles = [-(-u[3] // tile_rows) for u in units]
    gap = lambda x, y: max(0, y[0] - x[1], x[0] - y[1])
    pairs = []
    for i, u in enumerate(units):
        for j in range(i, len(units)):
            w = units[j]
            if gap((u[1], u[2]), (w[1], w[2])) + gap((u[0] - u[2], u[0] - u[1]), (w[0] - w[2], w[0] - w[1])) <= radius and abs(u[0] - w[0]) <= radius:
                pairs.append((i, j, tiles[j]))
    return [(i, u[0], u[1], tiles[i]) for i, u in enumerate(units)], pairs


def fingerprint_links(fps: DataFrame, radius: int = 4, tile_rows: int = 16384) -> DataFrame:
    """Edges (a, b) that connect all ids whose fingerprints are within radius through others: a spanning forest for each tile pair and stars for equal fingerprints."""
    spark = fps.sparkSession
    distinct = cut(fps.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("id")))
    cell = [F.bit_count("fp").alias("pc"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")]
    histogram = distinct.groupBy(*cell).count().collect()  # 1,089 rows at most
    units, pairs = tile_plan([(r["pc"], r["low"], r["count"]) for r in histogram], tile_rows, radius)
    same = fps.join(distinct.withColumnRenamed("id", "a"), "fp").where("a < id").select("a", F.col("id").alias("b"))
    if not units:
        return same
    unit_of: dict[int, int] = {}
    for (i, count, low, _), nxt in zip(units, [*units[1:], (0, -1, 0, 0)], strict=True):
        for x in range(low, nxt[2] if nxt[1] == count else 33):
            unit_of[count * 64 + x] = i
        if i == 0 or units[i - 1][1] != count:
            for x in range(low):
                unit_of[count * 64 + x] = i
    unit_map = F.array(*[F.lit(unit_of.get(k)).cast("int") for k in range(65 * 64)])
    n_tiles = F.array(*[F.lit(u[3]) for u in units])
    to_tile = distinct.select("fp", "id", F.element_at(unit_map, F.bit_count("fp") * 64 + F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))) + 1).alias("unit"))
    to_tile = to_tile.withColumn("sub", F.pmod(F.xxhash64("fp"), F.element_at(n_tiles, F.col("unit") + 1)).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        order = np.argsort(fp)
        return pa.table({"unit": pa.array([key[0].as_py()], pa.int32()), "sub": pa.array([key[1].as_py()], pa.int32()), "fps": pa.array([fp[order].tobytes()], pa.binary()), "ids": pa.array([table.column("id").to_numpy()[order].tobytes()], pa.binary())})

    tiles = cut(to_tile.groupBy("unit", "sub").applyInArrow(pack, "unit int, sub int, fps binary, ids binary"))
    partners = spark.createDataFrame(pairs, T.StructType([T.StructField(x, T.IntegerType()) for x in ("unit", "other", "subs")]))  # bounded as the cells are
    partner_tiles = partners.select("unit", "other", "subs")
    left = tiles.join(F.broadcast(partner_tiles), "unit").select("*", F.explode(F.sequence(F.when(F.col("unit") == F.col("other"), F.col("sub")).otherwise(F.lit(0)), F.col("subs") - 1)).alias("other_sub"))
    left = left.select(F.struct("unit", "sub", "other", "other_sub").alias("pair"), F.lit(0).alias("side"), "fps", "ids")
    back = partners.join(spark.createDataFrame([(u[0], u[3]) for u in units], "unit int, n int"), "unit").select(F.col("other").alias("unit"), F.col("unit").alias("first"), "n")
    right = tiles.join(F.broadcast(back), "unit").select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("unit") == F.col("first"), F.col("sub")).otherwise(F.col("n") - 1))).alias("first_sub"))
    right = right.where(~((F.col("first") == F.col("unit")) & (F.col("first_sub") == F.col("sub"))))
    right = right.select(F.struct(F.col("first").alias("unit"), F.col("first_sub").alias("sub"), F.col("unit").alias("other"), F.col("sub").alias("other_sub")).alias("pair"), F.lit(1).alias("side"), "fps", "ids")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["side", "fps", "ids"]).to_pylist(), key=lambda r: r["side"])
        fp = [np.frombuffer(r["fps"], np.uint64) for r in rows]
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        x, y = forest(fp[0], fp[1] if len(fp) > 1 else None, radius)
        return pa.table({"a": ids[x], "b": ids[y]})

    n_pairs = sum(units[i][3] * units[j][3] for i, j, _ in pairs)
    tasks = min(n_pairs, max(spark.sparkContext.defaultParallelism, n_pairs * tile_rows**2 // 10**10))  # by comparisons, some seconds each, not by bytes
    near = left.unionByName(right).repartition(tasks, "pair").groupBy("pair").applyInArrow(compare, "a long, b long")
    return near.union(same)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle_words: int = 4, tile_rows: int = 16384) -> DataFrame:
    """One row for each input row: id_col, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Null and empty texts have fingerprint zero and link like any other. Rows with the same id are
    one vertex. A null id keeps its fingerprint; its component_id is null. Extra columns are not read.
    """
    bound_batches(docs.sparkSession)
    fps = cut(fingerprints(docs, id_col, text_col, shingle_words))
    groups = components(fingerprint_links(fps, radius, tile_rows))
    out = fps.join(groups, "id", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "id").alias("component_id"))


def shingle_set(text: bytes | None, shingle_words: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word shingles; none for null or no words; shorter texts are one shingle."""
    import xxhash

    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.array([], np.uint64)
    digest, last = xxhash.xxh64_intdigest, max(1, len(words) - shingle_words + 1)
    return np.unique(np.array([digest(b" ".join(words[k : k + shingle_words]), seed) for k in range(last)], np.uint64))


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, least: float = 0.8, bands: int = 20, band_rows: int = 5) -> DataFrame:
    """Edges (a, b) of ids whose texts' shingle sets have a Jaccard similarity of `least` or more.

    MinHash bands propose the members of a bucket with its smallest one, exact similarity decides: no
    link is wrong, and a pair of similarity 0.8 is proposed with a chance of 0.9996. Equal texts are
    one vertex here; equal fingerprints link them.
    """
    def arrays(lists: list[np.ndarray]) -> pa.ListArray:
        ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32())
        values = pa.array((np.concatenate(lists) if lists else np.array([], np.uint64)).view(np.int64))
        return pa.ListArray.from_arrays(ends, values)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        factors = np.random.default_rng(7).integers(0, 2**63, bands * band_rows, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            lists = []
            for t in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_set(t, shingle_words)
                if not len(hashes):
                    lists.append(hashes)
                    continue
                least_of = np.min([(factors[:, None] * hashes[None, at : at + 4096]).min(axis=1) for at in range(0, len(hashes), 4096)], axis=0)
                lists.append(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in least_of.reshape(bands, band_rows)], np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), arrays(lists)], ["id", "key", "buckets"])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [shingle_set(t, shingle_words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays(lists)], ["key", "shingles"])

    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("t"))
    signed = texts.mapInArrow(sign, "id long, key long, buckets array<long>")
    signed = cut(signed.groupBy("key").agg(F.min("id").alias("id"), F.first("buckets").alias("buckets")))
    each = signed.select(F.struct("id", "key").alias("x"), F.posexplode("buckets").alias("band", "bucket"))
    hubs = each.groupBy("band", "bucket").agg(F.min("x").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = cut(each.join(hubs, ["band", "bucket"]).where("x.key <> hub.key and x.id <> hub.id").select(F.col("hub.id").alias("a"), F.col("hub.key").alias("a_key"), F.col("x.id").alias("b"), F.col("x.key").alias("b_key")).distinct())
    wanted = pairs.select(F.explode(F.array("a_key", "b_key")).alias("key")).distinct()
    sets = cut(texts.select("key", "t").join(wanted, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(shingle, "key long, shingles array<long>"))
    both = pairs.join(sets.select(F.col("key").alias("a_key"), F.col("shingles").alias("s")), "a_key").join(sets.select(F.col("key").alias("b_key"), F.col("shingles").alias("u")), "b_key")
    shared = F.size(F.array_intersect("s", "u"))
    return both.where(shared >= least * (F.size("s") + F.size("u") - shared)).select("a", "b")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """docs without the rows whose id is not the smallest of its group; of rows with the same id all stay or go together, and rows without an id stay.

    Links are those of fingerprints within radius and those of shingle sets with a similarity of `least` or more.
    """
    bound_batches(docs.sparkSession)
    links = fingerprint_links(cut(fingerprints(docs, id_col, text_col)), radius).union(similar_links(docs, id_col, text_col, shingle_words, least))
    gone = components(links).where("id <> component").select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col))
    return docs.join(gone, id_col, "left_anti")
