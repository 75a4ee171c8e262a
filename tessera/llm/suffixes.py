"""Removal of long byte strings that occur more than once, from suffix arrays made by external induced sorting.

Equal windows of `least` bytes have the same smallest hash of the shorter strings within them. A document's
neighbouring windows with the same smallest hash form one stretch, and stretches meet by that hash: a shard
holds all windows that could be equal. Hashes that occur once have no equal windows, so their stretches
aren't sent. Stretches with the same bytes are counted before they move and sent once, or not at all if no
other stretch has their hash. Each shard's stretches
are one text whose suffix array and common prefixes say which windows start elsewhere, too.

A hash that very many stretches have (a common line in changing surroundings) is split by the place of that
hash in the window and by the bytes that all windows with this place share, which equal windows have alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut, free_shuffles, shared_dir
from tessera.llm.induced import Scratch, suffix_array

_U = np.uint64
_BYTE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEPS = np.random.default_rng(21).integers(1, 1 << 62, 64, dtype=np.uint64) * _U(2) + _U(1)
_PLACES = 32
_PIECE = 256 << 10


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stored(df: DataFrame, folder: str) -> DataFrame:
    """df written to a folder that all executors share and read again: later reads take only the columns they use."""
    df.write.option("compression", "zstd").parquet(folder)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pack_bytes(docs: DataFrame, id_col: str, text_col: str, size: int = 2 << 20) -> DataFrame:
    """Checkpointed rows (pack, ids, sizes, total, blob): whole texts of about size bytes together, a longer one alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 33
        ids, texts, total = [], [], 0

        def row() -> pa.RecordBatch:
            sizes = [len(t) for t in texts]
            data = [[number], [ids], [sizes], [total], [press.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()), strict=True)], ["pack", "ids", "sizes", "total", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids.append(doc)
                    texts.append(text or b"")
                    total += len(texts[-1])
                    if total >= size or len(ids) >= 65536:
                        yield row()
                        number, ids, texts, total = number + 1, [], [], 0
        if ids:
            yield row()

    return cut(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "pack long, ids array<long>, sizes array<long>, total long, blob binary"))


class Stretches:
    """The stretches of a pack: where they start in its bytes, how many windows each has, their smallest hash, and 2 where it occurs in them again."""

    def __init__(self, data: bytes, sizes: np.ndarray, least: int, split: frozenset[int] = frozenset(), only: np.ndarray | None = None) -> None:
        self.least, self.gram = least, 1 << max(0, (least // 3).bit_length() - 1)
        buffer = np.frombuffer(data, np.uint8)
        ends = np.cumsum(sizes)
        found = [self._piece(buffer, a, b, own, split, only) for a, b, own in self._pieces(ends - sizes, ends)]
        self.start, self.windows, self.key, self.times = (np.concatenate([np.zeros(0, t), *(f[k] for f in found)]) for k, t in enumerate((np.int64, np.int64, np.uint64, np.int64)))

    def _pieces(self, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Ranges of bytes with the ends of the documents in them; a long document in parts that start at fixed places of it."""
        long = ends - begins >= self.least
        begins, ends = begins[long], ends[long]
        k = 0
        while k < len(ends):
            if ends[k] - begins[k] > _PIECE:
                for a in range(int(begins[k]), int(ends[k]) - self.least + 1, _PIECE):
                    b = min(int(ends[k]), a + _PIECE + self.least - 1)
                    yield a, b, np.array([[a, b]])
                k += 1
                continue
            stop = k + 1
            while stop < len(ends) and ends[stop] - begins[k] <= _PIECE:
                stop += 1
            yield int(begins[k]), int(ends[stop - 1]), np.stack((begins[k:stop], ends[k:stop]), 1)
            k = stop

    def _piece(self, buffer: np.ndarray, begin: int, end: int, docs: np.ndarray, split: frozenset[int], only: np.ndarray | None) -> tuple[np.ndarray, ...]:
        h, size = _BYTE[buffer[begin:end]], 1
        while size < self.gram:
            h = h[:-size] * _STEPS[size.bit_length()] + h[size:]
            size *= 2
        grams = _mix(h)
        width, have, least = self.least - self.gram + 1, 1, grams
        while 2 * have <= width:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        firsts, lasts = docs[:, 0] - begin, docs[:, 1] - begin - self.least + 1
        inside = np.zeros(len(least) + 1, np.int8)
        np.add.at(inside, firsts, 1)
        np.add.at(inside, lasts, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        breaks = np.ones(len(least), bool)
        breaks[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        breaks[firsts] = True
        start = np.flatnonzero(breaks)
        windows = np.diff(np.append(start, len(least)))
        # Windows of one stretch are equal only if its hash occurs again: the window that begins with it doesn't end the stretch.
        again = grams[: len(least)] == least
        again[:-1] &= ~breaks[1:]
        again[-1] = False
        times = 1 + np.logical_or.reduceat(again, start).astype(np.int64)
        keep = inside[start] if only is None else inside[start] & np.isin(least[start], only)
        start, windows, times = start[keep], windows[keep], times[keep]
        pieces = -(-windows // 512)  # the same bytes over and over
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, windows, times = np.repeat(start, pieces) + 512 * nth, np.minimum(512, np.repeat(windows, pieces) - 512 * nth), np.repeat(times, pieces)
        key = least[start]
        if split:
            hot = np.isin(key, np.fromiter(split, np.uint64, len(split)))
            parts = [self._split(buffer, begin, grams, a, n, k) for a, n, k in zip(start[hot].tolist(), windows[hot].tolist(), key[hot], strict=True)]
            start, windows, key = (np.concatenate([x[~hot], *(p[j] for p in parts)]) for j, x in enumerate((start, windows, key)))
            times = np.ones(len(key), np.int64)
        return start + begin, windows, key, times

    def _split(self, buffer: np.ndarray, begin: int, grams: np.ndarray, start: int, windows: int, key: np.uint64) -> tuple[np.ndarray, ...]:
        at = np.arange(start, start + windows)
        places = np.flatnonzero(grams[start : start + windows + self.least - self.gram] == key) + start
        first = places[np.searchsorted(places, at)]
        group = (first - at) // _PLACES
        new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (group[1:] != group[:-1]))))
        low = first[new] - _PLACES * group[new]
        keys = [_hash(int(key).to_bytes(8, "little") + int(g).to_bytes(8, "little") + buffer[max(0, a) + begin : a + begin + self.least - _PLACES + 1].tobytes()) for a, g in zip(low.tolist(), group[new].tolist(), strict=True)]
        return at[new], np.diff(np.append(new, windows)), np.array(keys, np.uint64)


def _unpack(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def repeated_windows(contents: Iterator[tuple[bytes, bool]], least: int, in_memory: int = 32 << 20, most: int = 1 << 20, block: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
    """For each of a shard's contents that has any, its number and the places where a window starts that starts elsewhere, too.

    contents: the bytes, and whether they occur several times as a whole. They are streamed to scratch and sorted there.
    """
    with Scratch(in_memory) as scratch:
        parts, starts, whole, size = [], [0], [], 0
        for data, several in contents:
            part = np.empty(len(data) + 1, np.uint16)
            part[:-1] = np.frombuffer(data, np.uint8)
            part[:-1] += 2
            part[-1] = 1
            parts.append(part)
            size += len(part)
            starts.append(starts[-1] + len(part))
            whole.append(several)
            if size * 2 > in_memory // 4:
                parts, size = [*(p for p in parts if isinstance(p, np.memmap)), scratch.keep(np.concatenate([p for p in parts if not isinstance(p, np.memmap)]))], 0
        text = scratch.array(starts[-1] + 1, np.uint16)
        at = 0
        for part in parts:
            text[at : at + len(part)] = part
            at += len(part)
        del parts
        order, shares = suffix_array(text, scratch, most, block)
        flags = scratch.array(len(text), np.bool_)
        for a in range(0, len(order), block):
            alike = np.flatnonzero(shares[a : a + block] >= least) + a
            flags[order[alike]] = True
            flags[order[alike - 1]] = True
        for k, several in enumerate(whole):
            windows = starts[k + 1] - starts[k] - least
            places = np.arange(windows) if several else np.flatnonzero(flags[starts[k] : starts[k] + windows])
            if len(places):
                yield k, places


def _edges(places: np.ndarray) -> np.ndarray:
    """Rising places as ranges: begins and ends by turns."""
    breaks = np.flatnonzero(np.diff(places) > 1)
    return np.stack((places[np.concatenate(([0], breaks + 1))], places[np.concatenate((breaks, [len(places) - 1]))] + 1), 1).ravel()


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400, shard_bytes: int = 2 << 20, most_shards: int = 20_000, hot_stretches: int = 20_000, scratch: dict | None = None) -> DataFrame:
    """One row for each input row: id_col, n_bytes, n_removed, spans (start, stop) of what goes, kept (bytes).

    Each byte goes that a string of `least` bytes covers which also starts anywhere else, in the same or in
    another document; strings are judged on the input. Texts are taken as UTF-8, null as empty; null ids are
    kept, rows with equal ids are documents of their own and repeat each other; an empty table gives no rows;
    a very long text is a pack of its own, cut into pieces of windows; other columns aren't read. Stretches
    count as equal if 128 bits of two hashes are; windows are compared byte by byte.

    shard_bytes: text of a shard, about, more where there would be over most_shards; hot_stretches: from so many on a hash is split; scratch: sizes for repeated_windows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/strings-{uuid.uuid4().hex}"
    packs = pack_bytes(docs, id_col, text_col)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = Stretches(_unpack(batch.column(2)[k].as_py()), np.array(batch.column(1)[k].as_py(), np.int64), least)
                key, at = np.unique(found.key, return_inverse=True)
                n = np.bincount(at, weights=found.times, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), batch.column(0)[k].as_py(), np.int64)), pa.array(n)], ["key", "pack", "n"])

    own_keys = stored(packs.select("pack", "sizes", "blob").mapInArrow(keys, "key long, pack long, n long"), f"{folder}/keys")
    repeated = own_keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key", (F.col("n") > hot_stretches).alias("hot"))
    hits = own_keys.select("key", "pack").join(repeated, "key").groupBy("pack").agg(F.collect_list(F.struct("key", "hot")).alias("hits"))  # a pack's own

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, pack = _unpack(batch.column(2)[k].as_py()), batch.column(0)[k].as_py()
                hit = batch.column(3)[k].as_py()
                only = np.array([x["key"] for x in hit], np.int64).view(np.uint64)
                found = Stretches(data, np.array(batch.column(1)[k].as_py(), np.int64), least, frozenset(x["key"] % (1 << 64) for x in hit if x["hot"]), only)
                places: dict[tuple[int, int, int, int], list[int]] = {}
                for start, windows, key, times in zip(found.start.tolist(), found.windows.tolist(), found.key.tolist(), found.times.tolist(), strict=True):
                    places.setdefault((_signed(key), _signed(_hash(data[start : start + windows + least - 1])), windows, times), []).append(start)
                columns = [*([x[j] for x in places] for j in range(4)), [pack] * len(places), list(places.values())]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["key", "body", "windows", "times", "pack", "starts"])

    found = stored(packs.select("pack", "sizes", "blob").join(hits.hint("shuffle_hash"), "pack").mapInArrow(stretches, "key long, body long, windows int, times int, pack long, starts array<long>"), f"{folder}/found")
    _drop(spark, f"{folder}/keys")
    # One pack sends a body for all that have it. A hash that one body alone has, and once, can have no other equal windows than that body's copies.
    first = F.min(F.struct("pack", F.col("starts")[0].alias("start"))).alias("first")
    counted = stored(found.groupBy("key", "body", "windows").agg(first, F.sum(F.size("starts")).alias("n"), F.max("times").alias("times")), f"{folder}/counted")
    of_key = counted.groupBy("key").agg(F.count("*").alias("bodies"), F.max("times").alias("most"))
    bodies = stored(counted.join(of_key, "key").withColumn("alone", F.expr("bodies = 1 AND most = 1")).select("key", "body", "windows", "first", "n", "alone"), f"{folder}/bodies")
    total = bodies.where("not alone").agg(F.sum(F.col("windows") + least).cast("long")).first()[0] or 0
    shards = max(1, -(-total // max(shard_bytes, -(-total // most_shards))))
    body = F.struct("key", "body", "windows", (F.col("n") > 1).alias("several"), F.col("first.start").alias("start"))
    sent = bodies.where("not alone").groupBy(F.col("first.pack").alias("pack")).agg(F.collect_list(body).alias("bodies"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, rows = _unpack(batch.column(0)[k].as_py()), batch.column(1)[k].as_py()
                for at in range(0, len(rows), 8192):
                    part = rows[at : at + 8192]
                    columns = [[x["key"] % shards for x in part], [x["key"] for x in part], [x["body"] for x in part], [x["several"] for x in part], [data[x["start"] : x["start"] + x["windows"] + least - 1] for x in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["shard", "key", "body", "several", "content"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[np.ndarray] = []

        def rows() -> Iterator[tuple[bytes, bool]]:
            for batch in batches:
                names.append(np.stack((batch.column(1).to_numpy(), batch.column(2).to_numpy()), 1))
                yield from zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)

        ready: list[tuple[int, list[int]]] = []

        def out() -> pa.RecordBatch:
            every = names[0] if len(names) == 1 else np.concatenate(names)
            names[:] = [every]
            at = np.array([k for k, _ in ready])
            return pa.RecordBatch.from_arrays([pa.array(every[at, 0]), pa.array(every[at, 1]), pa.array([e for _, e in ready], pa.list_(pa.int32()))], ["key", "body", "edges"])

        for k, places in repeated_windows(rows(), least, **(scratch or {})):
            ready.append((k, _edges(places).tolist()))
            if len(ready) == 8192:
                yield out()
                ready = []
        if ready:
            yield out()

    pieces = packs.select("pack", "blob").join(sent.hint("shuffle_hash"), "pack").select("blob", "bodies").mapInArrow(contents, "shard int, key long, body long, several boolean, content binary")
    sorted_out = stored(pieces.repartitionById(shards, F.col("shard")).mapInArrow(sort, "key long, body long, edges array<int>"), f"{folder}/sorted")
    verdicts = sorted_out.unionByName(bodies.where("alone AND n > 1").select("key", "body", F.array(F.lit(0), "windows").alias("edges")))
    gone = found.select("key", "body", "pack", "starts").join(verdicts, ["key", "body"]).groupBy("pack").agg(F.collect_list(F.struct("starts", "edges")).alias("gone"))  # a pack's own

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, data = batch.column(0)[k].as_py(), np.array(batch.column(1)[k].as_py(), np.int64), _unpack(batch.column(2)[k].as_py())
                steps = np.zeros(len(data) + 1, np.int32)
                for x in batch.column(3)[k].as_py() or []:
                    edges = np.array(x["edges"], np.int64).reshape(-1, 2)
                    for start in x["starts"]:
                        np.add.at(steps, start + edges[:, 0], 1)
                        np.add.at(steps, start + edges[:, 1] + least - 1, -1)
                covered = np.cumsum(steps[:-1], dtype=np.int32) > 0
                ends = np.cumsum(sizes).tolist()
                for at in range(0, len(ids), 256):
                    rows = []
                    for doc, end, size in zip(ids[at : at + 256], ends[at : at + 256], sizes[at : at + 256].tolist(), strict=True):
                        own = covered[end - size : end]
                        turns = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))).tolist()
                        kept, last = [], 0
                        for a, b in zip(turns[::2], turns[1::2], strict=True):
                            kept.append(data[end - size + last : end - size + a])
                            last = b
                        kept.append(data[end - size + last : end])
                        rows.append((doc, size, sum(turns[1::2]) - sum(turns[::2]), [{"start": a, "stop": b} for a, b in zip(turns[::2], turns[1::2], strict=True)], b"".join(kept)))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["id", "n_bytes", "n_removed", "spans", "kept"])

    out = packs.join(gone.hint("shuffle_hash"), "pack", "left").select("ids", "sizes", "blob", "gone").mapInArrow(remove, "id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
