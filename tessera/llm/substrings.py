"""Exact substring removal with fixed-block anchors.

A window of 50 words always holds one whole block of 25 words of the document it repeats, whatever the
offset, if that document is cut into blocks that don't overlap. So non-overlapping blocks are indexed,
every rolling 25-word window probes the index, and only around hits are whole windows compared and the
hits extended to maximal repeats.

Texts are first packed and checkpointed, so that a pack's content is fixed and a reply can be one bit a
probe. Probes go out by hash, each hash once a pack, so what a hot passage sends grows with the number
of packs and not of its copies. Hits are answered the same way; the windows around them are then keyed
by 96 bits of their whole word sequence, and per key only the smallest document id is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut, free_shuffles

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[_SPACE] = 0
_STEP, _STEP_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LAST = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] for each span, from prefix sums of one polynomial."""
    up, down = powers(len(values) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
    return _mix((prefix[ends] - prefix[starts]) * down[starts])


class Pack:
    """The words of a pack's documents: spans in its bytes, hashes, and each document's range of words."""

    def __init__(self, blob: bytes, powers: Powers) -> None:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        self.ids = np.frombuffer(raw, np.int64, n, 8)
        sizes = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        self.text = raw[8 + 16 * n :]
        buffer = np.frombuffer(self.text, np.uint8)
        space = np.concatenate((np.ones(1, bool), _SPACE[buffer], np.ones(1, bool)))
        self.starts, self.ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        edges = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, edges[:-1])
        self.words = np.diff(np.append(self.first, len(self.starts)))
        self.hash = _mix(span_hashes(_BYTE[buffer], self.starts, self.ends, powers) + (self.ends - self.starts).astype(np.uint64))
        self.doc = np.repeat(np.arange(n), self.words)

    def windows(self, size: int, least: int) -> np.ndarray:
        """Word positions at which a window of size words starts, in documents of at least least words."""
        at = np.arange(len(self.doc))
        left = (self.first + self.words)[self.doc] - at
        return at[(left >= size) & (self.words[self.doc] >= least)]


def pack_texts(docs: DataFrame, id_col: str, text_col: str, pack_bytes: int = 2 << 20) -> DataFrame:
    """Checkpointed rows (pack, words, blob); a text longer than pack_bytes is a pack of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 33
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            raw = np.array([len(ids), *ids, *map(len, texts)], np.int64).tobytes() + b"".join(texts)
            words = sum(len(t) for t in texts) // 6
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([words], pa.int64()), pa.array([press.compress(raw)], pa.binary())], ["pack", "size", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids.append(_LAST if doc is None else doc)
                    texts.append((text or b"") + b" ")
                    size += len(texts[-1])
                    if size >= pack_bytes:
                        yield row()
                        number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    return cut(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "pack long, size long, blob binary"))


class Probes:
    """A pack's rolling block hashes: each once, in order of part and 32 bits, with what is known of it."""

    def __init__(self, pack: Pack, parts: int, block: int, window: int, powers: Powers) -> None:
        self.at = pack.windows(block, window)
        hashes = span_hashes(pack.hash, self.at, self.at + block, powers)
        keys = (hashes >> _U(32)) % _U(parts) << _U(32) | hashes & _U(0xFFFFFFFF)
        self.order = np.argsort(keys)
        ordered = keys[self.order]
        self.new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1])))
        self.keys = ordered[self.new]
        doc = pack.doc[self.at[self.order]]
        anchor = (self.at[self.order] - pack.first[doc]) % block == 0
        if len(self.new):
            ids = pack.ids[doc]
            several = np.minimum.reduceat(ids, self.new) != np.maximum.reduceat(ids, self.new)
            self.flags = np.logical_or.reduceat(anchor, self.new).astype(np.uint8) | several.astype(np.uint8) << np.uint8(1)
        else:
            self.flags = np.zeros(0, np.uint8)

    def hits(self, masks: dict[int, bytes]) -> np.ndarray:
        """Word positions of the probes that were answered."""
        found = spread_masks((self.keys >> _U(32)).astype(np.int64), masks)
        sizes = np.diff(np.append(self.new, len(self.order)))
        return self.at[self.order[np.repeat(found, sizes)]]


def by_part(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(parts)), bool), parts[1:] != parts[:-1], np.ones(min(1, len(parts)), bool))))
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(parts[begin]), begin, end


def spread_masks(parts: np.ndarray, masks: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(parts), bool)
    for part, begin, end in by_part(parts):
        if part in masks:
            out[begin:end] = np.unpackbits(np.frombuffer(masks[part], np.uint8), count=end - begin).astype(bool)
    return out


class Candidates:
    """The windows around a pack's hits: the starts, and each whole word sequence once with its smallest document id."""

    def __init__(self, pack: Pack, hits: np.ndarray, parts: int, block: int, window: int, powers: Powers, powers_2: Powers) -> None:
        doc = pack.doc[hits]
        low = np.maximum(hits + block - window, pack.first[doc])
        high = np.minimum(hits, (pack.first + pack.words)[doc] - window)
        steps = np.zeros(len(pack.doc) + 1, np.int64)
        np.add.at(steps, low, 1)
        np.add.at(steps, high + 1, -1)
        self.at = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        a = span_hashes(pack.hash, self.at, self.at + window, powers)
        b = span_hashes(_mix(pack.hash + _U(1)), self.at, self.at + window, powers_2) & _U(0xFFFFFFFF)
        part = b % _U(parts)
        self.order = np.lexsort((b, a, part))
        a, b, part = a[self.order], b[self.order], part[self.order]
        self.new = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        self.part, self.a, self.b = part[self.new].astype(np.int64), a[self.new], b[self.new].astype(np.uint32)
        self.ids = pack.ids[pack.doc[self.at[self.order]]]
        self.least = np.minimum.reduceat(self.ids, self.new) if len(self.new) else self.ids

    def victims(self, masks: dict[int, bytes]) -> np.ndarray:
        """Starts of the windows that a document with a smaller id also has."""
        sizes = np.diff(np.append(self.new, len(self.order)))
        gone = np.repeat(spread_masks(self.part, masks), sizes) | (self.ids > np.repeat(self.least, sizes))
        return self.at[self.order[gone]]


def planes(sorted_values: np.ndarray) -> bytes:
    """Rising 32-bit values as differences, byte by byte of all: high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(np.diff(sorted_values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False, probes_a_part: int = 2_000_000, join_bytes: int = 16 << 20) -> DataFrame:
    """One row for each input row: id_col, n_words, n_removed, kept_sha256[, kept].

    Words are runs of anything but space and the controls 9 to 13. A word goes if a window of the input
    covers it whose words also start in a document with a smaller id; null ids are the greatest. Null
    and empty texts have no words; rows with equal ids don't remove from each other. Windows count as
    equal if 96 bits of two independent hashes are. Packs meet their answers in tasks of about join_bytes
    compressed bytes (more only where one text has more), as many as the data need whatever the session's
    number of shuffle partitions; empty tables give no rows; very long texts are packs of their own;
    other columns aren't read.
    """
    block = window // 2
    bound_batches(docs.sparkSession)
    packs = pack_texts(docs, id_col, text_col)
    total, pressed = (x or 0 for x in packs.agg(F.sum("size"), F.sum(F.length("blob"))).first())
    parts = max(1, -(-total // probes_a_part))
    joined = max(packs.sparkSession.sparkContext.defaultParallelism, -(-pressed // join_bytes))
    sides = packs.select("pack", "blob").repartition(joined, "pack")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes, of_blocks = Powers(_STEP), Powers(_STEP)
        for batch in batches:
            for k in range(batch.num_rows):
                probes = Probes(Pack(batch.column(1)[k].as_py(), of_bytes), parts, block, window, of_blocks)
                own = batch.column(0)[k].as_py()
                yield _batch(["part", "pack", "hashes", "flags"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], [(p, own, planes(probes.keys[s:e].astype(np.uint32)), probes.flags[s:e].tobytes()) for p, s, e in by_part((probes.keys >> _U(32)).astype(np.int64))])

    def answer(table: pa.Table) -> pa.Table:
        hashes = [from_planes(x) for x in table.column("hashes").to_pylist()]
        every = np.concatenate(hashes)
        flags = np.frombuffer(b"".join(table.column("flags").to_pylist()), np.uint8)
        order = np.argsort(every)
        ordered = every[order]
        new = np.flatnonzero(np.concatenate((np.ones(1, bool), ordered[1:] != ordered[:-1])))
        sizes = np.diff(np.append(new, len(every)))
        seen = np.bitwise_or.reduceat(flags[order], new)
        hit = np.zeros(len(every), bool)
        hit[order] = np.repeat((seen & 1 > 0) & ((seen & 2 > 0) | (sizes > 1)), sizes)
        out = [(p, int(part), np.packbits(x).tobytes()) for p, part, x in zip(table.column("pack").to_pylist(), table.column("part").to_pylist(), np.split(hit, np.cumsum([len(h) for h in hashes])[:-1]), strict=True) if x.any()]
        return pa.Table.from_batches([_batch(["pack", "part", "mask"], [pa.int64(), pa.int32(), pa.binary()], out)])

    sent = packs.select("pack", "blob").mapInArrow(probe, "part int, pack long, hashes binary, flags binary")
    masks = cut(sent.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(answer, "pack long, part int, mask binary"))
    free_shuffles(packs.sparkSession)
    gathered = lambda df, name: df.repartition(joined, "pack").groupBy("pack").agg(F.collect_list(F.struct("part", "mask")).alias(name))  # noqa: E731  a mask a part at most
    hit_packs = sides.join(gathered(masks, "hits").hint("shuffle_hash"), "pack")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes, of_blocks, of_windows = Powers(_STEP), Powers(_STEP), Powers(_STEP_2)
        for batch in batches:
            for k in range(batch.num_rows):
                pack = Pack(batch.column(1)[k].as_py(), of_bytes)
                hits = Probes(pack, parts, block, window, of_blocks).hits({x["part"]: x["mask"] for x in batch.column(2)[k].as_py()})
                found = Candidates(pack, hits, parts, block, window, of_blocks, of_windows)
                own = batch.column(0)[k].as_py()
                yield _batch(["part", "pack", "a", "b", "least"], [pa.int32(), pa.int64()] + [pa.binary()] * 3, [(p, own, found.a[s:e].tobytes(), found.b[s:e].tobytes(), found.least[s:e].tobytes()) for p, s, e in by_part(found.part)])

    def earlier(table: pa.Table) -> pa.Table:
        a, b, least = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("a", np.uint64), ("b", np.uint32), ("least", np.int64)))
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.flatnonzero(np.concatenate((np.ones(1, bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        smallest = np.repeat(np.minimum.reduceat(least[order], new), np.diff(np.append(new, len(a))))
        gone = np.zeros(len(a), bool)
        gone[order] = smallest < least[order]
        sizes = [len(x) // 8 for x in table.column("a").to_pylist()]
        out = [(p, int(part), np.packbits(x).tobytes()) for p, part, x in zip(table.column("pack").to_pylist(), table.column("part").to_pylist(), np.split(gone, np.cumsum(sizes)[:-1]), strict=True) if x.any()]
        return pa.Table.from_batches([_batch(["pack", "part", "mask"], [pa.int64(), pa.int32(), pa.binary()], out)])

    around = hit_packs.mapInArrow(windows, "part int, pack long, a binary, b binary, least binary")
    gone = cut(around.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(earlier, "pack long, part int, mask binary"))
    free_shuffles(packs.sparkSession)
    ready = sides.join(gathered(masks, "hits").hint("shuffle_hash"), "pack", "left").join(gathered(gone, "gone").hint("shuffle_hash"), "pack", "left").select("blob", "hits", "gone")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes, of_blocks, of_windows = Powers(_STEP), Powers(_STEP), Powers(_STEP_2)
        as_dict = lambda x: {r["part"]: r["mask"] for r in x or []}
        for batch in batches:
            for k in range(batch.num_rows):
                pack = Pack(batch.column(0)[k].as_py(), of_bytes)
                covered = np.zeros(len(pack.doc), bool)
                if hits := as_dict(batch.column(1)[k].as_py()):
                    at = Probes(pack, parts, block, window, of_blocks).hits(hits)
                    starts = Candidates(pack, at, parts, block, window, of_blocks, of_windows).victims(as_dict(batch.column(2)[k].as_py()))
                    steps = np.zeros(len(pack.doc) + 1, np.int64)
                    np.add.at(steps, starts, 1)
                    np.add.at(steps, starts + window, -1)
                    covered = np.cumsum(steps[:-1]) > 0
                rows = []
                for doc, first, n in zip(pack.ids.tolist(), pack.first.tolist(), pack.words.tolist(), strict=True):
                    words = pack.text[pack.starts[first] : pack.ends[first + n - 1]].split() if n else []
                    own = covered[first : first + n]
                    removed = int(own.sum())
                    if removed:
                        words = [w for w, x in zip(words, own.tolist(), strict=True) if not x]
                    kept = b" ".join(words)
                    rows.append((None if doc == _LAST else doc, n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
                width = 5 if with_text else 4
                yield _batch(["id", "n_words", "n_removed", "kept_sha256", "kept"][:width], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][:width], rows)

    out = ready.mapInArrow(remove, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumnRenamed("id", id_col)
