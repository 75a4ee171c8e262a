"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class k holds the lengths in (capacity/(k+1), capacity/k] and puts k whole documents in each of its
sequences, so a sequence follows from a document's rank in its class alone, and workers fill sequences
independently, some thousand documents at a time. Only what exceeds the capacity is cut, into whole
capacities and a rest that is packed like a document, and what fills up the classes' sequences: the
shortest documents, just as many as the gaps take, run through the gaps one after the other and are cut
where a gap ends. What a worker has left at its end, less than one sequence, goes to a second packing of
the rests of many workers.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut

END_ID = 2
#: A letter beside ASCII punctuation but the apostrophe: the tokenizer always parts them. Before
#: punctuation only letters whose normal or lower form can't end in a mark.
_SIDES = [r"([\p{Ll}A-Z])([!-&(-/:-@\[-`{-~])", r"([!-&(-/:-@\[-`{-~])(\pL)"]


class Encoder:
    """Encodes whole texts word by word; the tokenizer never joins across white space, nor letters with punctuation, and folds case, so distinct words are encoded once and looked up after that.

    The ids are those of the tokenizer's plain call: a special token's name in a text gives its id. With
    special_as_text it is ordinary text. Texts that hold such a name go to the tokenizer whole.
    """

    def __init__(self, path: str, most_words: int = 200_000, most_bytes: int = 32 << 20, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already, and threads cost memory
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        names = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "(?i)" + "|".join(map(re.escape, names)) if names else None
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.most_words, self.most_bytes = most_words, most_bytes
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words of letters go many at a time, as each ends where a token closes a word; where the count doesn't tally, one by one."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() else other).append(w)
        runs = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        order, ids, sizes = [], [self.ids], [self.size]
        for run, found in zip(runs, self._encoded([" ".join(run) for run in runs]), strict=True):
            ends = np.flatnonzero(self.closes[found]) + 1
            if len(ends) != len(run):
                other += run
                continue
            order += run
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        for at in range(0, len(other), 1024):
            each = self._encoded(other[at : at + 1024])
            order += other[at : at + 1024]
            ids += each
            sizes.append(np.array([len(x) for x in each], np.int64))
        known = len(self.known)
        self.bytes += sum(map(len, order))
        self.known.update(zip(order, range(known, known + len(order)), strict=True))
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's end in them."""
        if len(self.known) > self.most_words or self.bytes > self.most_bytes:
            self.clear()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole: dict[int, np.ndarray] = {}
        if self.special:
            named = pc.match_substring_regex(texts, self.special)
            at = np.flatnonzero(named.to_numpy(zero_copy_only=False)).tolist()
            whole = dict(zip(at, self._encoded([texts[k].as_py() for k in at]), strict=True))
            if whole:
                texts = pc.if_else(named, pa.scalar("", pa.large_string()), texts)
        for pattern in _SIDES:
            texts = pc.replace_substring_regex(texts, pattern, r"\1 \2")
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([w for w in distinct if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.first[at] - (ends - size), size) + np.arange(total)]
        last = np.concatenate(([0], ends))[np.cumsum(pc.list_value_length(words).to_numpy())]
        if whole:
            parts = np.split(ids, last[:-1])
            for k, own in whole.items():
                parts[k] = own
            ids, last = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, last


def harmonic(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packs items of 1 to capacity tokens into as many full sequences as their tokens fill.

    Returns (item, start, length, sequence, offset) of each piece; sequence -1 holds what is left, less
    than the capacity. The longest items go by class, k whole ones to a sequence; the shortest ones are
    the stream that fills the gaps, and as many as needed for the classes to take no more sequences
    than there are tokens for. Every sequence then is full.
    """
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    sizes = lengths[order].astype(np.int64)
    full = int(sizes.sum()) // capacity
    per = capacity // sizes
    class_start = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), per[1:] != per[:-1])))
    class_of = np.repeat(np.arange(len(class_start)), np.diff(np.append(class_start, n)))
    class_end = np.append(class_start[1:], n)
    rank = class_end[class_of] - 1 - np.arange(n)
    bins_of = -(-(class_end - class_start) // per[class_start])
    later = np.append(np.cumsum(bins_of[::-1])[::-1][1:], 0) if n else bins_of
    own = later[class_of] + rank // per
    split = int((own >= full).sum())  # own never rises with the position
    sequence = own[split:]
    within = np.zeros(n - split, np.int64)
    back, back_bins = sizes[split:][::-1], sequence[::-1]
    before = np.cumsum(back) - back
    first = np.concatenate((np.ones(min(1, n - split), bool), back_bins[1:] != back_bins[:-1]))
    within[::-1] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), n - split)))
    used = np.bincount(sequence, weights=sizes[split:], minlength=full).astype(np.int64)
    doc_edges = np.concatenate(([0], np.cumsum(sizes[:split])))
    gap_edges = np.concatenate(([0], np.cumsum(capacity - used)))
    total = int(doc_edges[-1])
    cuts = np.unique(np.concatenate((doc_edges, gap_edges[gap_edges < total])))
    begin, length = cuts[:-1], np.diff(cuts)
    item = np.searchsorted(doc_edges, begin, "right") - 1
    into = np.searchsorted(gap_edges, begin, "right") - 1
    left = begin >= gap_edges[-1]
    place = np.minimum(into, max(0, full - 1))
    offset = (used[place] if full else 0) + begin - gap_edges[place]
    return (
        order[np.concatenate((np.arange(split, n), item))], np.concatenate((np.zeros(n - split, np.int64), begin - doc_edges[item])), np.concatenate((sizes[split:], length)),
        np.concatenate((sequence, np.where(left, -1, place))), np.concatenate((within, np.where(left, 0, offset))),
    )


class Packer:
    """One worker's packing: documents come in, pieces with their sequences go out once some thousand sequences can be filled; what is left, less than a sequence, stays for the next time."""

    def __init__(self, capacity: int, first_sequence: int, with_ids: bool, tokens_a_time: int) -> None:
        self.capacity, self.next, self.with_ids, self.tokens_a_time = capacity, first_sequence, with_ids, tokens_a_time
        self.items: list[tuple[int | None, int, int, np.ndarray]] = []
        self.size = 0
        self.rows: list[tuple] = []

    def _row(self, doc: int | None, start: int, own: np.ndarray, tokens: int, sequence: int | None, offset: int) -> None:
        data = own.tobytes()
        self.rows.append((doc, start, len(own), zlib.crc32(data), tokens, sequence, offset, data if self.with_ids or sequence is None else None))

    def add(self, doc: int | None, own: np.ndarray) -> None:
        """A document's ids: whole capacities are sequences of their own, the rest is an item."""
        tokens, start = len(own), 0
        while tokens - start >= self.capacity:
            self._row(doc, start, own[start : start + self.capacity], tokens, self.next, 0)
            self.next, start = self.next + 1, start + self.capacity
        if start < tokens:
            self.put(doc, start, tokens, own[start:])

    def put(self, doc: int | None, start: int, tokens: int, own: np.ndarray) -> None:
        self.items.append((doc, start, tokens, own))
        self.size += len(own)
        if self.size >= self.tokens_a_time:
            self.pack()

    def pack(self) -> None:
        if not self.items:
            return
        items, found = self.items, []
        lengths = np.array([len(x[3]) for x in items], np.int64)
        for k, start, length, sequence, offset in zip(*(x.tolist() for x in harmonic(lengths, self.capacity)), strict=True):
            doc, at, tokens, own = items[k]
            part = own[start : start + length]
            if sequence < 0:
                found.append((doc, at + start, tokens, part.copy()))
            else:
                self._row(doc, at + start, part, tokens, self.next + sequence, offset)
        self.next += self.size // self.capacity
        self.items, self.size = found, self.size % self.capacity

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _NAMES)


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "data"]
_PIECE = ", ".join(f"{n} long" for n in _NAMES[:-1]) + ", data binary"


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, with_ids: bool = False, tokens_a_time: int = 1 << 22, workers_a_rest: int = 1024, special_as_text: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A document of at most capacity tokens is in one piece unless it is among the shortest of those packed
    with it, which fill gaps. Every sequence is full but one for each workers_a_rest (1,024) tasks.
    Memory holds tokens_a_time tokens (4 million) and one document, however large the input. Null and
    empty texts are the end id alone; very long texts and very long words are encoded whole; repeated
    rows and rows with equal ids are documents of their own; a null id stays null; an empty table gives
    no rows; other columns aren't read. Sequences depend on how the rows are dealt into partitions.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, worker = Encoder(path, special_as_text=special_as_text), TaskContext.get().partitionId()
        packer = Packer(capacity, worker << 32, with_ids, tokens_a_time)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, ends = encode(batch.column(1))
                begin = 0
                for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                    packer.add(doc, np.append(ids[begin:end], np.uint32(END_ID)).astype("<u4"))
                    begin = end
                    if len(packer.rows) >= 1024:
                        yield _with(packer.take(), worker)
        packer.pack()
        for doc, start, tokens, own in packer.items:
            packer._row(doc, start, own, tokens, None, 0)
        yield _with(packer.take(), worker)

    def again(key: tuple, table: pa.Table) -> pa.Table:
        """The rests of many workers, in the order of their workers; their last sequence may be padded."""
        packer = Packer(capacity, (key[0].as_py() * workers_a_rest << 32) + (1 << 31), with_ids, tokens_a_time)
        for r in table.sort_by([("worker", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).to_pylist():
            packer.put(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["data"], "<u4"))
        packer.pack()
        offset = 0
        for doc, start, tokens, own in packer.items:
            packer._row(doc, start, own, tokens, packer.next, offset)
            offset += len(own)
        return pa.Table.from_batches([packer.take()])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(rows.mapInArrow(run, f"{_PIECE}, worker long"))
    rests = pieces.where("sequence_id is null").withColumn("rest", F.expr(f"worker div {workers_a_rest}"))
    out = pieces.where("sequence_id is not null").drop("worker").unionByName(rests.groupBy("rest").applyInArrow(again, _PIECE))
    if not with_ids:
        return out.drop("data")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(7).to_pylist()
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in data]))), pa.int32())
            ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(data), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], ids], [*_NAMES[:-1], "ids"])

    return out.mapInArrow(listed, _PIECE.replace("data binary", "ids array<int>"))


def _with(batch: pa.RecordBatch, worker: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([worker] * batch.num_rows, pa.int64())], [*batch.schema.names, "worker"])
