"""Suffix and common-prefix arrays by induced sorting in external memory.

Suffixes at the left end of a rise (a symbol whose left neighbour is greater, and which is smaller than the
next different one) are sorted first, by recursion on the string of their substrings' names; where these fit in
memory the recursion ends, as induction in batches is slow where most symbols are rare. All others are
induced from them: a scan in order hands each suffix's left neighbour to a priority queue, once upwards and
once downwards. Queues hold (symbol, rank of the source) and the suffix; beyond a number of records their
sorted runs go to disk. Common prefixes come along: neighbours in the order that begin with one symbol share
one more than their sources do, which is a minimum over the values scanned between these.

Work goes in numpy batches: a batch ends where something it induces would have to come before its next record.
Arrays over a size are files in Spark's own spill folders, mapped to memory, and go with the Scratch.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

_U = np.uint64
_TOP = np.iinfo(np.uint64).max


class Scratch:
    """Arrays: in memory up to a number of bytes each, else files in a folder for spills, deleted on leaving."""

    def __init__(self, in_memory: int = 32 << 20) -> None:
        self.in_memory = in_memory
        spills = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.folder = tempfile.TemporaryDirectory(prefix="suffixes-", dir=spills if os.path.isdir(spills) else None)
        self.files = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.folder.cleanup()

    def array(self, size: int, kind: type | np.dtype) -> np.ndarray:
        if size * np.dtype(kind).itemsize <= self.in_memory:
            return np.zeros(size, kind)
        self.files += 1
        name = os.path.join(self.folder.name, str(self.files))
        out = np.memmap(name, kind, "w+", shape=(size,))
        os.unlink(name)  # the mapping keeps it; its space goes with the array
        return out

    def keep(self, values: np.ndarray) -> np.ndarray:
        out = self.array(len(values), values.dtype)
        out[:] = values
        return out


class Queue:
    """Smallest keys first. Four runs of like sizes are merged up to `most` records; runs of over half that many go to scratch."""

    def __init__(self, scratch: Scratch, most: int) -> None:
        self.scratch, self.most, self.runs, self.order = scratch, most, [], None

    def push(self, keys: np.ndarray, values: np.ndarray, in_order: bool = False) -> None:
        if not len(keys):
            return
        if not in_order:
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        self.runs.append([keys, values, 0])
        left = [len(k) - i for k, _, i in self.runs[-4:]]
        while len(left) == 4 and left[0] <= 4 * left[3] and sum(left) <= self.most:
            keys, values = (np.concatenate([run[j][run[2] :] for run in self.runs[-4:]]) for j in range(2))
            order = np.argsort(keys, kind="stable")
            self.runs[-4:] = [[keys[order], values[order], 0]]
            left = [len(k) - i for k, _, i in self.runs[-4:]]
        last = self.runs[-1]
        if len(last[0]) > self.most // 2:
            last[0], last[1] = self.scratch.keep(last[0]), self.scratch.keep(last[1])

    def head(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """About size of the smallest records, in order; take() then removes the first of them."""
        size = max(64, 4 * size // max(4, len(self.runs)))
        parts, bound = [(k[i : i + size], v[i : i + size]) for k, v, i in self.runs], None
        for (k, _, i), (part, _) in zip(self.runs, parts, strict=True):
            if len(k) - i > size:
                bound = part[-1] if bound is None else min(bound, part[-1])
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in parts])
        values = np.concatenate([v for _, v in parts])
        self.order = np.argsort(keys, kind="stable")
        self.edges = np.cumsum([len(k) for k, _ in parts])
        keys = keys[self.order]
        if bound is not None:
            keys = keys[: np.searchsorted(keys, bound, "right")]
            self.order = self.order[: len(keys)]
        return keys, values[self.order]

    def take(self, count: int) -> None:
        taken = np.bincount(np.searchsorted(self.edges, self.order[:count], "right"), minlength=len(self.runs))
        for run, n in zip(self.runs, taken.tolist(), strict=True):
            run[2] += n
        self.runs = [r for r in self.runs if r[2] < len(r[0])]

    def blocks(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while self.runs:
            keys, values = self.head(size)
            self.take(len(keys))
            yield keys, values


class Minima:
    """An array that grows at its end, and minima of its ranges: within blocks of 8, and over runs of 2**k blocks."""

    def __init__(self, scratch: Scratch, size: int) -> None:
        self.size, self.blocks = 0, size // 8 + 1
        self.values, self.before, self.after = (scratch.array(size, np.int32) for _ in range(3))
        self.levels = self.blocks.bit_length()
        self.table = scratch.array(self.levels * self.blocks, np.int32).reshape(self.levels, self.blocks)

    def append(self, values: np.ndarray) -> None:
        begin, end = self.size, self.size + len(values)
        self.values[begin:end] = values
        first, whole = begin // 8, end // 8
        part = np.full((-(-end // 8) - first) * 8, np.iinfo(np.int32).max, np.int32)
        part[: end - first * 8] = self.values[first * 8 : end]
        rows = part.reshape(-1, 8)
        self.before[first * 8 : end] = np.minimum.accumulate(rows, 1).ravel()[: end - first * 8]
        self.after[first * 8 : end] = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()[: end - first * 8]
        if whole > first:
            self.table[0, first:whole] = rows[: whole - first].min(1)
            for k in range(1, self.levels):
                half, start = 1 << (k - 1), max(first, (1 << k) - 1)
                if start >= whole:
                    break
                np.minimum(self.table[k - 1, start:whole], self.table[k - 1, start - half : whole - half], out=self.table[k, start:whole])
        self.size = end

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of values[low..high], both included, for each pair."""
        a, b = low >> 3, high >> 3
        out = np.minimum(self.after[low], self.before[high])
        if (near := np.flatnonzero(a == b)).size:
            at = low[near, None] + np.arange(8)
            inside = at <= high[near, None]
            out[near] = np.where(inside, self.values[np.minimum(at, self.size - 1)], np.iinfo(np.int32).max).min(1)
        if (far := np.flatnonzero(b - a > 1)).size:
            a, b = a[far], b[far]
            k = np.frexp((b - a - 1).astype(np.float64))[1] - 1
            out[far] = np.minimum(out[far], np.minimum(self.table[k, b - 1], self.table[k, a + (1 << k)]))
        return out


def _spans(size: int, block: int) -> Iterator[tuple[int, int]]:
    for begin in range(0, size, block):
        yield begin, min(size, begin + block)


def classify(text: np.ndarray, scratch: Scratch, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how often its symbol repeats from there, and whether it rises (a greater one follows the repeats)."""
    n = len(text)
    run, rises = scratch.array(n, np.int32), scratch.array(n, np.bool_)
    run[n - 1], rises[n - 1] = 1, True
    for begin, end in reversed(list(_spans(n - 1, block))):
        part = np.asarray(text[begin : end + 1]).astype(np.int64)
        ends = np.flatnonzero(part[1:] != part[:-1])
        sizes = np.diff(np.concatenate(([-1], ends)))
        places = np.arange(end - begin)
        known = int(ends[-1]) + 1 if len(ends) else 0
        run[begin : begin + known] = np.repeat(ends, sizes) - places[:known] + 1
        rises[begin : begin + known] = np.repeat(part[ends] < part[ends + 1], sizes)
        run[begin + known : end] = end - begin - places[known:] + run[end]
        rises[begin + known : end] = rises[end]
    return run, rises


def induce(text: np.ndarray, top: int, down: bool, seeds: np.ndarray, shared: np.ndarray, run: np.ndarray, size: int, scratch: Scratch, most: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scans the seeds, given in order with what neighbours share, and all they induce: suffixes, whether induced, and what each shares with the one before.

    Downwards, symbols count from the top. Within a symbol the induced come before the seeds in both directions.
    """
    symbol = (lambda p: top - text[p].astype(np.int64)) if down else (lambda p: text[p].astype(np.int64))
    queue = Queue(scratch, most)
    keys = scratch.array(len(seeds), np.uint64)
    for a, b in _spans(len(seeds), block):
        keys[a:b] = symbol(seeds[a:b]).astype(np.uint64) << _U(33) | _U(1 << 32) | np.arange(a, b, dtype=np.uint64)
    if len(seeds):
        queue.runs.append([keys, seeds, 0])
    found, induced, common = scratch.array(size, np.int64), scratch.array(size, np.bool_), Minima(scratch, size)
    done, step, last_key, last_at = 0, 1024, None, 0
    while queue.runs:
        keys, at = queue.head(step)
        own, fresh = (keys >> _U(33)).astype(np.int64), (keys >> _U(32) & _U(1)) == 0
        left = at - 1
        before = symbol(np.maximum(left, 0))
        goes = (left >= 0) & ((before > own) | ((before == own) & fresh))
        rank = np.arange(done, done + len(keys), dtype=np.uint64)
        sent = np.where(goes, before.astype(np.uint64) << _U(33) | rank, _TOP)
        late = np.flatnonzero(keys[1:] > np.minimum.accumulate(sent)[:-1])
        count = int(late[0]) + 1 if len(late) else len(keys)
        step = min(block, max(256, 3 * count // 2) if len(late) else 2 * step)
        keys, at, own, fresh, goes = (x[:count] for x in (keys, at, own, fresh, goes))
        source = (keys & _U(0xFFFFFFFF)).astype(np.int64)
        first = done == 0
        prior = np.concatenate((keys[:1] if first else np.array([last_key], np.uint64), keys[:-1]))
        prior_at = np.concatenate((at[:1] if first else np.array([last_at], at.dtype), at[:-1]))
        same = (prior >> _U(33)).astype(np.int64) == own
        prior_fresh = (prior >> _U(32) & _U(1)) == 0
        value = np.zeros(count, np.int32)
        if (pick := np.flatnonzero(same & fresh & (prior != keys))).size:
            value[pick] = 1 + common.least((prior[pick] & _U(0xFFFFFFFF)).astype(np.int64) + 1, source[pick])
        if (pick := np.flatnonzero(same & ~fresh & prior_fresh)).size:
            value[pick] = np.minimum(run[prior_at[pick]], run[at[pick]])
        if (pick := np.flatnonzero(same & ~fresh & ~prior_fresh & (prior != keys))).size:
            value[pick] = shared[source[pick]]
        found[done : done + count], induced[done : done + count] = at, fresh
        common.append(value)
        last_key, last_at = keys[-1], at[-1]
        queue.take(count)
        queue.push(sent[:count][goes], left[:count][goes])
        done += count
    return found[:done], induced[:done], common.values[:done]


def _words(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, skip: int, count: int, bits: int) -> np.ndarray:
    """The symbols skip to skip + count of each substring in one number; zeros beyond its end."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(skip, skip + count):
        inside = k < sizes
        out = out << _U(bits) | np.where(inside, text[np.where(inside, starts + k, 0)], 0).astype(np.uint64)
    return out


def sort_substrings(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, top: int, scratch: Scratch, most: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in starts in order of their substrings, and whether each differs from the one before. Rounds of a few symbols; only what ties goes on."""
    bits, m = max(1, int(top).bit_length()), len(starts)
    order, new = scratch.array(m, np.int64), scratch.array(m, np.bool_)
    took = 63 // bits
    queue = Queue(scratch, most)
    for a, b in _spans(m, block):
        queue.push(_words(text, starts[a:b], sizes[a:b], 0, took, bits), np.arange(a, b))
    done, last = 0, None
    for keys, values in queue.blocks(block):
        order[done : done + len(keys)] = values
        new[done : done + len(keys)] = np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1]))
        done, last = done + len(keys), keys[-1]
    step = 32 // bits
    while True:
        queue, slots, seen, group = Queue(scratch, most), [], 0, 0
        for a, b in _spans(m, block):
            head = np.asarray(new[a:b])
            ids = group + np.cumsum(head)
            tied = ~head
            tied[:-1] |= ~head[1:]
            if b < m:
                tied[-1] |= not new[b]
            go = np.flatnonzero(tied & (sizes[order[a:b]] > took))
            items = np.asarray(order[a:b])[go]
            queue.push(ids[go].astype(np.uint64) << _U(32) | _words(text, starts[items], sizes[items], took, step, bits), items)
            slots.append(scratch.keep(go + a))
            seen, group = seen + len(go), int(ids[-1])
        if not seen:
            return order, new
        done, last = 0, None
        places = np.concatenate(slots)
        for keys, values in queue.blocks(block):
            at = places[done : done + len(keys)]
            order[at] = values
            new[at] |= np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1]))
            done, last = done + len(keys), keys[-1]
        took += step


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the different substrings at a and at b share."""
    out, live, last = np.zeros(len(a), np.int32), np.arange(len(a)), len(text) - 1
    steps = np.arange(8)
    while len(live):
        x, y = (text[np.minimum(p[live, None] + out[live, None] + steps, last)] for p in (a, b))
        equal = np.minimum.accumulate(x == y, 1).sum(1)
        out[live] += equal.astype(np.int32)
        live = live[equal == 8]
    return out


def doubled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What suffix_array returns, for a text that fits in memory: ranks by 1, 2, 4 and more symbols until none ties, then shared symbols from these ranks."""
    n = len(text) - 1
    order = np.argsort(text, kind="stable")
    head = np.concatenate(([True], np.diff(text[order]) != 0))
    go, ranks, width = np.arange(n + 1), [], 1
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, go, 0))
    while True:
        ranks.append(rank)
        tied = ~head
        tied[:-1] |= ~head[1:]
        go = np.flatnonzero(tied)
        if not len(go):
            break
        items = order[go]  # none reaches the end within the width, as it would differ from all others
        keys = rank[items].astype(np.uint64) << _U(32) | rank[items + width].astype(np.uint64)
        by = np.argsort(keys)
        keys, items = keys[by], items[by]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        order[go], head[go] = items, new
        rank = rank.copy()
        rank[items] = go[np.maximum.accumulate(np.where(new, np.arange(len(go)), 0))]
        width *= 2
    x, y = order[1:-1], order[2:]
    same = np.zeros(len(x), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same += (ranks[k][x + same] == ranks[k][y + same]).astype(np.int64) << k
    return order[1:], np.concatenate(([0], same))[:n].astype(np.int32)


def suffix_array(text: np.ndarray, scratch: Scratch, most: int = 1 << 20, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The order of a text's suffixes and how many symbols each shares with the one before it.

    text ends with its only 0, which isn't returned; symbols are whole numbers below 2**31. `most` records of a queue
    stay in memory, work goes in blocks of `block`.
    """
    n = len(text) - 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    top = max(int(np.max(text[a:b])) for a, b in _spans(n, block))
    run, rises = classify(text, scratch, block)
    firsts = [np.flatnonzero(rises[a + 1 : b + 1] & ~rises[a:b]) + a + 1 for a, b in _spans(n, block)]
    starts = scratch.keep(np.concatenate(firsts))
    m = len(starts)
    # To the next start, its repeats and the greater symbol after them: no such substring begins another one.
    sizes = scratch.array(m, np.int64)
    sizes[-1] = 1
    for a, b in _spans(m - 1, block):
        after = starts[a + 1 : b + 1]
        sizes[a:b] = after - starts[a:b] + 1 + np.where(after == n, 0, run[after])
    order, new = sort_substrings(text, starts, sizes, top, scratch, most, block)
    names = scratch.array(m, np.int32)
    between, name = Minima(scratch, m), -1
    for a, b in _spans(m, block):
        own = name + np.cumsum(new[a:b])
        names[order[a:b]] = own
        heads = np.flatnonzero(new[a:b]) + a
        heads, zero = heads[heads > 0], int(a == 0)
        between.append(np.concatenate((np.zeros(zero, np.int32), _shared(text, starts[order[heads - 1]], starts[order[heads]]))))
        name = int(own[-1])
    seeds, common = scratch.array(m, np.int64), scratch.array(m, np.int32)
    if name + 1 == m:
        for a, b in _spans(m, block):
            seeds[a:b], common[a:b] = starts[order[a:b]], between.values[a:b]
    else:
        inner, alike = doubled(names) if m <= most else suffix_array(names, scratch, most, block)
        seeds[0] = n
        for a, b in _spans(m - 1, block):
            y, same = inner[a:b], alike[a:b].astype(np.int64)
            x = np.concatenate((inner[a - 1 : a] if a else y[:1], y[:-1]))
            seeds[a + 1 : b + 1] = starts[y]
            low, high = names[x + same].astype(np.int64), names[y + same].astype(np.int64)
            value = np.zeros(b - a, np.int64)
            pick = np.flatnonzero(high > low)
            value[pick] = (starts[x + same] - starts[x])[pick] + between.least(low[pick] + 1, high[pick])
            common[a + 1 : b + 1] = value
    del order, new, names, between, sizes
    falls = n + 1 - sum(int(np.count_nonzero(rises[a:b])) for a, b in _spans(n + 1, block))
    found, induced, value = induce(text, top, False, seeds, common, run, falls + m, scratch, most, block)
    seeds, common, filled = scratch.array(falls, np.int64), scratch.array(falls, np.int32), 0
    for a, b in reversed(list(_spans(len(found), block))):
        pick = (np.flatnonzero(induced[a:b]) + a)[::-1]
        seeds[filled : filled + len(pick)] = found[pick]
        above = value[pick]  # what each shares with the next smaller one, which follows it here
        stop = min(falls, filled + len(pick) + 1)
        common[filled + 1 : stop] = above[: stop - filled - 1]
        filled += len(pick)
    found, _, value = induce(text, top, True, seeds, common, run, n, scratch, most, block)
    out, shares = scratch.array(n, np.int64), scratch.array(n, np.int32)
    for a, b in _spans(n, block):
        out[a:b] = found[n - b : n - a][::-1]
        low = max(a, 1)
        shares[low:b] = value[n - b + 1 : n - low + 1][::-1]
    return out, shares
