import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffixes
from tessera.llm.induced import Minima, Queue, Scratch, doubled, suffix_array
from tests.llm.helpers import DOCS, documents, odd_documents


def plain(text):
    n = len(text) - 1
    order = sorted(range(n), key=lambda i: text[i:])
    shares = [0] * n
    for k in range(1, n):
        a, b = order[k - 1 : k + 1]
        while text[a + shares[k]] == text[b + shares[k]]:
            shares[k] += 1
    return order, shares


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=50), st.integers(1, 6), st.sampled_from([(64, 4, 3), (64, 16, 7), (1 << 20, 1 << 20, 1 << 16)]))
def test_suffix_array(part, times, sizes):
    text = part * times + [0]
    in_memory, most, block = sizes
    with Scratch(in_memory) as scratch:
        order, shares = suffix_array(np.array(text, np.uint16), scratch, most, block)
        assert (order.tolist(), shares.tolist()) == plain(text)


def test_names_recur_on_disk():
    rng = random.Random(3)
    text = [rng.randrange(1, 300) for _ in range(700)] * 4 + [0]
    with Scratch(256) as scratch:
        order, shares = suffix_array(np.array(text, np.uint16), scratch, 64, 128)
        assert scratch.files > 50
        assert (order.tolist(), shares.tolist()) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=50), st.integers(1, 6))
def test_doubled(part, times):
    text = part * times + [0]
    order, shares = doubled(np.array(text, np.int32))
    assert (order.tolist(), shares.tolist()) == plain(text)


def test_rare_names_take_few_batches(monkeypatch):
    """Changed copies of prose: their names are many and rare, and induction among them went in thousands of small batches."""
    rng, batches, head = random.Random(4), [], Queue.head
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(20_000))
    text = np.array([*(prose + prose[:50_000] + "x" + prose[50_000:]).encode(), 0], np.uint16)
    monkeypatch.setattr(Queue, "head", lambda self, size: batches.append(1) or head(self, size))
    with Scratch() as scratch:
        order, shares = suffix_array(text, scratch)
        assert len(batches) < 500
        recursive = suffix_array(text, scratch, most=1 << 14)
        assert np.array_equal(order, recursive[0]) and np.array_equal(shares, recursive[1])


def test_queue_gives_records_in_order_whatever_goes_in_between():
    rng = np.random.default_rng(1)
    with Scratch(128) as scratch:
        queue, floor, seen = Queue(scratch, 32), 0, []
        for _ in range(60):
            keys = rng.integers(floor, floor + 1000, 20).astype(np.uint64)
            queue.push(keys, keys.astype(np.int64))
            got, _ = queue.head(15)
            assert len(got) >= 10
            queue.take(10)
            seen += got[:10].tolist()
            floor = seen[-1]
        seen += [k for keys, _ in queue.blocks(7) for k in keys.tolist()]
        assert len(seen) == 1200 and seen == sorted(seen)


def test_minima():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1000, 500).astype(np.int32)
    with Scratch() as scratch:
        minima = Minima(scratch, 500)
        for part in np.split(values, [3, 40, 41, 200, 333]):
            minima.append(part)
        low = rng.integers(0, 500, 2000)
        high = np.minimum(499, low + rng.integers(0, 500, 2000))
        assert minima.least(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]


def brute(rows, least):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    counts = {}
    for _, t in texts:
        for i in range(len(t) - least + 1):
            counts[t[i : i + least]] = counts.get(t[i : i + least], 0) + 1
    for d, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - least + 1):
            if counts[t[i : i + least]] > 1:
                gone[i + 1 : i + 1 + least] = True
        kept = bytes(x for x, g in zip(t, gone[1:-1], strict=True) if not g)
        yield d, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()


def check(spark, rows, least, **options):
    got = suffixes.dedup_bytes(documents(spark, rows), least=least, **options).collect()
    out = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(map(repr, out)) == sorted(map(repr, brute(rows, least)))
    return got


def test_odd_rows(spark):
    rows = [r if r[1] is None or len(r[1]) < 50_000 else (r[0], r[1][:9000] + r[1][-3:], *r[2:]) for r in odd_documents()]
    check(spark, rows, 60, shard_bytes=4000)


@pytest.mark.parametrize("seed,options", [(0, {}), (1, {"shard_bytes": 300, "hot_stretches": 1}), (2, {"hot_stretches": 3, "scratch": {"in_memory": 512, "most": 64, "block": 50}})])
def test_shared_strings_at_any_offset(spark, seed, options):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [some(n) for n in (45, 90, 95, 130, 300)]
    rows = [(d, some(rng.randrange(80)) + "".join(rng.choice(shared) + some(rng.randrange(60)) for _ in range(3)), "en", "a") for d in range(40)]
    rows += [(100, "x" * 1500, "en", "a"), (101, "ab" * 700, "en", "a"), (102, "x" * 95, "en", "a")]
    check(spark, rows, 96, **options)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 700)
    rng = random.Random(9)
    long = "".join(rng.choice("abc") for _ in range(5000))
    for data in (long, "z" * 200 + long):
        found = suffixes.Stretches(data.encode(), np.array([len(data)]), 60)
        covered = np.concatenate([np.arange(a, a + n) for a, n in zip(found.start.tolist(), found.windows.tolist(), strict=True)])
        assert sorted(covered.tolist()) == list(range(len(data) - 59))
    rows = [(1, long, "en", "a"), (2, "z" * 200 + long, "en", "a"), (3, long[:59], "en", "a"), (4, long[:60], "en", "a")]
    check(spark, rows, 60)


def test_spans_and_text(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = some(80)
    rows = [(1, "<" + shared + ">", "en", "a"), (2, "(" + shared + ")", "en", "a")]
    got = {r.doc_id: r for r in check(spark, rows, 64)}
    assert [(s.start, s.stop) for s in got[1].spans] == [(1, 81)] and bytes(got[2].kept) == b"()"


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of over 50 words are often shorter: these stay, in both of their documents."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 11))) for _ in range(n))
    passages = [words(rng.randrange(51, 66)) for _ in range(40)] + [words(100)[:n] for n in (399, 400)]
    rows = [(2 * k + j, f"{words(90)} {'<('[j]}{p}{'>)'[j]} {words(90)}", "en", "a") for k, p in enumerate(passages) for j in (0, 1)]
    got = {r.doc_id: r.n_removed for r in check(spark, [*rows, (99, words(600), "en", "a")], 400)}
    sizes = [len(p) for p in passages]
    assert all(len(p.split()) > 50 for p in passages) and sum(n < 400 for n in sizes) > 10 and sum(n >= 400 for n in sizes) > 10
    assert got == {2 * k + j: n if n >= 400 else 0 for k, n in enumerate(sizes) for j in (0, 1)} | {99: 0}


def test_empty(spark):
    assert suffixes.dedup_bytes(spark.createDataFrame([], DOCS)).count() == 0
