import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import vocabulary
from tests.llm.helpers import DOCS, EN, documents, odd_documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def check(tokenizer, rows, out, capacity=4096):
    """Every id of every document lies in one piece, pieces lie in sequences without gaps, and little is padded."""
    want = defaultdict(list)
    for d, t, *_ in rows:
        want[d].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces = defaultdict(int)
    sequences = defaultdict(list)
    for r in out:
        assert r.length > 0 and any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in want[r.doc_id]), r
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == {d: sum(map(len, x)) for d, x in want.items()}
    padded = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded


def test_odd_rows(spark, tokenizer):
    rows = odd_documents()
    check(tokenizer, rows, packing.pack_documents(documents(spark, rows), vocabulary()).collect())


def test_ids_come_back(spark, tokenizer):
    rows = odd_documents()[:5]
    out = packing.pack_documents(documents(spark, rows), vocabulary(), with_ids=True).collect()
    texts = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in rows}
    assert all(r.ids == texts[r.doc_id][r.start : r.start + r.length] for r in out)


def test_little_padding(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = packing.pack_documents(docs, vocabulary()).collect()
    assert check(tokenizer, rows, out) < 0.05 * sum(r.length for r in out)


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), vocabulary()).count() == 0


def test_harmonic_sequences_are_full():
    rng = np.random.default_rng(1)
    for _ in range(300):
        capacity, n = int(rng.integers(2, 200)), int(rng.integers(1, 400))
        lengths = rng.integers(1, int(rng.integers(1, capacity)) + 1, n) if rng.random() < 0.8 else np.full(n, int(rng.integers(1, capacity)))
        item, start, length, sequence, offset = packing.harmonic(lengths, capacity)
        covered = [[] for _ in lengths]
        filled = defaultdict(list)
        for i, s, m, q, o in zip(item.tolist(), start.tolist(), length.tolist(), sequence.tolist(), offset.tolist(), strict=True):
            assert m > 0
            covered[i].append((s, m))
            filled[q].append((o, m))
        for n_tokens, found in zip(lengths.tolist(), covered, strict=True):
            at = 0
            for s, m in sorted(found):
                assert s == at
                at += m
            assert at == n_tokens
        assert sum(m for _, m in filled.pop(-1, [])) == lengths.sum() % capacity
        assert sorted(filled) == list(range(lengths.sum() // capacity))
        for found in filled.values():
            at = 0
            for o, m in sorted(found):
                assert o == at
                at += m
            assert at == capacity
        whole = [q for i, m, q in zip(item.tolist(), length.tolist(), sequence.tolist(), strict=True) if m == lengths[i]]
        assert len(lengths) - len(whole) <= lengths.sum() // capacity + 1  # a gap's end cuts one


def test_classes_hold_a_fixed_count():
    lengths = np.array([3000] * 4 + [2000] * 8 + [1300] * 9 + [300] * 40)
    item, start, length, sequence, _ = packing.harmonic(lengths, 4096)
    for size, count in ((3000, 1), (2000, 2), (1300, 3)):
        own = sequence[(lengths[item] == size) & (length == size)]
        assert len(own) == (lengths == size).sum() and set(np.unique(own, return_counts=True)[1]) == {count}
    assert (start[lengths[item] > 300] == 0).all()


def test_documents_that_fit_stay_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = packing.pack_documents(docs, vocabulary()).groupBy("doc_id", "doc_tokens").count().where("doc_tokens <= 4096").collect()
    assert sum(r["count"] == 1 for r in out) > 0.6 * len(out)


def test_many_workers_and_times(spark, tokenizer):
    rows = odd_documents() + [(100 + k, EN * (k % 60), "en", "a") for k in range(300)]
    docs = documents(spark, rows).repartition(7)
    out = packing.pack_documents(docs, vocabulary(), tokens_a_time=9000, workers_a_rest=3).collect()
    check(tokenizer, rows, out)
    assert len({r.sequence_id for r in out}) <= sum(r.length for r in out) / 4096 + 3


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(4)
    letters = list("abcXYZ '`.,;:-_=<>#%$|/\\()0123é É̸́  ’—€ßİıΣσς漢字١٢\U0001f600\t\n\r\x0b\x0c\x1c\x85'sdlvmשׁक़")
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(4000)] + [None, "", " ", "<|endoftext|> a<|startoftext|>b", "hello <|endoftext|> world", "x<|EndOfText|>y <|endoftext|", "it's don't WE'LL 's"]
    encode, begin = packing.Encoder(vocabulary(), most_words=500), 0
    for at in range(0, len(texts), 700):
        ids, ends = encode(pa.array(texts[at : at + 700]))
        begin = 0
        for text, end in zip(texts[at : at + 700], ends, strict=True):
            assert ids[begin:end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
            begin = end


def test_special_tokens_as_text():
    encode, t = packing.Encoder(vocabulary(), special_as_text=True), Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    text = "hello <|endoftext|> world"
    assert encode(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids
