import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth long, conv string, node int, n int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 3, "x", 4, 5) for r in rows], TURNS)


def spliced(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, x in own.items():
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(base, [])[:h] + x[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node, own in members.items():
        below = [k for k in members if k[: len(node)] == node]
        children = [k for k in below if len(k) == len(node) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        parent = min(members[node[:-1]]) if node else None
        yield min(own), len(node), parent, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()


def check(spark, rows):
    turns, lengths = trie.splice_heads(trie.ordered_turns(conversations(spark, rows)))
    out = trie.prefix_trie(turns, lengths)
    assert out.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(spliced(rows))))


@pytest.mark.parametrize("seed", range(2))
def test_shared_beginnings(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(450), 130):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn * 2, rng.choice(["user", "assistant"]) if turn > 1 else "user", rng.choice(["hi", "é☃", "", "more"])))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (100, 0, "user", "hello"), (100, 1, "bot", "a" * 100_000), (100, 1, "bot", "a"), (100, None, None, None), (101, 0, "user", "hello"), (101, 0, "user", "hello"),
        (102, None, None, "x"), (103, 5, "user", None), (None, 0, "user", "lost"), (None, None, None, None), (-7, 0, "user", "hello"), (-107, 0, "u", "serhello"), (5, 3, "user", "alone"), (2**62, 0, "user", "hello"),
    ]
    check(spark, rows)


def test_one_conversation_is_a_chain(spark):
    check(spark, [(3, k, "user", f"t{k}") for k in range(9)])


def test_many_copies_share_all_nodes(spark):
    rows = [(c, k, "user", f"t{k}") for c in range(1000, 1300) for k in range(3)]
    check(spark, rows)


def test_empty(spark):
    rows = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(*trie.splice_heads(trie.ordered_turns(rows))).count() == 0
