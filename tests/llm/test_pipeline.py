import hashlib
import math

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.queries import vocabulary
from tests.llm.helpers import DE, DOCS, EN, FR, documents, odd_documents, words
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import check
from tests.llm.test_secrets import TOKEN
from tests.llm.test_simhash import brute


@pytest.fixture(scope="module")
def rows():
    texts = {"en": EN, "de": DE, "fr": FR}
    more = [(200 + i, f"{texts[g][i:] * 2} u{i} v{i} {texts[g]} w{i}", g, f"s{i % 4}") for i, g in enumerate(["en", "de", "fr"] * 8)]
    return odd_documents() + more + [(300, f'{DE} {DE} token = "{TOKEN}" und mehr', "de", "s1"), (301, more[0][1] + " x", "en", "s2")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    documents(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def mixed(rows):
    """(doc_id, text, source) as the mix takes them."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    targets = brute_targets(sizes)
    out, seen = [], dict.fromkeys(sizes, 0)
    for d, t, s in sorted(rows, key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), len(words(r[1])))):
        n, budget = len(words(t)), math.floor(targets[s])
        epochs = budget // sizes[s] if sizes[s] else 0
        part = max(0, min(n, budget - epochs * sizes[s] - seen[s]))
        seen[s] += n
        out += [(d, t, s)] * (epochs if n else 0)
        if part:
            out.append((d, t if part == n else " ".join(words(t)[:part]), s))
    return out


def pairs(docs):
    return sorted((str(r.doc_id), r.text) for r in docs.collect())


def test_stages_against_brute_force(spark, rows, folder):
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "secrets", "mixing", "packing"]

    docs = stages["language_id"](spark, docs, folder)
    kept = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(map(repr, [(d, t, s) for d, t, _, s in kept])) == sorted(map(repr, [(d, t, s) for d, t, _, s in rows if t and any(c.isalpha() for c in t)]))
    known = {d: g for d, t, g, _ in rows if d is not None and (200 <= d or d in (1, 2, 3, 4))}
    assert all(g == known[d] for d, _, g, _ in kept if d in known)

    docs = stages["simhash"](spark, docs, folder)
    label = brute(kept)
    unique = [r for r in kept if r[0] is None or label[r[0]] == r[0]]
    assert pairs(docs) == sorted((str(d), t) for d, t, *_ in unique)
    assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]

    docs = stages["secrets"](spark, docs, folder)
    clean = [(d, t.replace(TOKEN, "<secret>"), s) for d, t, _, s in unique]
    assert pairs(docs) == sorted((str(d), t) for d, t, _ in clean)

    docs = stages["mixing"](spark, docs, folder)
    taken = mixed(clean)
    assert pairs(docs) == sorted((str(d), t) for d, t, _ in taken)

    tokenizer = Tokenizer.from_file(vocabulary())
    check(tokenizer, taken, stages["packing"](spark, docs, folder).collect())
    out = corpus_pipeline.run(spark, folder).collect()
    check(tokenizer, taken, out)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
