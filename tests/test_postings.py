import random

import pytest

from tessera.functions.text import query_tokens
from tessera.operators import postings
from tessera.sources import segments

CHANGES = "kind string, id long, title string, text string, terms array<struct<field:string,token:string>>, seq int, deleted boolean"
WORDS = ["ab", "abc", "b", "ba", "bab", "Élan", "élan", "c9"]


def change(id, text, seq=0, deleted=False, terms=()):
    return ("song", id, text, text, list(terms), seq, deleted)


def brute(state, text):
    """Ids whose words have each run of the query side by side, its last word as a prefix."""
    def has(words, phrase):
        return any(words[i : i + len(phrase) - 1] == phrase[:-1] and words[i + len(phrase) - 1].startswith(phrase[-1]) for i in range(len(words) - len(phrase) + 1))

    return sorted(k for k, v in state.items() if postings.phrases(text) and all(has(query_tokens(v or "", 1000), p) for p in postings.phrases(text)))


def ids(spark, path, text):
    return sorted(r.id for r in postings.found(spark, path, text).collect())


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_brute_force(spark, tmp_path, seed):
    rng, path, state, sizes = random.Random(seed), f"file://{tmp_path}/index", {}, []
    for epoch in range(5):
        batch = []
        for seq in range(40 if epoch else 120):
            k, text = rng.randrange(80), rng.choice([None, "", *[" ".join(rng.choices(WORDS, k=rng.randrange(1, 6))) for _ in range(8)]])
            gone = epoch > 0 and rng.random() < 0.3
            batch.append(change(k, text, seq, rng.choice([True]) if gone else rng.choice([None, False])))
            state.pop(k, None) if gone else state.update({k: text})
        postings.apply(spark, path, epoch * 2 + 1, spark.createDataFrame(batch, CHANGES))
        if epoch == 2:  # the same batch again
            postings.apply(spark, path, epoch * 2 + 1, spark.createDataFrame(batch, CHANGES))
        sizes.append(len(segments.listed(spark, path)))
        for text in ["ab", "a b", "ab-b", "b.ab.b c", "éla", "ab ab ab", "zz", "", " - "]:
            assert ids(spark, path, text) == brute(state, text), (epoch, text)
    assert 2 in sizes and sizes.count(1) > 1  # grown and compacted
    kept = segments._names(spark, f"{path}/data")
    assert len(segments._epochs(spark, path)) == 2 and set(kept) >= {s.name for s in segments.listed(spark, path)} and len(kept) < 5


def test_prefixes_are_ranges_at_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    postings.apply(spark, path, 0, spark.createDataFrame([change(k, f"w{k % 50} x") for k in range(500)], CHANGES))
    explained = spark._jvm.PythonSQLUtils.explainString(postings.found(spark, path, "w1")._jdf.queryExecution(), "formatted")
    pushed = next(line for line in explained.splitlines() if line.startswith("PushedFilters") and "token" in line)
    assert "GreaterThanOrEqual(token,w1)" in pushed and "LessThan(token,w1" in pushed and "EqualTo(field,word)" in pushed


def test_no_rows_no_index_and_links(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        postings.live(spark, path)
    postings.apply(spark, path, 0, spark.createDataFrame([], CHANGES))
    assert ids(spark, path, "a") == [] and postings.sections(spark, path, "a").count() == 0
    postings.apply(spark, path, 1, spark.createDataFrame([change(1, "a", terms=[("artist", "7"), ("artist", "7"), ("artist", None)]), change(2, None, terms=[("artist", "70")])], CHANGES))
    assert [r.id for r in postings.linked(spark, path, "artist", [7], "song").collect()] == [1]
    more = spark.createDataFrame([("song", 3, "artist", "7"), ("song", 3, "artist", "7"), ("song", 3, "artist", None), ("song", 1, "artist", "7"), ("song", 4, "artist", "7")], "kind string, id long, field string, token string")
    postings.apply(spark, path, 2, spark.createDataFrame([change(1, "a", deleted=True), change(3, "c")], CHANGES), more)
    assert postings.linked(spark, path, "artist", [7], "song").collect() == [(3, "c")]
    postings.apply(spark, path, 3, spark.createDataFrame([change(3, "c", deleted=True)], CHANGES))
    assert postings.linked(spark, path, "artist", [7, 70], "song").collect() == [(2, None)]


def test_an_interrupted_batch_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    postings.apply(spark, path, 0, spark.createDataFrame([change(1, "a")], CHANGES))
    spark.createDataFrame([("word", "a", "song", 9, 0, "a")], "field string, token string, kind string, id long, position int, title string").write.parquet(f"{path}/data/e=1/postings")
    assert ids(spark, path, "a") == [1]
    postings.apply(spark, path, 1, spark.createDataFrame([change(2, "ab")], CHANGES))
    assert ids(spark, path, "a") == [1, 2]
