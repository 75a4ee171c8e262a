import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import projections
from tessera.sources import segments
from tessera.streaming import upkeep

CHANGES = "id long, album string, title string, seq int, deleted boolean"
VIEWS = {"order": lambda rows: rows.select(F.col("album").alias("grp"), F.col("title").alias("value")), "words": lambda rows: rows.select(F.explode(F.split("title", " ")).alias("grp"), F.lit(None).alias("value"))}


def fold(state, revisions, batch):
    """The batch's last changes, one by one."""
    for id, album, title, seq, gone in sorted(batch, key=lambda r: (r[3], bool(r[4]), (r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or ""))):
        state["last"][id] = (seq, None if gone else (album, title))
    for id, (seq, new) in state["last"].items():
        had, old = state["rows"].get(id, (float("-inf"), None))
        if seq > had:
            if old != new:
                revisions.update({a for a in (old and old[0], new and new[0]) if a is not None})
            state["rows"][id] = (seq, new)
    state["last"] = {}


def recomputed(state):
    rows = [r for _, r in state["rows"].values() if r]
    return Counter((a, t) for a, t in rows), Counter((w, None) for _, t in rows if t is not None for w in t.split(" "))


def kept(spark, path, view):
    return {(r.grp, r.value): r.weight for r in projections.contents(spark, path, view).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_a_recomputation(spark, tmp_path, seed):
    rng, path, state, revisions = random.Random(seed), f"file://{tmp_path}/p", {"rows": {}, "last": {}}, Counter()
    for epoch in range(6):
        batch = [(rng.randrange(30), rng.choice([None, "x", "y", "hot", "hot"]), rng.choice([None, "", "b", "a b", "a a"]), epoch * 50 + k - (60 if rng.random() < 0.2 else 0), rng.choice([None, False, False, epoch > 0])) for k in range(60 if not epoch else 12)]
        batch = list({(r[0], r[3]): r for r in batch}.values())
        frame = spark.createDataFrame(batch, CHANGES)
        projections.apply(spark, path, epoch * 3 + 2, frame, ["id"], VIEWS, ["album"])
        if epoch in (1, 4):  # the same batch again
            projections.apply(spark, path, epoch * 3 + 2, frame, ["id"], VIEWS, ["album"])
        fold(state, revisions, batch)
        order, words = recomputed(state)
        assert kept(spark, path, "order") == order and kept(spark, path, "words") == words
        assert {r.grp: r.weight for r in projections.contents(spark, path, projections.REVISION).collect()} == revisions
        assert sorted(map(repr, ((r.album, r.title) for r in projections.base(spark, path).collect()))) == sorted(map(repr, order.elements()))
    for table in ("base", "weights"):
        assert len(segments._epochs(spark, f"{path}/{table}")) == 2
        assert len(segments._names(spark, f"{path}/{table}/data")) < 6  # old versions go


def test_first_values_survive_deletions(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    rows = lambda *r: spark.createDataFrame(r, CHANGES)
    projections.apply(spark, path, 0, rows((1, "x", "a", 0, False), (2, "x", "b", 0, False), (3, "x", "b", 0, None)), ["id"], VIEWS)
    projections.apply(spark, path, 1, rows((1, None, None, 1, True), (2, "x", "old", -1, False)), ["id"], VIEWS)
    assert projections.first_values(spark, path, "order").collect() == [("x", "b", 2)]
    assert projections.contents(spark, path, "order", ["x"]).count() == 1 and projections.contents(spark, path, "order", ["y"]).count() == 0
    with pytest.raises(FileNotFoundError):
        projections.contents(spark, f"file://{tmp_path}/none", "order")


def test_upsert_keeps_the_last_row_and_few_segments(spark, tmp_path):
    rng, path, state = random.Random(5), f"file://{tmp_path}/u", {}
    for epoch in range(3, 15):
        batch = [(rng.randrange(12 + epoch * 4), epoch * 10 + rng.randrange(-30, 30), rng.random()) for _ in range(6)]
        segments.upsert(spark, path, epoch, spark.createDataFrame(batch, "k int, n int, v double"), ["k"], ["n"])
        for k, n, v in batch:
            state[k] = max(state.get(k, (-1e9, 0)), (n, v))
        assert {r.k: (r.n, r.v) for r in segments.live(spark, path, "rows").collect()} == state
        assert len(segments.listed(spark, path)) <= 9 and len(segments._epochs(spark, path)) <= 2
    with pytest.raises(ValueError):
        segments.upsert(spark, path, 20, spark.createDataFrame([(None, 1, 0.0)], "k int, n int, v double"), ["k"], ["n"])


def test_a_stream_keeps_projections(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, line in (("1", '{"id": 1, "album": "x", "title": "a", "seq": 0}'), ("2", '{"id": 1, "album": "y", "title": "b", "seq": 1}')):
        (tmp_path / "in" / f"{name}.json").write_text(line)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    upkeep.keep_projections(stream, f"file://{tmp_path}/p", ["id"], VIEWS, ["album"]).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(90)
    assert sum(kept(spark, f"file://{tmp_path}/p", "order").values()) == 1 and kept(spark, f"file://{tmp_path}/p", projections.REVISION).keys() == {("x", "album"), ("y", "album")}
