"""Sources and streaming upkeep."""

import json
import os

from pyspark.sql import functions as F

from tessera.sources import files, provider
from tessera.streaming import upkeep


def test_listing_and_pages(spark, tmp_path):
    for name in ("a/x.mp3", "a/b/y.flac", "a/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    found = files.listing(spark, f"file://{tmp_path}/a").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["x.mp3", "y.flac"] and all(r.size == 3 for r in found)
    page = {"count": 3, "offset": 0, "release-groups": [{"id": "1", "title": "T", "artist-credit": [{"name": "A", "joinphrase": " & "}, {"name": "B"}], "first-release-date": "2001"}, {"id": "2", "title": "U", "artist-credit": []}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    rows = files.group_items(files.provider_pages(spark, f"file://{tmp_path}/p.json")).orderBy("ordinal").collect()
    assert [(r.id, r.artist, r.complete) for r in rows] == [("1", "A & B", False), ("2", "", False)]


def test_list_addresses(spark):
    good = "A1b2C3d4E5f6G7h8I9j0Kl"
    cases = {good: good, f"svc:playlist:{good}": good, f"https://open.example.com/playlist/{good}?si=1": good, f"https://open.example.com/intl-de/playlist/{good}/": good, f"http://open.example.com/playlist/{good}": None, f"https://evil.com/playlist/{good}": None, "short": None}
    got = spark.createDataFrame([(k,) for k in cases], "a string").select("a", files.list_id(F.col("a"), "open.example.com", "svc").alias("x")).collect()
    assert {r.a: r.x for r in got} == cases


def test_provider_source(spark):
    provider.register(spark, "fake_provider", lambda k: ([{"id": k * 10 + i} for i in range(2)], k + 1 if k < 2 else None))
    rows = spark.read.format("fake_provider").option("pages", "3").load().orderBy("page", "ordinal").collect()
    assert [json.loads(r.item)["id"] for r in rows] == [0, 1, 10, 11, 20, 21] and [r.complete for r in rows] == [False] * 4 + [True] * 2


def stream_of(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")


def put(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    path = tmp_path / "in" / name
    path.write_text("\n".join(map(json.dumps, rows)))
    os.utime(path, (1_700_000_000 + int(name[0]),) * 2)  # files are read in order of their times


def test_latest_state_and_stale_subjects(spark, tmp_path):
    put(tmp_path, "1.json", [{"k": 1, "v": "a", "n": 1}, {"k": 2, "v": "b", "n": 1}, {"k": 3, "v": "d", "n": 1}])
    put(tmp_path, "2.json", [{"k": 1, "v": "c", "n": 2}, {"k": 2, "v": "old", "n": 0}])
    query = upkeep.keep_latest(stream_of(spark, tmp_path, "k int, v string, n int"), f"file://{tmp_path}/state", ["k"], ["n"]).option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.k, r.v) for r in upkeep.latest_state(spark, f"file://{tmp_path}/state").collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert len(list((tmp_path / "state" / "manifest").glob("e=*"))) == 2
    dependencies = spark.createDataFrame([(1, "x"), (1, "y"), (4, "z")], "k int, subject string")
    query = upkeep.stale_subjects(stream_of(spark, tmp_path, "k int, v string, n int"), dependencies, "k", "subject", f"file://{tmp_path}/stale").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.subject for r in spark.read.parquet(f"file://{tmp_path}/stale").collect()} == {"x", "y"}


def test_windows_and_first_seen(spark, tmp_path):
    put(tmp_path, "1.json", [{"k": 1, "ts": "2024-01-01T00:10:00"}, {"k": 1, "ts": "2024-01-01T00:50:00"}])
    put(tmp_path, "2.json", [{"k": 1, "ts": "2024-01-01T03:00:00"}])
    put(tmp_path, "3.json", [{"k": 1, "ts": "2024-01-01T03:01:00"}])
    put(tmp_path, "4.json", [{"k": 1, "ts": "2024-01-01T00:20:00"}, {"k": 2, "ts": "2024-01-01T06:00:00"}])
    stream = stream_of(spark, tmp_path, "k int, ts timestamp")
    query = upkeep.windowed_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert sorted((r.window.start.hour, r.k, r.n) for r in spark.table("counts").collect())[0] == (0, 1, 2)
    query = upkeep.first_seen(stream, "ts", ["k"], "1 day").writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c4").trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert sorted(r.k for r in spark.table("seen").collect()) == [1, 2]
