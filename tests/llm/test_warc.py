import hashlib
import random
import re
import uuid

from pyarrow import fs

from tessera.llm import warc
from tessera.llm.common import shared_dir


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, file string")


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
ROWS = [
    (3, "http://a/%41\r\nX: y", "p" * 100), (1, "http://b", "p" * 100), (2, None, "short"), (4, "http://c", "short"), (5, "", None), (6, "u", ""),
    (7, "é", "ü" * 60), (8, "é", "ü" * 60), (9, "w", FAKE * 3), (10, "w", "WARC/1.1\r\n"), (None, "n", "q" * 200), (11, "n", "q" * 200), (12, "l", "z" * 300_000), (1, "http://b", "p" * 100), (13, "m", FAKE + "WARC/1.1\r\nContent-Length: 5"),
]


def brute(rows):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    several = {h for h in first if sum(x == h for _, _, x in rows) > 1}
    for i, _, h in rows:
        data = (h or "").encode()
        to = first[h] if h in several and first[h] != i else None
        yield i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to


def test_round_trip(spark):
    got = warc.archive_round_trip(pages(spark, ROWS)).collect()
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, brute(ROWS)))
    assert sorted(r.url for r in got) == sorted(u or "" for _, u, _ in ROWS)


def test_chunks_smaller_than_records(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    manifest = warc.write_archives(pages(spark, ROWS).coalesce(1), folder, file_bytes=2000)
    got = warc.read_archives(manifest, folder, chunk_bytes=512, payloads=True).collect()
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, brute(ROWS)))
    html = {(i, u or ""): (h or "").encode() for i, u, h in ROWS}
    assert all(bytes(r.payload) == html[r.page_id, r.url] for r in got if r.record_type == "response")


def test_damage_is_noticed(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    manifest = warc.write_archives(pages(spark, ROWS).coalesce(1), folder)
    system, root = fs.FileSystem.from_uri(folder)
    name = manifest.first()["file"]
    data = bytearray(system.open_input_file(f"{root}/{name}").read())
    data[len(data) // 2 :] = b"!" * (len(data) - len(data) // 2)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(bytes(data))
    try:
        warc.read_archives(manifest, folder, chunk_bytes=4096).count()
    except Exception as e:
        assert "record" in str(e) or "chain" in str(e)
    else:
        raise AssertionError("damage went unnoticed")


def test_empty(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_candidates_include_fakes_and_chains_skip_them():
    data = warc.record(1, "u", FAKE.encode(), "d", None) + warc.record(2, "v", b"", "d", None)
    offsets, successors = warc.candidates(data, 0, len(data))
    assert len(offsets) == 3 and successors[0] == offsets[2] and successors[2] == len(data)


def test_headers_of_any_size(spark):
    rows = [(1, "http://a/" + "u" * 2_000_000, "p" * 100), (2, "http://b/%" + "\r\n" * 50_000, FAKE), (3, "c", "p" * 100), (4, None, "WARC/1.1\r\n" * 20_000 + "\r\nContent-Length: 7\r\n")]
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    manifest = warc.write_archives(pages(spark, rows).coalesce(1), folder)
    for chunk_bytes in (8 << 20, 100_000):
        got = warc.read_archives(manifest, folder, chunk_bytes=chunk_bytes).collect()
        assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, brute(rows)))
        assert sorted(r.url for r in got) == sorted(u or "" for _, u, _ in rows)


def test_candidates_against_brute_force():
    rng = random.Random(3)
    bits = [b"WARC/1.1\r\n", b"\r\n\r\n", b"\r\nContent-Length: 3", b"\r\nContent-Length: 12\r\n", b"x", b"\r\n"]
    for _ in range(2000):
        data = b"".join(rng.choices(bits, k=rng.randrange(25)))
        own, given = rng.randrange(len(data) + 1), rng.randrange(len(data) + 1)
        want = []
        for at in range(own):
            end = data.find(b"\r\n\r\n", at)
            found = re.search(rb"\r\nContent-Length: (\d+)(?=\r\n)", data[at : end + 2]) if end >= 0 else None
            if data.startswith(b"WARC/1.1\r\n", at) and found:
                want.append((100 + at, 100 + end + 8 + int(found[1])))
        more = lambda n: data[n : n + rng.randrange(1, 9)]  # noqa: B023, E731
        assert list(zip(*warc.candidates(data[: max(given, own + 10)], 100, own, more), strict=True)) == want


def test_own_archives_go(spark):
    before = set(fs.FileSystem.from_uri(shared_dir(spark))[0].get_file_info(fs.FileSelector(fs.FileSystem.from_uri(shared_dir(spark))[1])))
    assert warc.archive_round_trip(pages(spark, ROWS)).count() == len(ROWS)
    after = fs.FileSystem.from_uri(shared_dir(spark))[0].get_file_info(fs.FileSelector(fs.FileSystem.from_uri(shared_dir(spark))[1]))
    assert not [x.path for x in after if x not in before and "/warc-" in x.path]
