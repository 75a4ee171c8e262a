"""WARC archives: writing, and reading back with boundary-chain verification.

Archives are written by tasks under names of their own; only the manifest rows of the attempts that
succeeded, kept in a checkpoint, name the files that count. Reading splits files into chunks. Each
task takes every offset in its chunk that looks like a record (the version magic and a header that
parses) as a candidate and follows the candidates' successors to the first one beyond the chunk.
Pointer jumping from each file's start over these exits then tells the one true entry of each chunk;
candidates that are not reachable from the start, such as records inside payloads, drop out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, cut, shared_dir

MAGIC = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,15})(?=\r\n)")
_END, _MARGIN = b"\r\n\r\n", 64 << 10


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _field(text: str | None) -> str:
    """A header value: control characters and per cents percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without its payload."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = [MAGIC.decode().strip(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {_field(url)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def first_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """(digest, response): for payloads of least_bytes and more that occur on several pages, the smallest page id."""
    payload = F.coalesce(html_col, F.lit(""))
    digests = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    return digests.groupBy("digest").agg(F.min("id").alias("response"), F.count("*").alias("pages")).where("pages > 1 and response is not null").select("digest", "response")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, file_bytes: int = 64 << 20, broadcast_rows: int = 200_000) -> DataFrame:
    """Writes one record a row and returns the manifest (file, bytes). folder: any URI that pyarrow.fs opens.

    The table of repeated payloads is broadcast while it has at most broadcast_rows rows (about 100
    bytes each), and else joined by a shuffle. Rows that repeat the smallest id stay responses.
    """
    bound_batches(pages.sparkSession)
    firsts = cut(first_pages(pages, id_col, html_col, least_bytes))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    few = firsts.count() <= broadcast_rows
    marked = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    marked = marked.select("id", "url", F.col("html").cast("binary").alias("html"), "digest", F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        out, path, size = None, "", 0
        done = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if out is None:
                        path, size = f"{uuid.uuid4().hex}.warc", 0
                        out = filesystem.open_output_stream(f"{root}/{path}")
                    size += out.write(data := record(r["id"], r["url"], r["html"], r["digest"], r["refers_to"])) or len(data)
                    if size >= file_bytes:
                        out.close()
                        done.append((path, size))
                        out = None
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "bytes"])

    filesystem, root = _filesystem(folder)
    filesystem.create_dir(root, recursive=True)
    return cut(marked.mapInArrow(write, "file string, bytes long"))


def candidates(data: bytes, start: int, own: int, more: Callable[[int], bytes] = lambda n: b"") -> tuple[list[int], list[int]]:
    """Offsets of all that looks like a record and begins in the first own bytes of data, which lies at start, and the offsets of their successors.

    more(n) gives bytes after the first n, and none at the file's end: a header may be of any size. The
    header's end and the length in it are looked for once for all candidates before them.
    """
    offsets, successors, at = [], [], data.find(MAGIC)
    end, length, searched = -1, None, 0
    while 0 <= at < own:
        if end < at:
            end = data.find(_END, at)
            while end < 0 and (extra := more(len(data))):
                seen = max(at, len(data) - len(_END) + 1)
                data += extra
                end = data.find(_END, seen)
            if end < 0:
                break
        if length.start() < at if length else searched < len(data):
            length, searched = _LENGTH.search(data, at), len(data)
        if length and length.end() <= end:
            offsets.append(start + at)
            successors.append(start + end + len(_END) + int(length[1]) + len(_END))
        at = data.find(MAGIC, at + 1)
    return offsets, successors


def chunk_entries(manifest: DataFrame, folder: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(file, bytes, chunk, entry): the offset of the first true record of each chunk that has one."""
    chunks = manifest.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.col("bytes"), F.lit(1)) - 1) / chunk_bytes).cast("int"))))
    chunks = chunks.repartition(F.col("file"), F.col("chunk"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                start = r["chunk"] * chunk_bytes
                own = min(chunk_bytes, r["bytes"] - start)
                with filesystem.open_input_file(f"{root}/{r['file']}") as source:
                    def more(n: int, source=source, start=start) -> bytes:
                        source.seek(start + n)
                        return source.read(max(_MARGIN, n))

                    source.seek(start)
                    offsets, successors = candidates(source.read(own + _MARGIN), start, own, more)
                exits = dict(zip(offsets, successors, strict=True))
                for at in reversed(offsets):
                    exits[at] = exits.get(exits[at], exits[at])
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array([exits[x] for x in offsets], pa.int64())], ["file", "at", "to"])

    jump = cut(chunks.mapInArrow(scan, "file string, at long, to long"))
    reached = cut(manifest.where("bytes > 0").select("file", F.lit(0).cast("long").alias("at")))
    known = reached.count()
    while True:
        onward = jump.join(reached, ["file", "at"], "left_semi").select("file", F.col("to").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reached = cut(reached.union(onward).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        jump = cut(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("next")), ["file", "to"], "left").select("file", "at", F.coalesce("next", "to").alias("to")))
    broken = jump.where("at = 0").join(manifest.where("bytes > 0"), "file", "right").where("to is null or to != bytes").first()
    if broken is not None:
        raise ValueError(f"{broken['file']}: the chain ends at {broken['to']}, not at {broken['bytes']}")
    entries = reached.groupBy("file", F.floor(F.col("at") / chunk_bytes).cast("int").alias("chunk")).agg(F.min("at").alias("entry"))
    return entries.join(manifest, "file")


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = 8 << 20, payloads: bool = False) -> DataFrame:
    """The true records: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    Raises if a chain doesn't end at the end of its file or a payload doesn't have its digest.
    """
    entries = chunk_entries(manifest, folder, chunk_bytes).repartition(F.col("file"), F.col("chunk"))
    columns = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
        for batch in batches:
            for r in batch.to_pylist():
                rows, at, end = [], r["entry"], min((r["chunk"] + 1) * chunk_bytes, r["bytes"])
                with filesystem.open_input_file(f"{root}/{r['file']}") as source:
                    while at < end:
                        source.seek(at)
                        head = source.read(4096)
                        while (stop := head.find(_END)) < 0 and head.startswith(MAGIC) and (more := source.read(len(head))):
                            head += more
                        if not head.startswith(MAGIC) or stop < 0:
                            raise ValueError(f"{r['file']}: no record at {at}")
                        fields = dict(x.split(": ", 1) for x in head[len(MAGIC) : stop].decode("utf-8", "surrogatepass").split("\r\n"))
                        n = int(fields["Content-Length"])
                        source.seek(at + stop + 4)
                        payload = source.read(n)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if len(payload) < n or fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{r['file']}: damaged record at {at}")
                        url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), fields["WARC-Target-URI"])
                        rows.append((number(fields["WARC-Record-ID"]), url, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))) + (payload,) * payloads)
                        at += stop + 8 + n
                        if payloads and len(rows) >= 64:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if end == r["bytes"] and at != end:
                    raise ValueError(f"{r['file']}: the chain ends at {at}, not at {end}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return entries.mapInArrow(records, columns)


def archive_round_trip(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Writes pages as archives and reads them back; archives in a folder of its own are deleted once what they hold is checkpointed.

    Null html is an empty payload; URLs and payloads may be of any length; empty tables give no rows;
    null ids and repeated rows come back as they went in; other columns aren't written.
    """
    if folder:
        return read_archives(write_archives(pages, folder, **names), folder)
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    out = cut(read_archives(write_archives(pages, folder, **names), folder))
    filesystem, root = _filesystem(folder)
    filesystem.delete_dir(root)
    return out
