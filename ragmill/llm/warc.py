"""WARC archives: write one gzip member per record, read them back as a stream.

Tasks write their archive through Arrow's file systems into the folder that all executors share, under a temporary name
renamed at the end, so a repeated or speculative task leaves one whole file. The reader inflates a file member by
member in small pieces, frames each record by its Content-Length and verifies block and payload digests; memory is
bounded by the longest record.

Records with equal payloads of at least `min_revisit` bytes: that with the largest id is the response, the others are
revisit records that name it. Ids that are null or repeated: rows with the largest id of their payload are responses
(all of them, if repeated), a null id revisits any other. A null payload is empty. An empty table writes no file.
"""

from __future__ import annotations

import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm import common
from ragmill.llm.common import fresh_path, materialize
from ragmill.session import ship

MIN_REVISIT = 1_000
PIECE = 1 << 16


def record_id(page_id: int | None, salt: str) -> str:
    """A URN of the record: from the page's id where it has one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else salt)}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None, salt: str) -> bytes:
    """One WARC/1.1 record. A revisit has an empty block; the payload's digest and length stay in its header."""
    block = b"" if revisit_of is not None else payload
    sha = hashlib.sha1(payload).hexdigest()
    head = {
        "WARC-Type": "revisit" if revisit_of is not None else "response",
        "WARC-Record-ID": record_id(page_id, salt),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Block-Digest": f"sha1:{sha if revisit_of is None else hashlib.sha1(block).hexdigest()}",
        "Content-Length": str(len(block)),
    }
    if revisit_of is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(revisit_of, ""), "WARC-Refers-To-Page-ID": str(revisit_of)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def inflate_members(stream) -> Iterator[tuple[int, "MemberReader"]]:
    """Gzip members of a byte stream, each as a reader of its inflated bytes."""
    source = _Source(stream)
    n = 0
    while source.fill():
        member = MemberReader(source)
        yield n, member
        member.drain()
        n += 1


class _Source:
    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def fill(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(PIECE)
        return bool(self.rest)


class MemberReader:
    """Inflates one gzip member piece by piece."""

    def __init__(self, source: _Source):
        self.source, self.z, self.buffer, self.start = source, zlib.decompressobj(wbits=31), bytearray(), 0

    def _more(self) -> bool:
        while not self.z.eof:
            feed = self.z.unconsumed_tail
            if not feed:
                if not self.source.fill():
                    raise EOFError("truncated gzip member")
                feed, self.source.rest = self.source.rest, b""
            got = self.z.decompress(feed, PIECE)
            if self.z.eof:
                self.source.rest = self.z.unused_data + self.source.rest
            if got:
                self.buffer += got
                return True
        return False

    def line(self) -> bytes:
        at = self.start
        while (i := self.buffer.find(b"\n", at)) < 0:
            at = len(self.buffer)
            if not self._more():
                raise EOFError("header ends early")
        out = bytes(self.buffer[self.start : i + 1])
        self.start = i + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.start < n:
            if not self._more():
                raise EOFError("block shorter than Content-Length")
        out = bytes(self.buffer[self.start : self.start + n])
        self.start += n
        return out

    def drain(self) -> bytes:
        while self._more():
            pass
        out = bytes(self.buffer[self.start :])
        self.start = len(self.buffer)
        return out


def read_records(stream) -> Iterator[dict]:
    """Header fields (lower case), block and digest_ok of each record in order."""
    for n, m in inflate_members(stream):
        if not m.line().startswith(b"WARC/"):
            raise ValueError(f"member {n} does not start a record")
        head: dict[str, str] = {}
        while (line := m.line()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        block = m.take(int(head["content-length"]))
        if m.drain() != b"\r\n\r\n":
            raise ValueError(f"record {n} is not framed by its Content-Length")
        sha = "sha1:" + hashlib.sha1(block).hexdigest()
        ok = sha == head["warc-block-digest"] and (head["warc-type"] != "response" or sha == head["warc-payload-digest"])
        yield head | {"block": block, "digest_ok": ok}


def choose_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (binary) and revisit_of: the largest id with the same payload, null for responses.

    Only digests, lengths and ids are grouped; a group of copies is one partial row per task. The groups that have copies
    are written and broadcast up to GROUPS of them; beyond that small payloads stay out of the join, and each group's
    rows are dealt over salted keys, so the copies of one page never meet in one task."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("_sha", F.when(F.octet_length("payload") >= min_revisit, F.sha1("payload")))
    groups = rows.where(F.col("_sha").isNotNull()).groupBy("_sha").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n"))
    copies = materialize(groups.where((F.col("_n") > 1) & F.col("_top").isNotNull()).select("_sha", "_top"), "warc-copies")
    n = copies.count()
    if n <= common.GROUPS:
        out = common.join_groups(rows, copies, ["_sha"], n=n)
    else:
        small = rows.where(F.col("_sha").isNull()).withColumn("_top", F.lit(None).cast(copies.schema["_top"].dataType))
        out = common.join_groups(rows.where(F.col("_sha").isNotNull()), copies, ["_sha"], n=n).unionByName(small)
    other = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return out.select("page_id", "url", "payload", F.when(other, F.col("_top")).alias("revisit_of"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task below folder; rows (path, records) of the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(folder)
        final, temp, out, n = posixpath.join(root, f"part-{part:05d}.warc.gz"), posixpath.join(root, f"_part-{part:05d}-{attempt}"), None, 0
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(temp, compression=None)
                rec = make_record(row["page_id"], row["url"], row["payload"], row["revisit_of"], f"{part}:{n}")
                out.write(gzip.compress(rec, 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            store.move(temp, final)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{posixpath.basename(final)}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return records.mapInArrow(work, "path string, records long")


def read_archives(paths: DataFrame) -> DataFrame:
    """Records of the archives named in column path, a file a task: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, digest_ok, block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream):
                        ident, ref = r["warc-page-id"], r.get("warc-refers-to-page-id", "")
                        rows.append((int(ident) if ident else None, r["warc-target-uri"], int(r["warc-payload-length"]), r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], int(ref) if ref else None, r["digest_ok"], r["block"]))
                        size += len(r["block"])
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return paths.select("path").mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, block binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_()), ("block", pa.binary())]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])


def archive_round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record per page to archives in the shared folder, then read them all back."""
    spark = pages.sparkSession
    ship(spark)
    files = materialize(write_archives(choose_records(pages, min_revisit), fresh_path(spark, "warc")), "warc-files")
    n = max(1, files.count())
    return read_archives(files.repartition(n, "path"))
