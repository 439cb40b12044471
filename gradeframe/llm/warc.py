"""WARC archives: records written with revisits, read back as a table of chunks.

A payload is never held whole by the reader: it comes as rows (record_id, chunk_no, data)
of bounded size, each with the SHA-1 of the payload up to its end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.session import new_dir, written

from .common import ship, text_batches

PIECE = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_roles(pages: DataFrame, smallest: int = 1000) -> DataFrame:
    """page_id, url, payload, digest (SHA-1), record_type, refers_to of every page.

    Among records with equal payloads of at least ``smallest`` bytes the one with the
    largest page_id is the response and the others revisit it.  A null html is an empty
    payload.  A record without page_id revisits one that has it; rows that repeat the
    largest page_id are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "n_bytes": F.octet_length("payload")})
    groups = rows.where(F.col("n_bytes") >= smallest).groupBy("digest", "n_bytes")
    groups = groups.agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").drop("n")
    rows = rows.join(groups, ["digest", "n_bytes"], "left")
    again = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return rows.select(
        "page_id", "url", "payload", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"),
    )


def name_of(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: bytes, kind: str, refers_to, date: str) -> Iterator[bytes]:
    """One record, in pieces."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    stored = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name_of(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(stored)}"]
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    for at in range(0, len(stored), PIECE):
        yield stored[at : at + PIECE]
    yield b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``with_roles`` rows as .warc.gz, a file for each task; rows (file, n_records).

    Every record is a gzip member.  A task writes under a name of its own attempt, and
    only the files of tasks that ended are in the result (a written table): what a lost
    executor leaves behind is not listed.
    """
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        file, n, out = f"{path}/{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in text_batches(batches, 2):
            for row in batch.to_pylist():
                out = out or store.open_output_stream(file, compression=None)
                gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                for piece in record(**row, date=date):
                    out.write(gz.compress(piece))
                out.write(gz.flush())
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [file], "n_records": pa.array([n], pa.int64())})

    columns = records.select("page_id", "url", "payload", "digest", F.col("record_type").alias("kind"), "refers_to")
    return written(columns.mapInArrow(run, "file string, n_records bigint"), "warc-files")


class Unzipped:
    """Bytes of a file of gzip members, read on as they are asked for."""

    def __init__(self, source, step: int = 256 << 10):
        self.source, self.step, self.held, self.gz = source, step, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.gz.eof:
                data, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            else:
                data = self.gz.unconsumed_tail
            data = data or self.source.read(self.step)
            if not data:
                return False
            got = self.gz.decompress(data, PIECE)
            if got:
                self.held += got
                return True

    def up_to(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is skipped; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def chunks(source, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of one archive, in its order."""
    stream = Unzipped(source)
    while (head := stream.up_to(b"\r\n\r\n")) is not None:
        h = fields(head)
        http = stream.up_to(b"\r\n\r\n")
        left = int(h["content-length"]) - len(http) - 4
        announced = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
        row = {"record_id": h["warc-record-id"], "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "announced": announced}
        if h["warc-type"] == "revisit":
            yield row | {"chunk_no": 0, "data": b"", "sha1": announced, "bytes_so_far": int(fields(http)["content-length"]), "last": True}
        else:
            sha, n, no = hashlib.sha1(), 0, 0
            while no == 0 or left:
                data = stream.take(min(left, chunk_bytes))
                left -= len(data)
                n += len(data)
                sha.update(data)
                yield row | {"chunk_no": no, "data": data, "sha1": sha.hexdigest(), "bytes_so_far": n, "last": not left}
                no += 1
        stream.take(4)


CHUNKS = "file string, record_id string, record_type string, target_uri string, refers_to string, announced string, chunk_no bigint, data binary, sha1 string, bytes_so_far bigint, last boolean"


def read_archives(files: DataFrame, chunk_bytes: int = PIECE) -> DataFrame:
    """Chunk rows of the archives named by ``files`` (file, ...); see ``CHUNKS``.

    ``sha1`` and ``bytes_so_far`` cover the payload up to the end of the chunk, so the row
    with ``last`` has those of the whole payload; an empty payload has one empty chunk.
    A revisit has one row, without data, whose figures are those of its headers.
    A damaged archive raises an error.
    """
    spark: SparkSession = files.sparkSession
    ship(spark)
    names = [c.partition(" ")[0] for c in CHUNKS.split(", ")]
    kinds = {"chunk_no": pa.int64(), "bytes_so_far": pa.int64(), "data": pa.binary(), "last": pa.bool_()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for row in chunks(source, chunk_bytes):
                        rows.append(row | {"file": file})
                        held += len(row["data"]) + 500
                        if held >= 4 * PIECE:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file").repartition(tasks).mapInArrow(run, CHUNKS)


def archived(pages: DataFrame, smallest: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Write all pages and read them back: (files, chunk rows).

    Pages are read twice, payloads are shuffled only if the groups of equal payloads are
    too many to be sent to every task.  An empty table gives no files and no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    files = write_archives(with_roles(pages, smallest), new_dir(spark, "warc"))
    return files, read_archives(files)
