"""Token sequences written in training order.

Every sequence has a number 0 ... n - 1.  A keyed Feistel permutation of these numbers is
its place in the training order, so the order is random, needs no sort key of its own and
can be computed for any sequence.  Ranges of places are written as shards of fixed-stride
records, which a reader takes one after the other, from any place on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeframe.session import new_dir, written

from .bpe import SPACE
from .common import Scratch, mix64, ship, text_batches, utf8

MAGIC = b"GFSEQ002"
HEADER = "<8sIIQQ"  # magic, bytes of a token, tokens of a sequence, first place, records
HEADER_SIZE = struct.calcsize(HEADER)
RECORD = np.dtype([("doc_id", "<i8"), ("seq_no", "<u4"), ("n_tokens", "<u4")])
NO_ID = 1 << 31  # bit of n_tokens in a record whose doc_id is null
SEQUENCE = "doc_id bigint, seq_no bigint, n_tokens bigint, tokens binary"


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0 ... n - 1 that depends on ``key``, applied to ``numbers``.

    The network permutes the numbers below the next power of four; a result of n or more
    is permuted again until it is below n, which takes less than four turns on average.
    """
    half = np.uint64(max(1, -(-max(1, int(n - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (mix64(right ^ mix64(np.array([key * 64 + r], np.uint64))) & mask)
        moved = left << half | right
        out[todo] = moved
        todo = todo[moved >= np.uint64(n)]
    return out.astype(np.int64)


_ENCODERS: dict = {}


def encoder(ranks: bytes, pattern: str):
    """The encoder of a rank file, kept by the Python worker from task to task."""
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        own = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={})
    return _ENCODERS[key]


#: The library's pattern engine fails on white space much longer than this.
LONG_SPACE = re.compile(f"[{SPACE}]{{10000,}}")


def encoded(library, text: str) -> list[int]:
    """Ids of a text; white space beyond the library's reach is cut out and given to it as one piece.

    As the pattern has it, all of such white space is a piece but for the last character, if
    a word follows, which goes with that.
    """
    ids, at = [], 0
    for run in LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += library.encode_ordinary(text[at : run.start()])
        ids += library._encode_single_piece(text[run.start() : stop])
        at = stop
    return ids + library.encode_ordinary(text[at:]) if at else library.encode_ordinary(text)


def sequences(docs: DataFrame, ranks: bytes, pattern: str, length: int, width: int, end: int | None) -> DataFrame:
    """Documents as token sequences of at most ``length``: part, ordinal and ``SEQUENCE``.

    ``ordinal`` counts the sequences of the task ``part``.  ``end`` is put behind each
    document's ids; a document without ids has just that, or one empty sequence.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, ordinal = encoder(shared.value, pattern), TaskContext.get().partitionId(), 0
        for batch in text_batches(batches, most=4 << 20):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoded(library, utf8(text))
                if end is not None:
                    ids.append(end)
                ids = np.array(ids, f"<u{width}")
                for no, at in enumerate(range(0, max(1, len(ids)), length)):
                    own = ids[at : at + length]
                    rows.append((part, ordinal, doc_id, no, len(own), own.tobytes()))
                    ordinal += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "ordinal", "doc_id", "seq_no", "n_tokens", "tokens"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), docs.text.cast("binary").alias("text"))
    return docs.mapInArrow(run, "part int, ordinal bigint, " + SEQUENCE)


def in_order(rows: DataFrame, key: int) -> tuple[DataFrame, int]:
    """``SEQUENCE`` rows with their place in the training order (slot), and how many there are.

    A sequence's number is its ordinal behind the sequences of all earlier parts; the
    totals of the parts are one small row for each task.
    """
    spark = rows.sparkSession
    ship(spark)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = rows.count()

    @F.pandas_udf("bigint")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), total, key))

    placed = rows.join(F.broadcast(parts), F.col("part") == F.col("p"))
    return placed.select(slot(F.col("before") + F.col("ordinal")).alias("slot"), "doc_id", "seq_no", "n_tokens", "tokens"), total


def write_shards(ordered: DataFrame, total: int, folder: str, length: int, width: int, per_shard: int) -> DataFrame:
    """Write all ``total`` rows as shard files; rows (shard, file, first, n), a written table.

    ``ordered`` is a written table that has each shard in one file, by ``slot``; a task
    streams one of these files.  Shard s has the places from s * per_shard on.  A shard
    gets its name when it is complete, and its contents do not depend on the task that
    writes it, so a task that runs again replaces a shard by the same bytes.
    """
    spark = ordered.sparkSession
    ship(spark)
    stride = RECORD.itemsize + length * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for file in (f for batch in batches for f in batch.column(0).to_pylist()):
            shard, out, n, own, done = None, None, 0, "", []

            def close() -> None:
                out.close()
                store.move(own, f"{path}/shard-{shard:08d}.bin")
                done.append((shard, f"{folder}/shard-{shard:08d}.bin", shard * per_shard, n))

            source, name = fs.FileSystem.from_uri(file)
            with source.open_input_file(name) as data:
                for batch in pq.ParquetFile(data).iter_batches(2048, columns=["slot", "doc_id", "seq_no", "n_tokens", "tokens"]):
                    for slot, doc_id, seq_no, n_tokens, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if slot // per_shard != shard:
                            if out:
                                close()
                            shard, n, own = slot // per_shard, 0, f"{path}/{uuid.uuid4().hex}.part"
                            out = store.open_output_stream(own, compression=None)
                            out.write(struct.pack(HEADER, MAGIC, width, length, shard * per_shard, min(per_shard, total - shard * per_shard)))
                        head = np.array([(0, seq_no, n_tokens | NO_ID) if doc_id is None else (doc_id, seq_no, n_tokens)], RECORD)
                        out.write(head.tobytes() + tokens.ljust(stride - RECORD.itemsize, b"\0"))
                        n += 1
            if out:
                close()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["shard", "file", "first", "n"])

    files = ordered.select("_metadata.file_path").distinct()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return written(files.repartition(tasks).mapInArrow(run, "shard bigint, file string, first bigint, n bigint"), "shard-files")


def read_shards(spark: SparkSession, shards: DataFrame, start: int = 0) -> DataFrame:
    """shard, slot and ``SEQUENCE`` of all records from place ``start`` on.

    A shard's records follow each other in the file; reading on from a place is one seek.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    magic, width, length, first, n = struct.unpack(HEADER, source.read(HEADER_SIZE))
                    if magic != MAGIC:
                        raise ValueError(f"not a shard: {file}")
                    stride = RECORD.itemsize + length * width
                    if source.size() != HEADER_SIZE + n * stride:
                        raise ValueError(f"a shard of another size than it says: {file}")
                    at = max(0, start - first)
                    source.seek(HEADER_SIZE + at * stride)
                    while at < n:
                        count = min(n - at, max(1, (2 << 20) // stride))
                        data = np.frombuffer(source.read(count * stride), np.uint8).reshape(count, stride)
                        head = np.ascontiguousarray(data[:, : RECORD.itemsize]).view(RECORD)[:, 0]
                        n_tokens = (head["n_tokens"] & np.uint32(NO_ID - 1)).astype(np.int64)
                        tokens = [data[i, RECORD.itemsize :].tobytes()[: n_tokens[i] * width] for i in range(count)]
                        ids = pa.array(head["doc_id"].astype(np.int64), mask=(head["n_tokens"] & np.uint32(NO_ID)) != 0)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(count, shard)), pa.array(np.arange(first + at, first + at + count)), ids,
                             pa.array(head["seq_no"].astype(np.int64)), pa.array(n_tokens), pa.array(tokens, pa.binary())],
                            ["shard", "slot", "doc_id", "seq_no", "n_tokens", "tokens"],
                        )
                        at += count

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = shards.where(F.col("first") + F.col("n") > start).select("shard", "file")
    return chosen.repartition(tasks).mapInArrow(run, "shard bigint, slot bigint, " + SEQUENCE)


def materialise(docs: DataFrame, rank_file: str, pattern: str, length: int = 512, end: int | None = None, per_shard: int = 8192, key: int = 2024) -> DataFrame:
    """Write ``docs`` (doc_id, text) in training order; the shards' table (shard, file, first, n).

    ``rank_file`` and ``pattern`` describe the tokenizer; the file, a few MB, is read on
    the driver.  Tokens take two bytes if all ids fit, else four.

    Null and empty texts are documents without ids.  Repeated rows are trained on as often
    as they occur.  A null doc_id is kept as null (a bit beside n_tokens
    in the files), every other one as it is.  An empty table has
    no shards; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        ranks = f.read()
    width = 2 if max(len(ranks.splitlines()), (end or 0) + 1) <= 1 << 16 else 4
    scratch = Scratch(spark, "training")
    rows = scratch.keep(sequences(docs, ranks, pattern, length, width, end), "sequences")
    placed, total = in_order(rows, key)
    # ranges of shards, of a constant width: no sampling job is needed and no shard is cut
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    span = per_shard * -(-shards // tasks)
    ordered = placed.repartition(tasks, F.floor(F.col("slot") / span)).sortWithinPartitions("slot")
    ordered = scratch.keep(ordered, "ordered")
    scratch.drop("sequences")
    files = write_shards(ordered, total, new_dir(spark, "training-shards"), length, width, per_shard)
    scratch.drop("ordered")
    return files
