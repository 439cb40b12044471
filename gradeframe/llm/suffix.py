"""Remove byte strings that also start in an earlier document, by names of 28 and 50 bytes.

All names are polynomial hashes made inside a task: equal strings have equal names, and
the name of 2n bytes is made of the names of its halves, the last step overlapping.  There
are no ranks: ranking pairs of ranks at growing offsets and ranking anew, as prefix
doubling does, would sort every position of a corpus in every round and move twenty times
its size.  Spark sorts in two fixed rounds instead:

1. (name of 28 bytes, document) for one position of about fifteen.  Which position stands
   for a 50-byte string is decided by the string itself, so equal strings choose alike
   wherever they are.  Positions whose name is unique are dropped.  With the name goes
   that of the 22 bytes on either side, which bounds every 50-byte string the position
   stands for: if an earlier document agrees there too, all of them are repeated.
2. (name of 50 bytes, document) for the strings that round 1 could not decide: those at
   the ends of repeated passages.

The first document of a name stays as it is, the others lose those bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mapped, mix64, ship, text_batches

LENGTH = 50  # bytes of a string that must not repeat
START = 28  # bytes of the first round's names
REACH = LENGTH - START  # how far a string reaches beyond its position's name, on either side
SHORT = START % (REACH + 1)  # bytes whose smallest name chooses the position
SEGMENT = 1 << 20
BEYOND = 256  # stands for what lies outside a document
FIRST = mix64(np.arange(1000, 1257, dtype=np.uint64))
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95


def joined(names: np.ndarray, n: int, offset: int) -> np.ndarray:
    """Names of n + offset bytes from those of n bytes: the string's and that ``offset`` on."""
    return names[: len(names) - offset] * np.uint64(pow(BASE, n, 1 << 64)) + names[offset:]


class Names:
    """Names of all strings of some texts, which lie behind each other with gaps.

    By 50-byte string: ``at``, where it starts, ``doc`` and ``byte``, the text and the byte
    there, ``place``, the number of the position that stands for it.  By number of the
    position: ``owner``, its text, ``key``, its 28-byte name, and ``around``, the name of
    its surroundings.
    """

    def __init__(self, pieces: list[tuple[int, bytes, int, int, int]]):
        # a piece: text number, its bytes, offset of these in the text, first and last + 1 string start
        gap = np.full(REACH, BEYOND, np.uint16)
        parts, at, doc, byte, total = [gap], [], [], [], REACH
        for number, data, offset, first, stop in pieces:
            parts += [np.frombuffer(data, np.uint8), gap]
            starts = np.arange(first, stop)
            at.append(starts + (total - offset))
            doc.append(np.full(len(starts), number, np.int32))
            byte.append(starts)
            total += len(data) + REACH
        self.at, self.doc, self.byte = map(np.concatenate, (at, doc, byte))
        n1 = FIRST[np.concatenate(parts, dtype=np.uint16)]
        n4 = joined(joined(n1, 1, 1), 2, 2)
        n16 = joined(joined(n4, 4, 4), 8, 8)
        self.n32 = joined(n16, 16, 16)
        # the smallest short name inside the string chooses; ties go to the first
        low = np.uint64((1 << 24) - 1)
        best = joined(n4, 4, SHORT - 4) * GOLD & ~low
        best |= np.arange(len(best), dtype=np.uint64)
        width, span = 1, LENGTH - SHORT + 1
        while width < span:
            step = min(width, span - width)
            best = np.minimum(best[: len(best) - step], best[step:])
            width += step
        position = (best[self.at] & low).astype(np.int64)
        position = self.at + (position - self.at) % (REACH + 1)
        chosen = np.zeros(total, bool)
        chosen[position] = True
        places = np.flatnonzero(chosen)
        self.place = (np.cumsum(chosen) - 1)[position]
        self.owner = np.empty(len(places), np.int32)
        self.owner[self.place] = self.doc
        start = n16[places] * np.uint64(pow(BASE, 16, 1 << 64)) + n16[places + START - 16]
        self.key = (mix64(start) >> np.uint64(16)).astype(np.int64)
        around = mix64(mix64(self.n32[places - REACH]) + self.n32[places - REACH + 32])
        self.around = mix64(around + self.n32[places + LENGTH - 32]).view(np.int64)

    def long(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names of 64 bits of the chosen 50-byte strings."""
        a, b = self.n32[self.at[strings]], self.n32[self.at[strings] + LENGTH - 32]
        return mix64(mix64(a) + b).view(np.int64), mix64(mix64(b ^ GOLD) + a).view(np.int64)


def of_text(values: np.ndarray, text: np.ndarray | int) -> np.ndarray:
    """Values marked by the text of the batch that they belong to."""
    return mix64(values.view(np.uint64) ^ mix64(np.atleast_1d(text).astype(np.uint64) + np.uint64(1)))


def named(texts: list[bytes]) -> Iterator[Names]:
    """Names of all 50-byte strings of the texts, a bounded number of bytes at a time."""
    pieces, held = [], 0
    for number, data in enumerate(texts):
        last = len(data) - LENGTH + 1
        for first in range(0, last, SEGMENT):
            stop = min(last, first + SEGMENT)
            # bytes beyond the segment that its names can reach; a gap stands only for a text's end
            lo, hi = max(0, first - 2 * REACH), min(len(data), stop + 2 * LENGTH)
            pieces.append((number, data[lo:hi], lo, first, stop))
            held += hi - lo
            if held >= SEGMENT:
                yield Names(pieces)
                pieces, held = [], 0
    if pieces:
        yield Names(pieces)


def positions(docs: DataFrame) -> DataFrame:
    """key, around, id of the chosen positions, each distinct one of a text (segment) once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most=2 << 20):
            ids = np.asarray(batch.column(0))
            for n in named([x.as_py() or b"" for x in batch.column(1)]):
                _, first = np.unique(of_text(n.around, n.owner), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(n.key[first]), pa.array(n.around[first]), pa.array(ids[n.owner[first]])], ["key", "around", "id"])

    return mapped(docs, run, "key bigint, around bigint, id bigint")


def ranked(rows: DataFrame) -> DataFrame:
    """id, around, repeated of positions whose key several rows share.

    Rows come sorted by key, around, id.  ``repeated``: an earlier document has the same
    surroundings.  Otherwise it is the first with them, while the key has others.
    Only one row is held back from batch to batch, however many share a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, around, smallest id of the last run
        waiting = None  # id, around of the last key's first row, while the key has one run
        for batch in batches:
            key, around, id_ = (np.asarray(c) for c in batch.columns)
            if not len(key):
                continue
            new_key = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
            new_run = new_key | np.r_[last is None or around[0] != last[1], around[1:] != around[:-1]]
            firsts, run_no = id_[new_run], np.cumsum(new_run)
            if new_run[0]:
                run_no -= 1
            else:
                firsts = np.r_[last[2], firsts]
            smallest = firsts[run_no]
            repeated = id_ > smallest
            # the first of a run is told if its key has another run, before it or behind it
            key_no = np.cumsum(new_key)  # 0: the last batch's key
            another = new_run & ~new_key
            several = np.zeros(int(key_no[-1]) + 1, bool)
            several[key_no[another]] = True
            told = repeated | another | (new_key & several[key_no])
            out = [id_[told], around[told], repeated[told]]
            if waiting and several[0]:
                out = [np.r_[x, y] for x, y in zip((*waiting, False), out, strict=True)]
                waiting = None
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["id", "around", "repeated"])
            if key_no[-1]:
                i = np.flatnonzero(new_key)[-1]
                waiting = None if several[-1] else (int(id_[i]), int(around[i]))
            last = (key[-1], around[-1], int(smallest[-1]))

    return mapped(rows.repartition("key").sortWithinPartitions("key", "around", "id"), run, "id bigint, around bigint, repeated boolean")


def strings(docs: DataFrame) -> DataFrame:
    """long, more, id: names of the 50-byte strings that the listed positions stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most=2 << 20):
            ids = np.asarray(batch.column(0))
            wanted = [np.asarray(x.values) for x in batch.column(2)]
            marks = np.unique(np.concatenate([of_text(w, i) for i, w in enumerate(wanted)]))
            for n in named([x.as_py() or b"" for x in batch.column(1)]):
                open_ = np.flatnonzero(np.isin(of_text(n.around, n.owner), marks)[n.place])
                (a, b), doc = n.long(open_), n.doc[open_]
                _, first = np.unique(of_text(a, doc), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(ids[doc[first]])], ["long", "more", "id"])

    return mapped(docs, run, "long bigint, more bigint, id bigint")


def later(rows: DataFrame) -> DataFrame:
    """id, long of strings that an earlier document has, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            long, more, id_ = (np.asarray(c) for c in batch.columns)
            if not len(long):
                continue
            new = np.r_[last is None or (long[0], more[0]) != last[:2], (long[1:] != long[:-1]) | (more[1:] != more[:-1])]
            firsts = id_[new]
            number = np.cumsum(new)
            if new[0]:
                number -= 1
            else:
                firsts = np.r_[last[2], firsts]
            head = firsts[number]
            found = id_ > head
            yield pa.RecordBatch.from_arrays([pa.array(id_[found]), pa.array(long[found])], ["id", "long"])
            last = (long[-1], more[-1], int(head[-1]))

    return mapped(rows.repartition("long").sortWithinPartitions("long", "more", "id"), run, "id bigint, long bigint")


def covered(size: int, starts: np.ndarray) -> np.ndarray:
    """Which bytes the 50-byte strings that start at ``starts`` cover."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def whole_characters(data: bytes, off: np.ndarray) -> None:
    """Mark the rest of every UTF-8 character of which ``off`` marks a part.

    Bytes that belong to no character are left as they are.
    """
    for at in (np.flatnonzero(off[1:] != off[:-1]) + 1).tolist():
        lead = at
        while lead > max(0, at - 3) and data[lead] & 0xC0 == 0x80:
            lead -= 1
        stop = lead + (4 if data[lead] >= 0xF0 else 3 if data[lead] >= 0xE0 else 2)
        if lead < at < stop and data[lead] >= 0xC0:
            try:
                data[lead:stop].decode()
            except UnicodeDecodeError:
                continue
            off[lead:stop] = True


def without_repeats(docs: DataFrame, characters: bool = False) -> DataFrame:
    """One row per document: doc (all its columns as a struct), kept (binary: the bytes that
    stay), n_bytes, n_removed, spans (array of removed runs: first byte, bytes).
    ``characters``: a character of which a byte goes, goes whole.

    Null texts are empty; texts below 50 bytes lose nothing.  Repeats inside a document
    are no reason for removal, nor are those of rows with an equal doc_id.  A row without
    doc_id counts as later than all others.  Texts of any length are read whole, in
    segments of bounded size.  An empty table gives no rows; further columns of any name
    and value pass through in ``doc``.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("id")
    texts = docs.select(id_, F.col("text").cast("binary").alias("text"))
    found = scratch.keep(ranked(positions(texts)), "round1")
    open_ = found.where("not repeated").groupBy("id").agg(F.collect_list("around").alias("wanted"))
    second = strings(texts.join(open_, "id").select("id", "text", "wanted"))
    second = scratch.keep(later(second), "round2")
    nothing = F.lit(None).cast("bigint")
    marks = found.select("id", F.when(F.col("repeated"), F.col("around")).alias("around"), F.when(~F.col("repeated"), F.col("around")).alias("open"), nothing.alias("long"))
    marks = marks.unionByName(second.select("id", nothing.alias("around"), nothing.alias("open"), "long"))
    marks = marks.groupBy("id").agg(*[F.collect_list(c).alias(c) for c in ("around", "open", "long")])
    rows = docs.select(id_, F.struct("*").alias("doc")).join(marks, "id", "left")
    rows = rows.select("doc", F.col("doc.text").cast("binary").alias("text"), "around", "open", "long")
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([
        rows.schema["doc"], T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("spans", spans),
    ])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most=2 << 20):
            data = [x.as_py() or b"" for x in batch.column(1)]
            lists = [[np.asarray(x.values) if x.is_valid else np.empty(0, np.int64) for x in batch.column(c)] for c in (2, 3, 4)]
            around, open_, long = (np.unique(np.concatenate([of_text(v, i) for i, v in enumerate(own)])) for own in lists)
            hits: dict[int, list[np.ndarray]] = {i: [] for i in range(len(data)) if len(lists[0][i]) or len(lists[2][i])}
            for n in named([d if i in hits else b"" for i, d in enumerate(data)]):
                places = of_text(n.around, n.owner)
                gone = np.isin(places, around)[n.place]
                unsure = np.flatnonzero(np.isin(places, open_)[n.place])
                gone[unsure] = np.isin(of_text(n.long(unsure)[0], n.doc[unsure]), long)
                at = np.flatnonzero(gone)
                doc, byte = n.doc[at], n.byte[at]
                cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(at) else []
                for i, own in zip(doc[cut].tolist(), np.split(byte, cut[1:]), strict=True) if len(at) else ():
                    hits[i].append(own)
            kept, removed, runs = list(data), [0] * len(data), [[] for _ in data]
            for i, starts in hits.items():
                if starts:
                    off = covered(len(data[i]), np.concatenate(starts))
                    if characters:
                        whole_characters(data[i], off)
                    edge = np.flatnonzero(np.diff(np.r_[False, off, False].astype(np.int8)))
                    runs[i] = [{"first": a, "n": b - a} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    kept[i] = np.frombuffer(data[i], np.uint8)[~off].tobytes()
                    removed[i] = int(off.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array([len(d) for d in data], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, kind)],
                ["doc", "kept", "n_bytes", "n_removed", "spans"],
            )

    return mapped(rows, run, schema)
