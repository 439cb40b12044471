"""Align the tokens of two tokenizers over the same text by products of sparse matrices.

Both tokenizers cut the same bytes, so a text gives two incidence matrices with a row for
each token and a column for each byte.  The product of one with the other transposed has an
entry where two tokens overlap, the number of bytes they share.  Columns may as well be
groups, the stretches between byte offsets where both have a token's end; the product of
those incidence matrices links the tokens of a group.

Matrices are compressed rows in numpy, and a row of a product is, as Gustavson has it, the
sum of the other matrix's rows that its entries choose.  All texts of a batch lie behind
each other in one pair of matrices.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Bpe
from .common import Scratch, ship, text_batches

#: Entries a block of rows of a product may have before equal ones are added up.
ROOM = 1 << 20
# The installed library fails on white space of this length; texts with it go to our own encoder.
LONG_SPACE = re.compile(r"\s{10000}")


@dataclass
class Csr:
    """A sparse matrix by rows: row i has the columns ``indices[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def runs(cls, lengths: np.ndarray) -> Csr:
        """Row i has the ``lengths[i]`` columns that follow those of the row before it."""
        starts = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        n = int(starts[-1])
        return cls(starts, np.arange(n), np.ones(n, np.int32), n)

    @classmethod
    def labels(cls, label: np.ndarray, width: int) -> Csr:
        """Row i has the single column ``label[i]``."""
        return cls(np.arange(len(label) + 1), label, np.ones(len(label), np.int32), width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(self.indices, minlength=self.width))]
        return Csr(starts, self.rows()[order], self.values[order], self.height)

    def dot(self, other: Csr) -> Csr:
        """The product, a bounded block of rows at a time (or one row)."""
        sizes = np.diff(other.starts)[self.indices]  # entries that each entry of ours brings in
        reach = np.r_[0, np.cumsum(sizes)][self.starts]
        parts, first = [], 0
        while first < self.height:
            last = max(first + 1, int(np.searchsorted(reach, reach[first] + ROOM, side="right")) - 1)
            parts.append(self._block(other, sizes, first, last))
            first = last
        if not parts:
            return Csr(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), other.width)
        counts, indices, values = (np.concatenate(p) for p in zip(*parts, strict=True))
        return Csr(np.r_[0, np.cumsum(counts)], indices, values, other.width)

    def _block(self, other: Csr, sizes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = self.starts[first], self.starts[last]
        size, chosen = sizes[lo:hi], self.indices[lo:hi]
        ends = np.cumsum(size)
        # entry e of the block is the (e - start)-th of the row that its own entry chooses
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(other.starts[chosen] - (ends - size), size)
        row = np.repeat(np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1])), size)
        column = other.indices[at]
        value = np.repeat(self.values[lo:hi], size) * other.values[at]
        key = row * other.width + column
        if not (key[1:] >= key[:-1]).all():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        sums = np.add.reduceat(value, new) if len(new) else value
        rows, columns = np.divmod(key[new], max(1, other.width))
        return np.bincount(rows, minlength=last - first), columns, sums


class Tokenizers:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, description: bytes, pattern: str, model: bytes):
        import sentencepiece
        import tiktoken

        self.own = Bpe(description, room=20_000)
        special = set(self.own.special.values())
        ranks = {s: i for i, s in enumerate(self.own.strings) if i not in special}
        # ids that grow with the merges are ranks
        if self.own.result != sorted(self.own.result):
            raise ValueError("the vocabulary is not in the order of its merges")
        self.fast = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.pieces.get_piece_size()
        self.strings = (
            self.own.strings,
            [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.pieces.id_to_piece, range(n)))],
        )
        self.sizes = tuple(np.array([len(s) for s in own], np.int64) for own in self.strings)
        # decimal ids by what follows them: another of the group, the group's other side, another group, nothing
        self.decimals = [np.array([f"{i}{mark}" for i in range(max(map(len, self.strings)))], object) for mark in (",", "|", ";", "")]

    def encode(self, texts: list[bytes | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text with a space before it; none where a tokenizer does not give its bytes."""
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        good = []
        for i, data in enumerate(texts):
            try:
                good.append((i, data.decode())) if data else None
            except UnicodeDecodeError:
                continue
        for (i, text), b in zip(good, self.pieces.encode([t for _, t in good], num_threads=1), strict=True):
            text = " " + text
            a = self.own._plain(text) if LONG_SPACE.search(text) else self.fast.encode_ordinary(text)
            data = text.encode()
            if all(b"".join(map(s.__getitem__, ids)) == data for s, ids in zip(self.strings, (a, b), strict=True)):
                out[i] = (a, b)
        return out


_LOADED: dict[str, Tokenizers] = {}


def loaded(description: bytes, pattern: str, model: bytes) -> Tokenizers:
    """The tokenizers of a Python worker, kept from task to task."""
    key = hashlib.sha256(description + pattern.encode() + model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(description, pattern, model)
    return _LOADED[key]


class Aligned:
    """The alignment of a batch of texts; tokens, bytes and groups are numbered over the batch."""

    def __init__(self, t: Tokenizers, ids: list[tuple[list[int], list[int]]]):
        self.tokenizers = t
        self.a, self.b = (np.fromiter((i for own in ids for i in own[side]), np.int64) for side in (0, 1))
        # where the tokens of each text start
        self.a_at, self.b_at = (np.r_[0, np.cumsum([len(own[side]) for own in ids], dtype=np.int64)] for side in (0, 1))
        self.bytes_a, self.bytes_b = Csr.runs(t.sizes[0][self.a]), Csr.runs(t.sizes[1][self.b])
        ends_a, ends_b = self.bytes_a.starts[1:], self.bytes_b.starts[1:]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.groups_a = Csr.labels(np.searchsorted(common, ends_a), len(common))
        self.groups_b = Csr.labels(np.searchsorted(common, ends_b), len(common))
        self.group_at = np.searchsorted(common, self.bytes_a.starts[self.a_at], side="right")
        overlap = self.bytes_a.dot(self.bytes_b.transposed())
        self.link_a, self.link_b, self.shared_bytes = overlap.rows(), overlap.indices, overlap.values
        self.together = ends_a[self.link_a] == ends_b[self.link_b]

    def of_text(self, places: np.ndarray) -> np.ndarray:
        """Bounds of each text in an ascending list of places of A's tokens."""
        return np.searchsorted(places, self.a_at)

    def group_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each group's tokens start in A and B: rows of the transposed group matrices."""
        return self.groups_a.transposed().starts, self.groups_b.transposed().starts

    def group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """B's tokens that share the group of each token of A, as first and last + 1.

        A token has one group, so its row of the product of the group matrices is one row
        of B's transposed matrix, whose columns follow each other.  The bounds of that row
        stand for it, and a group of n tokens costs n, not n * n entries.
        """
        starts = self.groups_b.transposed().starts
        return starts[self.groups_a.indices], starts[self.groups_a.indices + 1]

    def spelled(self) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each text: ids by group."""
        ga, gb = self.groups_a.indices, self.groups_b.indices
        starts_a, starts_b = self.group_bounds()
        words = np.empty(len(ga) + len(gb), object)
        # what follows a token: its side goes on, the other side, another group, or the end of the text
        after_a = (starts_a[ga + 1] == np.arange(len(ga)) + 1).astype(np.int64)
        after_b = np.where(starts_b[gb + 1] == np.arange(len(gb)) + 1, 2, 0)
        after_b[self.b_at[1:][np.diff(self.b_at) > 0] - 1] = 3
        place_a = np.arange(len(ga)) + starts_b[ga]
        place_b = np.arange(len(gb)) + starts_a[gb + 1]
        for place, after, ids in ((place_a, after_a, self.a), (place_b, after_b, self.b)):
            for kind, decimals in enumerate(self.tokenizers.decimals):
                here = after == kind
                words[place[here]] = decimals[ids[here]]
        words, bounds = words.tolist(), (self.a_at + self.b_at).tolist()
        return ["".join(words[x:y]) for x, y in zip(bounds, bounds[1:])]


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def structs(fields: dict[str, tuple[np.ndarray, pa.DataType]], bounds: np.ndarray) -> pa.Array:
    own = pa.StructArray.from_arrays([pa.array(v, k) for v, k in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), own)


def _local(values: np.ndarray, bounds: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Numbers over the batch as numbers inside their text."""
    return values - np.repeat(base[:-1], np.diff(bounds))


def _links(x: Aligned) -> pa.Array:
    at = x.of_text(x.link_a)
    i32 = pa.int32()
    return structs({"a": (_local(x.link_a, at, x.a_at), i32), "b": (_local(x.link_b, at, x.b_at), i32), "bytes": (x.shared_bytes, i32), "together": (x.together, pa.bool_())}, at)


def _groups(x: Aligned) -> pa.Array:
    fields = {}
    for name, starts, base in zip("ab", x.group_bounds(), (x.a_at, x.b_at), strict=True):
        fields[f"{name}_from"] = (_local(starts[:-1], x.group_at, base), pa.int32())
        fields[f"{name}_to"] = (_local(starts[1:], x.group_at, base), pa.int32())
    return structs(fields, x.group_at)


def _group_links(x: Aligned) -> pa.Array:
    first, stop = x.group_links()
    return structs({"b_from": (_local(first, x.a_at, x.b_at), pa.int32()), "b_to": (_local(stop, x.a_at, x.b_at), pa.int32())}, x.a_at)


def _digests(x: Aligned) -> pa.Array:
    return pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.spelled()], pa.string())


def _pair_counts(x: Aligned) -> pa.Array:
    """Id pairs (A's id in the high 32 bits) of links that end together, with their counts."""
    a = x.link_a[x.together]
    pair = x.a[a] << 32 | x.b[x.link_b[x.together]]
    text = np.repeat(np.arange(len(x.a_at) - 1), np.diff(x.of_text(a)))
    order = np.lexsort((pair, text))
    pair, text = pair[order], text[order]
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])]) if len(pair) else np.empty(0, np.int64)
    times = np.diff(np.r_[new, len(pair)])
    return structs({"pair": (pair[new], pa.int64()), "times": (times, pa.int32())}, np.searchsorted(text[new], np.arange(len(x.a_at))))


_LONGS = T.LongType()
# from the alignment of a batch: Spark's type, the column
OUTPUTS = {
    "n_a": (_LONGS, lambda x: pa.array(np.diff(x.a_at))),
    "n_b": (_LONGS, lambda x: pa.array(np.diff(x.b_at))),
    "n_groups": (_LONGS, lambda x: pa.array(np.diff(x.group_at))),
    "n_links": (_LONGS, lambda x: pa.array(np.diff(x.of_text(x.link_a[x.together])))),
    "a_ids": (T.ArrayType(T.IntegerType()), lambda x: lists(x.a, x.a_at, pa.int32())),
    "b_ids": (T.ArrayType(T.IntegerType()), lambda x: lists(x.b, x.b_at, pa.int32())),
    "groups": (T.ArrayType(T.StructType([T.StructField(f, T.IntegerType()) for f in ("a_from", "a_to", "b_from", "b_to")])), _groups),
    "links": (T.ArrayType(T.StructType([*[T.StructField(f, T.IntegerType()) for f in ("a", "b", "bytes")], T.StructField("together", T.BooleanType())])), _links),
    "group_links": (T.ArrayType(T.StructType([T.StructField(f, T.IntegerType()) for f in ("b_from", "b_to")])), _group_links),
    "groups_sha256": (T.StringType(), _digests),
    "pairs": (T.ArrayType(T.StructType([T.StructField("pair", _LONGS), T.StructField("times", T.IntegerType())])), _pair_counts),
}


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, description: str, pattern: str, model: str, outputs: tuple[str, ...] = ("a_ids", "b_ids", "groups", "links", "group_links")) -> DataFrame:
    """doc_id and the chosen ``outputs`` of each document.

    A is the byte-level BPE of the JSON file ``description`` with the pre-tokenizer
    ``pattern``, over a space and the text; B the SentencePiece ``model``, which adds that
    space; both files are a few MB, read on the driver and broadcast.  Special tokens in
    texts are plain text.

    ``groups``: token bounds between the offsets where both have an end; ``links``: pairs of
    tokens that share bytes, how many, and whether they end together; ``group_links``: for
    each token of A the range of B's tokens in its group; ``pairs``: id pairs of the links
    that end together, with counts.

    Null and empty texts, bytes that are no UTF-8, and texts that a tokenizer does not give
    back byte for byte have no tokens.  Repeated rows are repeated, an empty table gives no
    rows, other columns are ignored.  Texts are taken about 1 MB at a time; a longer one is
    a batch of its own and needs about 150 bytes of memory for each of its bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((_read(description), pattern, _read(model)))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(o, OUTPUTS[o][0]) for o in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = loaded(*shared.value)
        for batch in text_batches(batches, most=1 << 20):
            x = Aligned(tokenizers, tokenizers.encode([v.as_py() for v in batch.column(1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[OUTPUTS[o][1](x) for o in outputs]], ["doc_id", *outputs])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def most_pairs(first: list[bytes], second: list[bytes]) -> int:
    """How many id pairs can end together: one token's bytes end with the other's.

    A bound by the vocabularies alone, whatever the corpus.
    """
    def within(long: list[bytes], short: list[bytes], whole: bool) -> int:
        ends: dict[bytes, int] = {}
        for s in short:
            ends[s] = ends.get(s, 0) + 1
        return sum(ends.get(s[i:], 0) for s in long for i in range(0 if whole else 1, len(s)))

    return within(first, second, True) + within(second, first, False)


def link_counts(docs: DataFrame, description: str, pattern: str, model: str) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    ``n_best``: links that end together whose id pair is, in the whole corpus, the most
    frequent of its B id (ties included); ``count_sum``: corpus counts of the pairs of all
    such links, added up.

    Texts are encoded once; what is kept of them are the counts of their own pairs.  The
    corpus counts, added up before the shuffle and behind it, are a table whose size the
    vocabularies bound (``most_pairs``), and go to every task as two arrays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    found = scratch.keep(align(docs, description, pattern, model, ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")), "documents")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a task with their counts; as many as the vocabularies allow at most."""
        pair, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new = batch.column(0).flatten()
            if len(new):
                pair, back = np.unique(np.r_[pair, np.asarray(new.field(0))], return_inverse=True)
                times = np.bincount(back, np.r_[times, np.asarray(new.field(1))], len(pair)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"])

    counts = found.select("pairs").mapInArrow(added, "pair bigint, times bigint")
    counts = scratch.keep(counts.groupBy("pair").agg(F.sum("times").alias("times")), "pairs").toArrow()
    pair, times = (np.asarray(counts.column(c).combine_chunks()) for c in ("pair", "times"))
    order = np.argsort(pair)
    pair, times = pair[order], times[order]
    if len(pair):
        b, at = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
        highest = np.zeros(len(b), np.int64)
        np.maximum.at(highest, at, times)
        best = times == highest[at]
    else:
        best = np.empty(0, bool)
    shared = spark.sparkContext.broadcast((pair, times, best))
    schema = T.StructType([f for f in found.schema if f.name != "pairs"] + [T.StructField("n_best", _LONGS), T.StructField("count_sum", _LONGS)])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, times, best = shared.value
        for batch in batches:
            own = batch.column(batch.num_columns - 1)
            values, bounds = own.flatten(), np.r_[0, np.cumsum(np.asarray(own.value_lengths()))]
            n, at = np.asarray(values.field(1)).astype(np.int64), np.searchsorted(pair, np.asarray(values.field(0)))
            sums = [np.r_[0, np.cumsum(v)][bounds] for v in ((n * best[at], n * times[at]) if len(n) else (n, n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.diff(s)) for s in sums]], schema.names)

    return found.mapInArrow(told, schema)
