"""Byte-level BPE: encode by a queue of merge ranks, decode by joining vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import KEPT, mapped, ship, text_batches, utf8

# White space, and the pattern that cuts text before merging.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# A stretch that the pattern never reads across: its pieces do not depend on its neighbours.
STRETCH = rf"[ \n]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary strings."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Remembered(dict):
    """Answers of ``make``; the older of two generations is forgotten when one is full.

    Keys of more than ``LONGEST`` characters are not remembered, so memory is bounded.
    """

    LONGEST = 200

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Bpe:
    """A tokenizer read from its JSON description (byte-level, no normalizer)."""

    def __init__(self, description: bytes, room: int = 250_000):
        data = json.loads(description)
        pre = data["pre_tokenizer"] or {}
        if data["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without normalizer and prefix space are supported")
        letters = byte_letters()
        vocab = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in data["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words are not supported")
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.strings: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in special.items():
            self.strings[i] = token.encode()
        own = {c: vocab.get(c) for c in letters}
        if None in own.values():
            raise ValueError("the vocabulary lacks single bytes")
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = own[c]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for n, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = n
            self.result.append(vocab[a + b])
        self.special = special
        found = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
        self.numerals = [str(i) for i in range(self.size)]
        self.stretches = re.compile(STRETCH).findall
        self.find = regex.compile(PIECE).findall
        self.pieces = Remembered(self.merge, room)
        self.known = Remembered(self.stretch, room)

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: join the neighbours of lowest rank, leftmost first, until none can be joined.

        Symbols form a doubly linked list; the queue holds (rank, place) as one number.
        Entries whose pair has changed since are skipped when they come up.
        """
        ids = [self.byte_id[b] for b in piece.encode()]
        n, rank = len(ids), self.rank.get
        queue = []
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                queue.append(r << 32 | i)
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, result = heapq.heappop, heapq.heappush, self.result
        while queue:
            top = pop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or rank(ids[i] << 32 | ids[j]) != top >> 32:
                continue
            new = ids[i] = result[top >> 32]
            ids[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                r = rank(new << 32 | ids[j])
                if r is not None:
                    push(queue, r << 32 | i)
            j = before[i]
            if j >= 0:
                r = rank(ids[j] << 32 | new)
                if r is not None:
                    push(queue, r << 32 | j)
        return tuple([x for x in ids if x >= 0])

    def stretch(self, text: str) -> tuple[int, ...]:
        pieces = self.find(text)
        if len(pieces) == 1:
            return self.merge(text)
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        if self.cut is not None and any(s in text for s in self.special):
            ids: list[int] = []
            for n, part in enumerate(self.cut.split(text)):
                ids += [self.special[part]] if n % 2 else self._plain(part)
            return ids
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.stretches(text))))

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def loaded(description: bytes, room: int = 250_000) -> Bpe:
    """One tokenizer per Python worker, kept until a task of another operator."""
    key = f"{hashlib.sha256(description).hexdigest()} {room}"
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Bpe(description, room)
    return KEPT[key]


# from the tokenizer, the ids, the text's bytes and what the ids decode to
OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda b, ids, data, back: ids),
    "n_tokens": (T.LongType(), pa.int64(), lambda b, ids, data, back: len(ids)),
    "ids_sha256": (T.StringType(), pa.string(), lambda b, ids, data, back: hashlib.sha256(",".join(map(b.numerals.__getitem__, ids)).encode()).hexdigest()),
    "decoded": (T.StringType(), pa.string(), lambda b, ids, data, back: back),
    "decoded_sha256": (T.StringType(), pa.string(), lambda b, ids, data, back: hashlib.sha256(back.encode()).hexdigest()),
    "restored": (T.BooleanType(), pa.bool_(), lambda b, ids, data, back: back.encode() == data),
}
DECODING = {"decoded", "decoded_sha256", "restored"}


def encode_documents(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), room: int = 250_000, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id and the chosen ``outputs``.

    A Python worker remembers up to 4 x ``room`` pieces, about 250 bytes each, and keeps
    them after the query; take less room, and smaller batches, where other steps follow.

    ``tokenizer`` is the path of the JSON description, read once on the driver (a file of
    a few MB) and broadcast.  ``decoded`` and ``decoded_sha256`` decode the ids just made;
    ``restored`` says whether that gives the text again, byte for byte.
    Null texts are encoded as empty ones (no ids).  Rows keep their order, repeated rows
    are repeated, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(o, OUTPUTS[o][0]) for o in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decodes = loaded(shared.value, room), not DECODING.isdisjoint(outputs)
        for batch in text_batches(batches, most=batch_bytes):
            rows = [[] for _ in outputs]
            for text in batch.column(1):
                ids = bpe.encode(utf8(text))
                back = bpe.decode(ids) if decodes else None
                for row, o in zip(rows, outputs, strict=True):
                    row.append(OUTPUTS[o][2](bpe, ids, text.as_py() or b"", back))
            arrays = [pa.array(r, OUTPUTS[o][1]) for r, o in zip(rows, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *outputs])

    return mapped(docs.select("doc_id", docs.text.cast("binary").alias("text")), run, schema, keeps=True)


def decode_documents(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ``text`` of rows with ``doc_id`` and ``ids``; null ids give empty text."""
    spark = tokens.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    schema = T.StructType([tokens.schema["doc_id"], T.StructField("text", T.StringType())])
    return tokens.select("doc_id", "ids").mapInArrow(run, schema)
