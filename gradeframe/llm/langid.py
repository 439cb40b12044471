"""Language identification: scripts narrow the candidates, Viterbi labels the spans.

A word's score for a language is the log-probability of its letter trigrams there.  The
labels of a text's words are the path with the largest sum of scores, where changing the
language costs a penalty; so foreign words inside a text do not change its language, and
longer foreign passages become spans of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, ship, text_batches, utf8

# First code point of each range and the script it belongs to.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})
STARTS = np.array([r for r, _ in RANGES])
SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in RANGES])
WORDS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with a boundary around each, and where each word starts."""
    joined = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(joined == 0)[:-1]
    return joined.astype(np.uint64), starts


def trigrams(code: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each code point but the first and the last."""
    with np.errstate(over="ignore"):
        h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[2:] * np.uint64(0x165667B19E3779F9))
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


def scripts(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of each word's first letter."""
    return SCRIPT_OF[np.searchsorted(STARTS, code[starts + 1].astype(np.int64), side="right") - 1]


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # buckets x langs: log-probabilities
    script: np.ndarray  # scripts x langs: whether the language is written so

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words x langs, best language 0; and which words have a candidate at all."""
        code, starts = letters(words)
        at = trigrams(code)
        inner = code[1:-1] != 0  # a trigram is centred on a letter
        value = np.where(inner[:, None], self.grams[at], np.float32(0))
        total = np.add.reduceat(value, starts, axis=0)
        allowed = self.script[scripts(code, starts)]
        known = allowed.any(axis=1)
        total = np.where(allowed, total, np.float32(-1e9))
        total -= total.max(axis=1, keepdims=True)
        np.maximum(total, np.float32(-12), out=total)  # one odd word is no proof
        total[~known] = 0
        return total, known


def viterbi(score: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts follow each other in ``score`` from ``starts`` on.

    All texts of a batch advance together, one word a step.
    """
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    base, n = starts[:-1][order], n[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t words
    stay = np.empty(score.shape, bool)
    back = np.empty(len(score), np.int8 if score.shape[1] < 128 else np.int32)
    now = np.zeros((len(n), score.shape[1]), np.float32)
    for t in range(steps):
        a = active[t]
        at = base[:a] + t
        v = now[:a]
        best = v.max(axis=1, keepdims=True) - np.float32(penalty)
        stay[at] = v >= best
        back[at] = v.argmax(axis=1)
        np.maximum(v, best, out=v)
        v += score[at]
    label = np.empty(len(score), np.int32)
    current = np.zeros(len(n), np.int32)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        old = active[t + 1] if t + 1 < steps else 0
        current[old:a] = now[old:a].argmax(axis=1)
        at = base[:a] + t
        label[at] = current[:a]
        if t:
            c = current[:a]
            current[:a] = np.where(stay[at, c], c, back[at])
    return label


def fit(docs: DataFrame, sample_per_language: int = 2000, seed: int = 5) -> Model:
    """Learn letter trigrams from labelled rows (doc_id, text, lang); null languages are left out.

    Languages with more rows than ``sample_per_language`` are sampled to about that many,
    by a hash of doc_id.  Counts are added up by Spark; the driver receives at most
    languages x (buckets + scripts) numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    keep = [min(1_000_000, -(-1_000_000 * sample_per_language // sizes[x])) for x in langs]
    chosen = spark.createDataFrame(list(zip(langs, range(len(langs)), keep, strict=True)), "lang string, l int, most bigint")
    rows = rows.join(F.broadcast(chosen), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.col("most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(langs), BUCKETS + len(SCRIPTS)), np.int64)
        for batch in text_batches(batches, most=2 << 20):
            owner = np.asarray(batch.column(0))
            for own in np.unique(owner):
                words = [w for t in batch.column(1).filter(pa.array(owner == own)) for w in WORDS.findall(utf8(t).lower())]
                if words:
                    code, starts = letters(words)
                    totals[own, :BUCKETS] += np.bincount(trigrams(code)[code[1:-1] != 0], minlength=BUCKETS)
                    totals[own, BUCKETS:] += np.bincount(scripts(code, starts), minlength=len(SCRIPTS))
        own, at = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(at, pa.int32()), pa.array(totals[own, at])], ["l", "at", "n"])

    counted = mapped(rows.select("l", F.col("text").cast("binary").alias("text")), count, "l int, at int, n bigint")
    found = counted.groupBy("l", "at").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    totals[found["l"], found["at"]] = found["n"]
    grams = totals[:, :BUCKETS] + 0.1
    grams = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    written = totals[:, BUCKETS:].T
    share = written / np.maximum(1, written.sum(axis=0))
    return Model(langs, np.ascontiguousarray(grams), share >= 0.01)


SCHEMA = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))),
    T.StructField("evidence", T.DoubleType()),
])
SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, carry: tuple[str, ...] = ("doc_id",), batch_bytes: int = 6 << 20) -> DataFrame:
    """One row per document: doc, lang_pred, score, n_words, spans, evidence.

    ``doc``: struct of the columns to ``carry``.
    ``spans``: runs of words (letters only, counted from 0) with one language.
    ``lang_pred``: the language of most letters, ties to the first by name; ``score``: its
    share of the letters, counting as evidence only words in a script that some language
    uses; ``evidence``: the share of the letters that are evidence for any language.  ``und``
    with score and evidence 0 if the text is null, has no letter, or nothing was learned.
    Texts are read whole, in batches of about ``batch_bytes``, or of one text if it is
    longer; a worker's memory grows with them.  Repeated rows are labelled each, an empty table gives no rows;
    only the text decides, other columns may be null and have any name.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.grams, model.script))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in text_batches(batches, most=batch_bytes):
            found = [WORDS.findall(utf8(t).lower()) for t in batch.column(1)]
            starts = np.cumsum([0, *map(len, found)])
            pred, share, spans, evidence = ["und"] * batch.num_rows, np.zeros(batch.num_rows), [[] for _ in found], np.zeros(batch.num_rows)
            flat = [w for words in found for w in words]
            del found
            if flat and own.langs:
                codes, distinct = pd.factorize(np.array(flat, object))
                lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))[codes]
                alpha = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))[codes]
                del flat
                score, known = own.scores(list(distinct))
                label = viterbi(score[codes], starts, penalty)
                sure = lengths * known[codes]
                doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])
                for at, size in zip(cut, np.diff(np.r_[cut, len(label)]), strict=True):
                    spans[doc[at]].append({"lang": own.langs[label[at]], "first_word": at - starts[doc[at]], "n_words": size})
                shape = (batch.num_rows, len(own.langs))
                by = np.bincount(doc * shape[1] + label, lengths * alpha, shape[0] * shape[1]).reshape(shape)
                proof = np.bincount(doc * shape[1] + label, sure * alpha, shape[0] * shape[1]).reshape(shape)
                best = by.argmax(axis=1)
                for i in np.flatnonzero(by.max(axis=1) > 0):
                    pred[i], share[i] = own.langs[best[i]], proof[i, best[i]] / by[i].sum()
                    evidence[i] = proof[i].sum() / by[i].sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(share), pa.array(np.diff(starts)), pa.array(spans, SPANS), pa.array(evidence)],
                ["doc", *SCHEMA.names],
            )

    rows = docs.select(F.struct(*carry).alias("doc"), docs.text.cast("binary").alias("text"))
    return mapped(rows, run, T.StructType([rows.schema["doc"], *SCHEMA.fields]))
