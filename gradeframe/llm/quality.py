"""Repetition rules: characters inside duplicated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import grown, ship, text_batches

# Most percent of word characters inside repeated n-grams, by n.
REPEATED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
# Most percent of repeated lines, and of the characters of lines that are in repeated ones.
LINES, LINE_CHARS = 30, 20
SYMBOLS = b"#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "line_chars", "dup_line_chars", *[f"dup_chars_{n}" for n in REPEATED]]
SCHEMA = [*[(c, T.LongType()) for c in COUNTS], ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), *[(c, T.LongType()) for c in MORE]]


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def covered(windows: np.ndarray, marked: np.ndarray, n: int) -> np.ndarray:
    """Words inside marked n-word windows."""
    edge = np.zeros(len(windows) + n, np.int32)
    edge[: len(windows)] += marked
    edge[n:] -= marked
    return np.cumsum(edge)[:-1] > 0


def repeats(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows occur twice or more, and which equal an earlier one."""
    _, first, inverse, count = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
    return count[inverse] > 1, first[inverse] != np.arange(len(windows))


def measure(data: bytes, words: list[bytes], hashes: np.ndarray, repeated: bool) -> dict:
    """All counts of one text.  ``repeated``: whether some 5-word window occurs twice."""
    n = len(words)
    out = {"n_words": n, "n_symbols": len(data) - len(data.translate(None, SYMBOLS))}
    spaces = len(data) - sum(map(len, words))
    out["word_chars"] = code_points(data) - spaces
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    again = []
    with_word = [x for x in lines if x.strip()]
    if len(set(with_word)) < len(with_word):
        for x in with_word:
            if x in seen:
                again.append(x)
            seen.add(x)
    out |= {"n_lines": len(with_word), "n_dup_lines": len(again)}
    out["line_chars"] = code_points(b"".join(with_word))
    out["dup_line_chars"] = code_points(b"".join(again))
    out |= {"n_repeat_words": 0} | {f"dup_chars_{k}": 0 for k in REPEATED}
    if repeated:
        lengths = np.fromiter(map(code_points, words), np.int64, n)
        windows = None
        for k in REPEATED:
            windows = grown(hashes, k, windows)
            if not len(windows):
                break
            twice, later = repeats(windows)
            if not later.any():  # no longer window can be repeated either
                break
            if k == 5:
                out["n_repeat_words"] = int(covered(windows, twice, k).sum())
            out[f"dup_chars_{k}"] = int(lengths[covered(windows, later, k)].sum())
    out["base_failed"] = n < 10 or 100 * out["n_repeat_words"] > 20 * n
    out["kept"] = not (
        out["base_failed"]
        or any(100 * out[f"dup_chars_{k}"] > most * out["word_chars"] for k, most in REPEATED.items())
        or 100 * out["n_dup_lines"] > LINES * out["n_lines"]
        or 100 * out["dup_line_chars"] > LINE_CHARS * out["line_chars"]
    )
    return out


def repeated_documents(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For texts whose word hashes follow each other: which have a 5-word window twice."""
    n = np.diff(starts)
    windows = grown(hashes, 5)
    if not len(windows):
        return np.zeros(len(n), bool)
    owner = np.repeat(np.arange(len(n)), n)
    inside = owner[: len(windows)] == owner[4:]
    keys = (windows ^ (owner[: len(windows)].astype(np.uint64) * BASE))[inside]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    found = np.zeros(len(n), bool)
    if len(twice):
        found[owner[: len(windows)][inside][np.isin(keys, twice)]] = True
    return found


def repetition(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, both verdicts, repeated characters.

    ``dup_chars_n``: characters of words inside an n-word window that equals an earlier
    window of the text; ``dup_line_chars``: characters of lines that equal an earlier one.
    A text is kept if the base rules hold, and no share exceeds its limit.

    Null and empty texts have no words and fail.  A text of any length is read whole;
    memory is in proportion to the longest text.  Repeated rows are judged each, an empty
    table gives no rows, other columns are ignored.
    """
    ship(docs.sparkSession)
    names = [c for c, _ in SCHEMA]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, t) for c, t in SCHEMA]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most=2 << 20):
            texts = [x.as_py() or b"" for x in batch.column(1)]
            words = [x.split() for x in texts]  # ASCII white space
            starts = np.cumsum([0, *map(len, words)])
            hashes = np.empty(starts[-1], np.uint64)
            for i, w in enumerate(words):
                hashes[starts[i] : starts[i + 1]] = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
            again = repeated_documents(hashes, starts)
            rows = [measure(texts[i], w, hashes[starts[i] : starts[i + 1]], again[i]) for i, w in enumerate(words)]
            arrays = [pa.array([r[c] for r in rows], pa.bool_() if t == T.BooleanType() else pa.int64()) for c, t in SCHEMA]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    return docs.select("doc_id", docs.text.cast("binary").alias("text")).mapInArrow(run, schema)
