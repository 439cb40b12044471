"""Extract answers, compare them with the label, add the verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K, pairs, text as T
from ..functions.choices import with_choice_match
from ..functions.equivalence import (
    EqualFn,
    _bind,
    equivalent,
    equivalent_or_same,
    final_answer,
    same_text,
)


def with_equal(
    df: DataFrame, out: str, a: str, b: str, equal: EqualFn | None = None
) -> DataFrame:
    """Add `out`: are the answers in columns `a` and `b` equal, or the same text?"""
    return df.withColumn(out, equivalent_or_same(a, b, equal))


#: Pairs, and characters in them, up to which a table of pairs is broadcast.
BROADCAST_PAIRS, BROADCAST_CHARACTERS = pairs.BROADCAST_ROWS, pairs.BROADCAST_CHARACTERS


def with_equal_by_pair(
    df: DataFrame, out: str, a: str, b: str, equal: EqualFn | None = None
) -> DataFrame:
    """The same as `with_equal`, where many rows hold the same two answers."""
    return compared_by_pair(df, out, a, b, lambda x, y: equivalent_or_same(x, y, equal))


def compared_by_pair(
    df: DataFrame, out: str, a: str, b: str, compare: Callable[[Column, Column], Column]
) -> DataFrame:
    """Add `out`: what `compare` says of columns `a` and `b`.

    Every distinct pair is compared once and stored; the rows are joined with it.  `df` is
    read twice, so it must give the same rows again.
    """
    rows = df.withColumns({"__a": F.col(a), "__b": F.col(b)})
    found = pairs.joined_by_distinct(
        rows, ["__a", "__b"], lambda d: d.withColumn("__verdict", compare(F.col("__a"), F.col("__b"))),
        BROADCAST_PAIRS, BROADCAST_CHARACTERS,
    )
    return found.withColumn(out, F.col("__verdict")).drop("__a", "__b", "__verdict")


def evaluate_responses(
    df: DataFrame,
    system_prompt: str = K.SYSTEM_PROMPT_DEFAULT,
    resp: str = "resp",
    answer: str = "answer",
    equal: EqualFn | None = None,
) -> DataFrame:
    """Add ``parsed_answer`` and ``verify`` to response rows.

    The parsed answer is what the response commits to.  It is right if it is the
    label as text, or equal to it as an answer; a whole response standing in for a
    missing answer is searched for its final answer first.
    """
    right = commits_to_label(F.col(answer), F.col("parsed_answer"), equal)
    return df.withColumn("parsed_answer", T.select_answer(resp, system_prompt)).withColumn("verify", right)


def commits_to_label(label: Column, parsed: Column, equal: EqualFn | None = None) -> Column:
    """Is what a response commits to the label?  Never NULL."""
    wrapped = parsed.startswith("$") & parsed.endswith("$") & (F.length(parsed) >= 2)
    candidate = F.when(wrapped, parsed).otherwise(_bind(parsed, lambda t: final_answer(t)))
    same = same_text(T.wrap_math(label), parsed)
    return same | F.coalesce((equal or equivalent)(label, candidate), F.lit(False))


def evaluate_responses_by_pair(
    df: DataFrame,
    system_prompt: str = K.SYSTEM_PROMPT_DEFAULT,
    resp: str = "resp",
    answer: str = "answer",
    equal: EqualFn | None = None,
) -> DataFrame:
    """The same as `evaluate_responses`, where many responses commit to the same answer.

    Every distinct pair of label and parsed answer is compared once (`compared_by_pair`).
    """
    parsed = df.withColumn("parsed_answer", T.select_answer(resp, system_prompt))
    return compared_by_pair(
        parsed, "verify", answer, "parsed_answer", lambda label, given: commits_to_label(label, given, equal)
    )


def judge_standard(df: DataFrame, dataset: Column | str = "dataset", equal: EqualFn | None = None) -> DataFrame:
    """Verdict per row of a standard result table, by options where there are any."""
    choices = "choices" if "choices" in df.columns else None
    return with_choice_match(df, "answer", "parsed_answer", choices, "question", dataset, equal)


def trial_match(answer: str, model_answer: str, equal: EqualFn | None = None) -> Column:
    """struct<normalized_answer, normalized_parsed_answer, is_match> of one trial.

    Both answers are wrapped in ``$`` before they are compared; missing ones are empty.
    """
    blank = F.lit("")
    pair = F.struct(
        T.wrap_math(F.coalesce(answer, blank)).alias("a"),
        T.wrap_math(F.coalesce(model_answer, blank)).alias("m"),
    )
    return _bind(
        pair,
        lambda p: F.struct(
            p["a"].alias("normalized_answer"),
            p["m"].alias("normalized_parsed_answer"),
            equivalent_or_same(p["a"], p["m"], equal).alias("is_match"),
        ),
    )


def judge_trials(
    df: DataFrame, require_verified: bool = False, equal: EqualFn | None = None
) -> DataFrame:
    """Verdict per trial of a repeated-trial result table.

    ``is_kept`` marks the rows that count as trials: they have an image number and,
    with `require_verified`, a true flag.  Other rows stay, without a verdict, for
    the totals.
    """
    kept = F.col("image_key").isNotNull()
    if require_verified:
        kept = kept & F.coalesce(F.col("verify"), F.lit(False))
    fields = ("normalized_answer", "normalized_parsed_answer", "is_match")
    df = df.withColumn("image_key", T.image_number("image")).withColumns(
        {"is_kept": kept, "dataset_type": F.lit(K.DYNAMATH)}
    )
    match = F.when(F.col("is_kept"), trial_match("answer", "parsed_answer", equal))
    return (
        df.withColumn("__match", match)
        .withColumns({f: F.col(f"__match.{f}") for f in fields})
        .drop("__match")
    )
