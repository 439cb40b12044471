"""Judged rewards as tables: write the requests out, join the answers back in.

The judge model runs elsewhere.  A request table holds one row per eligible
completion; a response table holds ``id`` and ``judge_resp``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed as K, text as T
from ..functions.rewards import score


def thinking_requests(
    df: DataFrame,
    id: str = "id",
    completion: str = "completion",
    question: str = "question",
    image: str = "image",
) -> DataFrame:
    """Requests to judge the reasoning of completions with exactly one think block."""
    return (
        df.withColumn("__think", T.think_body(completion))
        .filter(F.col("__think").isNotNull())
        .select(
            F.col(id).alias("id"),
            F.lit(K.JUDGE_SYSTEM_PROMPT).alias("system"),
            T.thinking_judge_prompt(question, T.strip("__think")).alias("user"),
            F.col(image).alias("image"),
            T.file_extension(image).alias("image_format"),
        )
    )


def caption_requests(
    df: DataFrame, id: str = "id", completion: str = "completion", question: str = "question"
) -> DataFrame:
    """Requests to answer the question from the completion's text alone."""
    return df.select(
        F.col(id).alias("id"),
        T.caption_judge_prompt(completion, question).alias("user"),
    )


def with_images(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Attach base64 image contents (see ``sources.read_images``) by path."""
    return requests.join(
        images.select(F.col("path").alias("image"), "image_base64"), "image", "left"
    )


def one_per_id(responses: DataFrame, sequence: str | None = None) -> DataFrame:
    """id, judge_resp: of responses with the same id the one with the largest `sequence`.

    Without a sequence column a repeated id is an error.
    """
    if sequence:
        return responses.groupBy("id").agg(F.max_by("judge_resp", sequence).alias("judge_resp"))
    found = responses.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("judge_resp").alias("judge_resp"))
    repeated = F.raise_error(F.concat(F.lit("more than one response for id "), F.col("id").cast("string")))
    return found.select("id", F.when(F.col("n") == 1, F.col("judge_resp")).otherwise(repeated.cast("string")).alias("judge_resp"))


def with_responses(
    df: DataFrame, responses: DataFrame, id: str = "id", out: str = "judge_resp", sequence: str | None = None
) -> DataFrame:
    """Join judge responses by id; a row without a response keeps NULL.

    Responses grow with the rows and their size is often estimated too small, so they are
    never broadcast.
    """
    right = one_per_id(responses, sequence).select(F.col("id").alias(id), F.col("judge_resp").alias(out))
    return df.join(right.hint("merge"), id, "left")


def score_judged(
    df: DataFrame,
    names: list[str],
    id: str = "id",
    thinking: DataFrame | None = None,
    caption: DataFrame | None = None,
    sequence: str | None = None,
    **options,
) -> DataFrame:
    """Score rewards that read judges' answers; no response gives 0.

    ``thinking`` and ``caption`` are the response tables of the two judges.  What a reward
    needs of a judge's text is its last box, and of a completion its features, so both are
    taken before the join: no judge text is shuffled, and a completion only if the caller
    selects it.
    """
    joins = []
    given = {}
    for column, responses in (("thinking_verdict", thinking), ("caption_answer", caption)):
        if responses is not None:
            boxes = responses.withColumn("judge_resp", F.try_element_at(T.boxed_all("judge_resp"), F.lit(-1)))
            boxes = one_per_id(boxes, sequence).select(F.col("id").alias(id), F.col("judge_resp").alias(f"__{column}"))
            joins.append(boxes)
            given[column] = f"__{column}"

    def join(rows: DataFrame) -> DataFrame:
        for boxes in joins:
            rows = rows.join(boxes.hint("merge"), id, "left")
        return rows

    return score(df, names, join=join, **given, **options)
