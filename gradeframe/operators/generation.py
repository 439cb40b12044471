"""Batch generation as a table step, with a second pass for cut-off thoughts.

The model is the caller's: a function over batches of pandas frames that takes
``prompt`` and gives ``resp`` and ``finish_reason``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F, types as P

from ..functions import text as T

GenerateFn = Callable[[Iterator["pandas.DataFrame"]], Iterator["pandas.DataFrame"]]  # noqa: F821


def generate(
    df: DataFrame, fn: GenerateFn, id: str = "id", prompt: str = "prompt"
) -> DataFrame:
    """Run `fn` over (id, prompt); gives id, resp, finish_reason.

    Only the two columns cross into Python, in Arrow batches; `fn` is called once per
    partition, so it can load its model once.
    """
    id_type = df.schema[id].dataType
    schema = P.StructType(
        [
            P.StructField(id, id_type),
            P.StructField("resp", P.StringType()),
            P.StructField("finish_reason", P.StringType()),
        ]
    )
    return df.select(id, F.col(prompt).alias("prompt")).mapInPandas(fn, schema)


def salvage_requests(
    df: DataFrame, id: str = "id", prompt: str = "prompt", resp: str = "resp"
) -> DataFrame:
    """Second-pass prompts for rows cut off inside a thought."""
    return df.filter(T.is_truncated_thought(resp, "finish_reason")).select(
        id, T.salvage_prompt(prompt, resp).alias("prompt")
    )


def with_salvaged(
    df: DataFrame, replies: DataFrame, id: str = "id", resp: str = "resp"
) -> DataFrame:
    """Put second-pass replies behind the partial text; other rows keep their text.

    `replies` has id and resp.  Only cut-off rows can have a reply, and a cut-off row
    without one keeps its closed partial text.  Only cut-off rows are joined; the others
    pass by.  A repeated id among the replies is an error.  Replies grow with the rows, so
    they are never broadcast.
    """
    cut = F.coalesce(T.is_truncated_thought(resp, "finish_reason"), F.lit(False))
    right = replies.groupBy(id).agg(F.count(F.lit(1)).alias("__n"), F.first("resp").alias("__reply"))
    repeated = F.raise_error(F.concat(F.lit("more than one reply for id "), F.col(id).cast("string")))
    right = right.select(id, F.when(F.col("__n") == 1, F.col("__reply")).otherwise(repeated.cast("string")).alias("__reply"))
    text = F.concat(T.salvage_text(resp), F.coalesce(F.col("__reply"), F.lit("")))
    done = df.filter(cut).join(right.hint("merge"), id, "left").withColumn(resp, text).select(*df.columns)
    return df.filter(~cut).unionByName(done)


def generate_with_salvage(
    df: DataFrame,
    fn: GenerateFn,
    salvage_fn: GenerateFn,
    materialize: Callable[[DataFrame], DataFrame],
    id: str = "id",
    prompt: str = "prompt",
) -> DataFrame:
    """Both passes.  `materialize` stores the first pass (see ``session.written``), so
    that the model runs once per row however often the result is read."""
    first = materialize(generate(df, fn, id, prompt))
    cut = first.filter(T.is_truncated_thought("resp", "finish_reason"))
    # only cut-off rows need their prompt again
    again = cut.hint("merge").join(df.select(id, F.col(prompt).alias("prompt")), id)
    second = materialize(generate(salvage_requests(again, id), salvage_fn, id))
    done = with_salvaged(first, second, id).select(id, "resp", "finish_reason")
    return df.join(done.hint("merge"), id, "left")
