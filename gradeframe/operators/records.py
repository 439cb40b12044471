"""Row selection and projection of response and benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

REQUIRED = ("answer", "parsed_answer", "question")


def has_fields(fields: tuple[str, ...] = REQUIRED, raw: str | None = None) -> Column:
    """Are all fields there?

    With `raw`, the JSON text of the row, a key with a null value counts as there;
    on columns alone a NULL is a missing field.
    """
    if raw is not None:
        keys = F.json_object_keys(F.col(raw))
        tests = [F.array_contains(keys, f) for f in fields]
    else:
        tests = [F.col(f).isNotNull() for f in fields]
    condition = tests[0]
    for t in tests[1:]:
        condition = condition & t
    return F.coalesce(condition, F.lit(False))


def with_required_fields(
    df: DataFrame, fields: tuple[str, ...] = REQUIRED, raw: str | None = None
) -> DataFrame:
    return df.filter(has_fields(fields, raw))


def verified(df: DataFrame, flag: str = "verify") -> DataFrame:
    """Rows whose flag is true; NULL (missing, or not a JSON boolean) is not."""
    return df.filter(F.col(flag))


def first_n(df: DataFrame, n: int | None, ordinal: str = "ord") -> DataFrame:
    """The first n rows in file order; all rows for None or 0."""
    return df.orderBy(ordinal).limit(int(n)) if n else df


def truncated_thoughts(df: DataFrame, resp: str = "resp", finish_reason: str = "finish_reason") -> DataFrame:
    return df.filter(T.is_truncated_thought(resp, finish_reason))


def with_image_number(df: DataFrame, image: str = "image", out: str = "image_key") -> DataFrame:
    """Rows whose image is called ``image<N>.<ext>``, with N."""
    return df.withColumn(out, T.image_number(image)).filter(F.col(out).isNotNull())


def trial_records(df: DataFrame) -> DataFrame:
    """The detailed record of each judged trial; missing texts become empty."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    return df.filter("is_kept").select(
        text("question"),
        text("answer"),
        text("parsed_answer"),
        "normalized_answer",
        "normalized_parsed_answer",
        "dataset_type",
        "is_match",
        text("image"),
        "image_key",
    )


def standard_records(df: DataFrame) -> DataFrame:
    return df.select("answer", "parsed_answer", "is_match")


def combine(*tables: DataFrame) -> DataFrame:
    """All rows of several tables; columns only some of them have become NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def matched(df: DataFrame, flag: str = "is_match") -> DataFrame:
    return df.filter(F.col(flag))


def mismatched(df: DataFrame, flag: str = "is_match") -> DataFrame:
    """Everything `matched` leaves out, NULL flags included."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def pair_by_id(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of two tables that belong together; rows without a partner are dropped."""
    return left.join(right, key, "inner")
