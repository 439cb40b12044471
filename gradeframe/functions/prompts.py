"""Prompt building, one rule per benchmark, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed as K
from ..schemas import BENCHMARK_COLUMNS
from .text import ColumnOrName, _c, letter_at

PART_TYPE = "struct<type:string,image:string,min_pixels:int,max_pixels:int,text:string>"
MESSAGES_TYPE = f"array<struct<role:string,content:array<{PART_TYPE}>>>"


def lettered(options: ColumnOrName) -> Column:
    """["x","y"] -> ["(A) x", "(B) y"]."""
    return F.transform(
        _c(options),
        lambda o, i: F.concat(F.lit("("), letter_at(i), F.lit(") "), o),
    )


def mathv_question(question: ColumnOrName, options: ColumnOrName) -> Column:
    """One lettered line per option, each ended by a newline, unless they only say A to E."""
    q, o = _c(question), _c(options)
    lines = F.concat(F.array_join(lettered(o), "\n"), F.lit("\n"))
    spelled_out = F.coalesce(
        (F.size(o) > 0) & (F.array_join(o, "") != K.MATHV_PLACEHOLDER_OPTIONS),
        F.lit(False),
    )
    return F.when(spelled_out, F.concat(q, F.lit("\n"), lines)).otherwise(q)


def mathvista_question(question: ColumnOrName, choices: ColumnOrName) -> Column:
    """A fixed cue and one lettered line per choice, if there are choices."""
    q, c = _c(question), _c(choices)
    with_choices = F.concat(
        q, F.lit(K.MATHVISTA_OPTION_CUE + "\n"), F.array_join(lettered(c), "\n")
    )
    return F.when(F.size(c) > 0, with_choices).otherwise(q)


def olympiad_question(tag: ColumnOrName, context: ColumnOrName, question: ColumnOrName) -> Column:
    """Text-only items put their context in front; items with images do not."""
    q = _c(question)
    text_only = _c(tag).contains("_TO_") & _c(context).isNotNull()
    return F.when(text_only, F.concat(_c(context), F.lit("\n\n"), q)).otherwise(q)


def olympiad_images(tag: ColumnOrName, question: ColumnOrName) -> Column:
    """Image files named by ``<img_N>`` in the question; none for text-only items."""
    names = F.regexp_extract_all(_c(question), F.lit(r"<(img_\d+)>"), 1)
    paths = F.transform(
        names, lambda n: F.concat(F.lit(K.OLYMPIAD_IMAGE_DIR + "/"), n, F.lit(".jpg"))
    )
    return F.when(_c(tag).contains("_TO_"), F.array().cast("array<string>")).otherwise(paths)


def image_path(root: str, dataset: str, file: ColumnOrName) -> Column:
    """Root, the data set's image folder, file; an absolute file path stays as it is."""
    file = _c(file)
    prefix = F.lit(f"{root.rstrip('/')}/{K.IMAGE_DIRS[dataset]}/")
    return F.when(file.startswith("/"), file).otherwise(F.concat(prefix, file))


def _image_part(path: Column, min_pixels: int) -> Column:
    return F.struct(
        F.lit("image").alias("type"),
        path.alias("image"),
        F.lit(min_pixels).alias("min_pixels"),
        F.lit(K.MAX_PIXELS).alias("max_pixels"),
        F.lit(None).cast("string").alias("text"),
    )


def _text_part(text: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit("text").alias("type"),
        none.cast("string").alias("image"),
        none.cast("int").alias("min_pixels"),
        none.cast("int").alias("max_pixels"),
        text.alias("text"),
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_prompt(
    df: DataFrame,
    dataset: ColumnOrName = "dataset",
    system_prompt: str = K.SYSTEM_PROMPT_DEFAULT,
    root: str = K.DEFAULT_ROOT,
) -> DataFrame:
    """Add ``prompt_question``, ``images``, ``messages`` and ``prompt`` to benchmark rows.

    Rows of several benchmarks may be mixed; columns a benchmark lacks may be absent.
    Items with images of the competition benchmark carry no system message.  Rows of
    other data sets, or of none, have their question and no images.
    """
    missing = {
        f"__{c}": F.lit(None).cast(t)
        for c, t in BENCHMARK_COLUMNS.items()
        if c not in df.columns
    }
    present = {f"__{c}": F.col(f"`{c}`") for c in BENCHMARK_COLUMNS if c in df.columns}
    d = _c(dataset)
    keep = df.columns
    df = df.withColumns({**missing, **present, "__ds": d})
    d = F.col("__ds")
    olympiad = d == K.OLYMPIAD
    question = (
        F.when(d == K.MATH_V, mathv_question("__question", "__options"))
        .when(d == K.WE_MATH, F.concat(F.col("__question"), F.lit("\n"), F.col("__option")))
        .when(d == K.MATHVERSE, F.col("__question_for_eval"))
        .when(d == K.MATHVISTA, mathvista_question("__question", "__choices"))
        .when(olympiad, olympiad_question("__from", "__context", "__question"))
        .otherwise(F.col("__question"))
    )
    files = {K.WE_MATH: "__image_path", K.LOGICVISTA: "__imagename"}
    images = F.when(olympiad, olympiad_images("__from", "__question"))
    for name in K.IMAGE_DIRS:
        path = image_path(root, name, files.get(name, "__image"))
        images = images.when(d == name, F.array(path))
    images = F.coalesce(images, F.array().cast("array<string>"))
    df = df.withColumns({"prompt_question": question, "images": images})

    system = _message("system", F.array(_text_part(F.lit(system_prompt))))
    min_pixels = F.when(olympiad, K.OLYMPIAD_MIN_PIXELS).otherwise(K.MIN_PIXELS)
    parts = F.concat(
        F.transform(
            "images",
            lambda p: _image_part(p, K.MIN_PIXELS).withField("min_pixels", min_pixels),
        ).cast(f"array<{PART_TYPE}>"),
        F.array(_text_part(F.col("prompt_question"))).cast(f"array<{PART_TYPE}>"),
    )
    user = _message("user", parts)
    unprompted = olympiad & ~F.col("__from").contains("_TO_")
    messages = F.when(unprompted, F.array(user).cast(MESSAGES_TYPE)).otherwise(
        F.array(system, user).cast(MESSAGES_TYPE)
    )
    df = df.withColumn("messages", messages)
    return df.withColumn("prompt", flat_prompt("messages")).select(
        *(F.col(f"`{c}`") for c in keep if c not in ("prompt_question", "images", "messages", "prompt")),
        "prompt_question",
        "images",
        "messages",
        "prompt",
    )


def flat_prompt(messages: ColumnOrName) -> Column:
    """Messages as one text, ``role: text`` per message, open for the assistant."""
    lines = F.transform(
        _c(messages),
        lambda m: F.concat(
            m["role"],
            F.lit(": "),
            F.array_join(
                F.transform(
                    m["content"],
                    lambda p: F.when(p["type"] == "image", F.lit(K.IMAGE_TOKEN)).otherwise(
                        p["text"]
                    ),
                ),
                "",
            ),
        ),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\nassistant: "))
