"""The three jobs end to end: generate responses, evaluate result files, score rewards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed as K, text as T
from ..functions.choices import choice_match
from ..functions.equivalence import EqualFn, equivalent_or_same, undecided
from ..functions.prompts import build_prompt
from ..operators import generation, metrics, records
from ..operators.evaluate import compared_by_pair, evaluate_responses, trial_match
from ..schemas import RESPONSES
from ..session import written
from ..sources import readers, sinks

JUDGED = (
    "file",
    "is_trial",
    "is_scored",
    "image_key",
    "verify",
    "question",
    "answer",
    "parsed_answer",
    "normalized_answer",
    "normalized_parsed_answer",
    "dataset_type",
    "is_match",
    "image",
)


def _column(df: DataFrame, name: str, type_: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def judge_result_rows(
    df: DataFrame, require_verified: bool = False, equal: EqualFn | None = None, by_pair: bool = False
) -> DataFrame:
    """Judge rows of any mix of result files by the kind of file they come from.

    Needs ``file``.  Rows of repeated-trial files are compared as `judge_trials` does,
    all others as `judge_standard`, in one pass: a row only evaluates its own branch,
    and rows that cannot be judged evaluate neither.  With `by_pair` what neither options
    nor the same text decide is compared once for each distinct pair (`compared_by_pair`).
    """
    trial = F.col("is_trial")
    kept = F.col("image_key").isNotNull()
    if require_verified:
        kept = kept & F.coalesce(F.col("verify"), F.lit(False))
    df = (
        df.withColumns(
            {
                "verify": _column(df, "verify", "boolean"),
                "image": _column(df, "image", "string"),
                "choices": _column(df, "choices", "array<string>"),
                "dataset_type": T.dataset_from_file("file"),
                "is_trial": T.is_trial_file("file"),
            }
        )
        .withColumn("image_key", F.when(trial, T.image_number("image")))
        .withColumn("is_scored", F.when(trial, kept).otherwise(records.has_fields()))
    )
    row_equal = undecided if by_pair else equal
    as_trial = trial_match("answer", "parsed_answer", row_equal)
    as_choice = choice_match(
        "answer", "parsed_answer", "choices", "question", "dataset_type", row_equal
    )
    match = F.when(F.col("is_scored"), F.when(trial, as_trial).otherwise(as_choice))
    fields = ("normalized_answer", "normalized_parsed_answer", "is_match")
    judged = df.withColumn("__match", match).withColumns({f: F.col(f"__match.{f}") for f in fields})
    if by_pair:
        # all rows that need no comparison share one pair of missing texts
        is_open = F.col("is_scored") & F.col("is_match").isNull()
        judged = judged.withColumns(
            {f"__{f}": F.when(is_open, F.col(f)) for f in ("normalized_answer", "normalized_parsed_answer")}
        )
        judged = compared_by_pair(
            judged, "__equal", "__normalized_answer", "__normalized_parsed_answer",
            lambda a, b: equivalent_or_same(a, b, equal),
        ).withColumn("is_match", F.when(F.col("is_scored"), F.coalesce("is_match", "__equal")))
    return judged.select(*JUDGED)


def process_result_files(
    spark: SparkSession,
    folder: str,
    output: str,
    pattern: str = "*.jsonl",
    require_verified: bool = False,
    equal: EqualFn | None = None,
    schema: str = RESPONSES,
) -> DataFrame:
    """Judge every result file of a folder; write the split; return a row per file.

    The judged rows are stored once, narrow, in the shared folder.  Both the split and
    the summary read that table, so no answer is compared twice.
    """
    rows = readers.read_result_files(spark, folder, schema, pattern)
    judged = written(judge_result_rows(rows, require_verified, equal), "judged")
    scored = judged.filter("is_scored")
    sinks.write_split(
        scored.filter(~F.col("is_trial")).select("file", *records.standard_records(scored).columns),
        f"{output}/standard",
        by=["file"],
    )
    detailed = scored.filter("is_trial").withColumn("is_kept", F.lit(True))
    sinks.write_split(
        detailed.select("file", *records.trial_records(detailed).columns),
        f"{output}/trials",
        by=["file"],
    )
    return metrics.percent_texts(
        metrics.file_summary(judged), "match_ratio", "mismatch_ratio", "verify_true_ratio"
    )


def process_result_file(spark: SparkSession, path: str, output: str, **options) -> DataFrame:
    """The same for one file, given by its path."""
    folder, _, name = path.rpartition("/")
    return process_result_files(spark, folder or ".", output, pattern=name, **options)


def evaluate_jsonl(
    spark: SparkSession,
    path: str,
    system_prompt: str = K.SYSTEM_PROMPT_DEFAULT,
    schema: str = RESPONSES,
    equal: EqualFn | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(accuracy, evaluated rows) of a response file; (None, None) if it cannot be read.

    The data set is the file name up to its first dot.  For the repeated-trial benchmark
    the accuracy is the worst case over the trials of an image.
    """
    try:
        rows = readers.read_jsonl(spark, path, schema)
        evaluated = written(evaluate_responses(rows, system_prompt, equal=equal), "evaluated", compression="zstd")
    except PySparkException as e:
        # the file is not there, or a line of it is broken; anything else is no verdict
        if "PATH_NOT_FOUND" in str(e) or "line is not a JSON object" in str(e):
            return None, None
        raise
    name = path.rstrip("/").rpartition("/")[2].partition(".")[0]
    if name == K.DYNAMATH:
        acc = metrics.worst_case_accuracy(evaluated)
    else:
        acc = metrics.accuracy(evaluated)
    acc = acc.select(F.lit(name).alias("dataset"), "acc", T.fixed_decimals("acc", 4).alias("acc_text"))
    return acc, evaluated


def accuracy_per_benchmark(evaluated: DataFrame) -> DataFrame:
    """Dataset / acc: worst case over trials for the repeated-trial benchmark, plain else."""
    trial = F.col("dataset") == K.DYNAMATH
    # One grouping serves both: a plain row is an image of its own only in sum and count.
    images = evaluated.groupBy(
        "dataset", F.when(trial, T.image_folder_key("image")).alias("__key")
    ).agg(
        F.sum(F.coalesce(F.col("verify"), F.lit(False)).cast("int")).alias("__ok"),
        F.count(F.lit(1)).alias("__n"),
    )
    return images.groupBy("dataset").agg(
        F.sum("__n").alias("n"),
        F.when(
            F.col("dataset") == K.DYNAMATH,
            F.avg((F.col("__ok") == F.col("__n")).cast("int")) * 100,
        )
        .otherwise(F.sum("__ok") / F.sum("__n") * 100)
        .alias("acc"),
    )


def generate_and_evaluate(
    benchmarks: DataFrame,
    generate_fn: generation.GenerateFn,
    salvage_fn: generation.GenerateFn,
    output: str | None = None,
    system_prompt: str = K.SYSTEM_PROMPT_DEFAULT,
    root: str = K.DEFAULT_ROOT,
    first_n: int | None = None,
    id: str = "id",
    materialize: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Benchmark rows -> prompts -> responses -> evaluated rows and accuracy table.

    `benchmarks` has ``dataset``, an id that is unique over all of them, ``answer``, and
    ``ord`` if `first_n` is used.  With `output`, rows are appended as JSON lines per
    data set.
    """
    store = materialize or (lambda df: written(df, "generated"))
    rows = records.first_n(benchmarks, first_n)
    prompts = build_prompt(rows, "dataset", system_prompt, root)
    answered = generation.generate_with_salvage(prompts, generate_fn, salvage_fn, store, id)
    evaluated = store(
        evaluate_responses(answered.drop("messages", "prompt"), system_prompt)
    )
    if output:
        (
            evaluated.write.mode("append")
            .options(**sinks.JSON_OPTIONS)
            .partitionBy("dataset")
            .json(output)
        )
    per = accuracy_per_benchmark(evaluated)
    table = per.rollup("dataset").agg(
        F.grouping("dataset").alias("is_mean"), F.avg("acc").alias("acc")
    )
    return evaluated, table.select(
        F.when(F.col("is_mean") == 1, F.lit("Mean")).otherwise(F.col("dataset")).alias("dataset"),
        "acc",
        T.fixed_decimals("acc", 4).alias("acc_text"),
    )
