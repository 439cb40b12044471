"""Score result files as they arrive and keep running accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed as K, text as T
from ..functions.equivalence import EqualFn
from ..operators.evaluate import commits_to_label, evaluate_responses
from ..schemas import RESPONSES
from ..session import new_dir
from ..sources.readers import parsed_lines


def stream_responses(
    spark: SparkSession,
    folder: str,
    schema: str = RESPONSES,
    max_files: int | None = None,
    tolerant: bool = False,
) -> DataFrame:
    """New JSON lines files of a folder as a stream, with ``file`` and ``dataset``.

    Lines are read as the batch readers read them: a broken line ends the stream with an
    error, or is dropped if `tolerant`.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(folder).withColumn("file", F.col("_metadata.file_name"))
    rows = parsed_lines(lines, schema, strict=not tolerant, keep=("file",))
    return rows.withColumn("dataset", T.file_stem("file"))


def running_accuracy(
    rows: DataFrame,
    by: Column | str = "dataset",
    system_prompt: str = K.SYSTEM_PROMPT_DEFAULT,
    equal: EqualFn | None = None,
) -> DataFrame:
    """Evaluate rows and aggregate per data set; batch or stream.

    The state is two sums per data set, whatever the number of rows.
    """
    evaluated = evaluate_responses(rows, system_prompt, equal=equal)
    right = F.coalesce(F.col("verify"), F.lit(False))
    return evaluated.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("n_correct"),
        (F.avg(right.cast("int")) * 100).alias("acc"),
    )


def start_running_accuracy(
    totals: DataFrame,
    table_path: str,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Process everything that has arrived, write the totals, stop.

    Restarting with the same `checkpoint` goes on where the last run ended.  Each batch
    writes all totals into a folder of its own, so repeating a batch after a failure
    replaces that folder only, and a reader (`read_totals`) always finds the last
    complete one.
    """
    spark = totals.sparkSession
    checkpoint = checkpoint or new_dir(spark, "stream-checkpoint")

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/totals-{number:012d}")

    return (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )


def start_running_accuracy_by_pair(
    rows: DataFrame,
    table_path: str,
    checkpoint: str | None = None,
    by: str = "dataset",
    system_prompt: str = K.SYSTEM_PROMPT_DEFAULT,
    resp: str = "resp",
    answer: str = "answer",
    equal: EqualFn | None = None,
) -> StreamingQuery:
    """`start_running_accuracy` of `running_accuracy`, for rows that arrive, not totals.

    A batch counts its rows for each distinct label and parsed answer, compares each of
    them once, and adds its sums to the totals of the batch before, which has a folder of its
    own: repeating a batch after a failure starts from the same totals.
    """
    spark = rows.sparkSession
    checkpoint = checkpoint or new_dir(spark, "stream-checkpoint")

    def add(batch: DataFrame, number: int) -> None:
        parsed = batch.withColumn("parsed_answer", T.select_answer(resp, system_prompt))
        pairs = parsed.groupBy(by, answer, "parsed_answer").agg(F.count(F.lit(1)).alias("n"))
        right = commits_to_label(F.col(answer), F.col("parsed_answer"), equal)
        sums = pairs.select(by, "n", F.when(right, F.col("n")).otherwise(0).alias("n_correct"))
        if number:
            earlier = spark.read.parquet(f"{table_path}/totals-{number - 1:012d}")
            sums = sums.unionByName(earlier.select(by, "n", "n_correct"))
        totals = sums.groupBy(by).agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"))
        totals = totals.withColumn("acc", F.col("n_correct") / F.col("n") * 100)
        totals.write.mode("overwrite").parquet(f"{table_path}/totals-{number:012d}")

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
    )


def _last_totals(spark: SparkSession, table_path: str) -> str | None:
    """The last folder of totals that was written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/totals-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ()
    return max((f.getPath().getParent().toString() for f in found), default=None)


def read_totals(spark: SparkSession, table_path: str) -> DataFrame:
    """The totals of the last batch that was written to its end."""
    last = _last_totals(spark, table_path)
    if last is None:
        raise FileNotFoundError(f"no totals in {table_path}")
    return spark.read.parquet(last)


def start_append_scored(
    scored: DataFrame, path: str, checkpoint: str | None = None, format: str = "json"
) -> StreamingQuery:
    """Append scored rows of newly arrived files, each exactly once."""
    checkpoint = checkpoint or new_dir(scored.sparkSession, "stream-checkpoint")
    return (
        scored.writeStream.outputMode("append")
        .format(format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# ------------------------------------------------------------------ worst case of trials
_SUMS = ("n_images", "n_right", "n_complete", "n_complete_right", "n_strict")


def image_changes(judged: DataFrame, by: str = "dataset", image: str = "image", flag: str = "verify", n_trials: int = K.DYNAMATH_TRIALS) -> DataFrame:
    """What every image adds to the sums over images, as its trials arrive; a row per image.

    Sums: images, images with every trial right, images with exactly `n_trials` trials,
    those of them with every trial right, and images with exactly `n_trials` right trials.
    The state is two counts for each image, kept by Spark's own aggregation, so a wrong trial
    that comes late takes back what the image had added.  Trials are added up within each
    task first: an image that holds a third of all rows sends a row per task to its state.
    """
    right = F.coalesce(F.col(flag), F.lit(False))
    counts = judged.groupBy(F.col(by).cast("string").alias(by), T.image_folder_key(image).alias("__key")).agg(
        F.count(F.lit(1)).alias("__trials"), F.count_if(right).alias("__right")
    )
    complete, strict = F.col("__trials") == n_trials, F.col("__right") == n_trials
    parts = (F.lit(True), F.col("__right") == F.col("__trials"), complete, complete & strict, strict)
    return counts.select(by, *[p.cast("bigint").alias(c) for c, p in zip(_SUMS, parts, strict=True)])


def start_worst_case(changes: DataFrame, table_path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process everything that has arrived, write the sums so far, stop.

    A batch adds up all images and writes a folder of its own, a row per group.  The counts of
    the images are in the checkpoint; repeating a batch after a failure starts from them as
    they were, and replaces that folder only.
    """
    spark = changes.sparkSession
    checkpoint = checkpoint or new_dir(spark, "stream-checkpoint")
    by = changes.columns[0]

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(by).agg(*[F.sum(c).alias(c) for c in _SUMS])
        sums.write.mode("overwrite").parquet(f"{table_path}/totals-{number:012d}")

    return (
        changes.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
    )


def worst_case_totals(totals: DataFrame) -> DataFrame:
    """Sums of `start_worst_case` with the shares that the batch metrics give."""
    by = totals.columns[0]
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return totals.select(
        by, "n_images", (share("n_right", "n_images") * 100).alias("acc"),
        F.col("n_complete").alias("qualified_count"), share("n_complete_right", "n_complete").alias("match_ratio"),
        F.col("n_strict").alias("strict_count"),
    )
