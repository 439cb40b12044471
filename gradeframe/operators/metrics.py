"""Accuracy aggregates.

Each is a plain grouping (or two nested ones) over narrow columns, so Spark combines
rows before it shuffles: a data set or image that holds a third of all rows costs one
partial row per task, not one big group.  `by` lists extra grouping columns, such as
the file or the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K, text as T


def _flag(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def _percent(x: Column) -> Column:
    return F.coalesce(x * 100, F.lit(0.0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, by: list[str] = (), flag: str = "verify") -> DataFrame:
    """Percentage of right rows per group; 0 for no rows."""
    right = _flag(flag)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("n_correct"),
        _percent(F.avg(right.cast("int"))).alias("acc"),
    )


def worst_case_accuracy(
    df: DataFrame, by: list[str] = (), image: str = "image", flag: str = "verify"
) -> DataFrame:
    """Percentage of images all of whose trials are right.

    Images are told apart by the last two segments of their path.
    """
    by = list(by)
    images = (
        df.select(*by, T.image_folder_key(image).alias("__key"), _flag(flag).cast("int").alias("__ok"))
        .groupBy(*by, "__key")
        .agg(F.min("__ok").alias("__ok"))
    )
    return images.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_images"),
        _percent(F.avg("__ok")).alias("acc"),
    )


def strict_trials(
    df: DataFrame,
    by: list[str] = (),
    image: str = "image",
    flag: str = "verify",
    n_trials: int = K.DYNAMATH_TRIALS,
    total: int = K.DYNAMATH_IMAGES,
) -> DataFrame:
    """Images with exactly `n_trials` verified rows, out of a fixed total.

    A group whose rows all fall out still has a row, with 0.
    """
    by = list(by)
    images = (
        df.select(*by, T.image_number(image).alias("__key"), _flag(flag).alias("__ok"))
        .groupBy(*by, "__key")
        .agg(F.count_if("__ok").alias("__n"))
    )
    qualified = F.count_if(F.col("__key").isNotNull() & (F.col("__n") == n_trials))
    share = qualified / F.lit(total) if total else F.lit(0.0)
    return images.groupBy(*by).agg(
        qualified.alias("qualified_count"), share.cast("double").alias("acc")
    )


def trial_summary(
    df: DataFrame,
    by: list[str] = (),
    n_trials: int = K.DYNAMATH_TRIALS,
    total: int = K.DYNAMATH_IMAGES,
) -> DataFrame:
    """All figures of a repeated-trial table, in one pass.

    Reads ``judge_trials`` output.  Qualified images have exactly `n_trials` kept
    rows; the match ratio is the share of them with every trial matched, and the
    verified ratio is that of `strict_trials`.
    """
    by = list(by)
    kept, match = F.col("is_kept"), _flag("is_match")
    images = df.groupBy(*by, "image_key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(kept).alias("kept"),
        F.count_if(kept & match).alias("match"),
        F.count_if(_flag("verify")).alias("verified"),
    )
    known = F.col("image_key").isNotNull()
    qualified = F.count_if(known & (F.col("kept") == n_trials))
    all_match = F.count_if(
        known & (F.col("kept") == n_trials) & (F.col("match") == n_trials)
    )
    strict = F.count_if(known & (F.col("verified") == n_trials))
    sums = images.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_file_records"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("verified"), F.lit(0)).alias("verify_true_records"),
        F.coalesce(F.sum("match"), F.lit(0)).alias("match_count"),
        qualified.alias("qualified_count"),
        all_match.alias("match_qualified_images"),
        strict.alias("verify_qualified_images"),
    )
    return sums.withColumns(
        {
            "mismatch_count": F.col("total_records") - F.col("match_count"),
            "match_ratio": _ratio(F.col("match_qualified_images"), F.col("qualified_count")),
            "verify_true_ratio": F.col("verify_qualified_images") / F.lit(total)
            if total
            else F.lit(0.0),
        }
    )


def standard_summary(df: DataFrame, by: list[str] = (), scored: str | None = None) -> DataFrame:
    """Matched share of *all* loaded rows, rows without the needed fields included.

    `scored` names a boolean column that marks rows which could be judged; without it
    every row counts as judged.
    """
    usable = F.col(scored) if scored else F.lit(True)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(usable).alias("n_scored"),
        F.count_if(usable & _flag("is_match")).alias("match_count"),
    )
    return sums.withColumns(
        {
            "mismatch_count": F.col("n_scored") - F.col("match_count"),
            "match_ratio": _ratio(F.col("match_count"), F.col("total_records")),
        }
    )


def file_summary(df: DataFrame, by: list[str] = ("file",)) -> DataFrame:
    """One uniform row per file, for both kinds of result file.

    Reads rows with ``is_trial``, ``is_scored``, ``is_match``, ``verify`` and
    ``image_key``.  The match ratio of a trial file is that of `trial_summary`, of any
    other file that of `standard_summary`.
    """
    by = list(by)
    scored, match = F.col("is_scored"), _flag("is_match")
    # Rows of other files do not have an image key, so they form one group per file.
    images = df.groupBy(*by, "is_trial", "image_key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(scored).alias("scored"),
        F.count_if(scored & match).alias("match"),
        F.count_if(_flag("verify")).alias("verified"),
    )
    n = K.DYNAMATH_TRIALS
    known = F.col("is_trial") & F.col("image_key").isNotNull()
    full = known & (F.col("scored") == n)
    sums = images.groupBy(*by, "is_trial").agg(
        F.sum("rows").alias("total_records"),
        F.sum("scored").alias("n_scored"),
        F.sum("verified").alias("verify_true_count"),
        F.sum("match").alias("match_count"),
        F.count_if(full).alias("qualified_count"),
        F.count_if(full & (F.col("match") == n)).alias("match_qualified_images"),
        F.count_if(known & (F.col("verified") == n)).alias("__strict"),
    )
    trial = F.col("is_trial")
    match_ratio = F.when(
        trial, _ratio(F.col("match_qualified_images"), F.col("qualified_count"))
    ).otherwise(_ratio(F.col("match_count"), F.col("total_records")))
    out = sums.withColumns(
        {
            "mismatch_count": F.col("n_scored") - F.col("match_count"),
            "match_ratio": match_ratio,
            "mismatch_ratio": 1 - match_ratio,
            "verify_true_ratio": F.when(
                trial, F.col("__strict") / F.lit(K.DYNAMATH_IMAGES)
            ).otherwise(_ratio(F.col("verify_true_count"), F.col("total_records"))),
            "type": F.when(trial, K.DYNAMATH).otherwise("Standard"),
        }
    )
    return out.drop("__strict", "is_trial")


def percent_texts(df: DataFrame, *ratios: str) -> DataFrame:
    """Add ``<ratio>_text``, the ratio as a percentage with two decimals."""
    return df.withColumns({f"{r}_text": T.fixed_decimals(F.col(r) * 100, 2) for r in ratios})


def cross_file_summary(df: DataFrame, file: str = "file", flag: str = "is_match") -> DataFrame:
    """Counts per file and, with a NULL file, over all files.

    The total is a grouping set over the per-file rows, so that input rows are neither
    read nor expanded twice.
    """
    counts = ("total_records", "match_count", "verify_true_count")
    per = df.groupBy(file).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(_flag(flag)).alias("match_count"),
        F.count_if(_flag("verify")).alias("verify_true_count"),
    )
    return per.groupingSets([[F.col(file)], []], F.col(file)).agg(
        *(F.sum(c).alias(c) for c in counts)
    )


def sharded_accuracy(
    df: DataFrame,
    by: list[str] = (),
    ordinal: str = "ord",
    flag: str = "verify",
    batch_size: int = K.SAVE_BATCH,
    n_shards: int = 8,
    worst_case_image: str | None = None,
    total: Column | None = None,
) -> DataFrame:
    """Accuracy as averaged over shards of batches, weighted by batch size.

    Rows are cut into batches of `batch_size` by their dense ordinal from 0 (within a
    group, if there is `by`), a batch
    into `n_shards` runs of equal length (the last may be short).  A batch counts the
    plain mean of its shards.  With `worst_case_image` a shard's accuracy is the share
    of its images that are right in every trial.

    Batch and shard are arithmetic on the ordinal, so no window is needed; only the
    length of the last batch depends on the row count.  Without `by` the count may be given
    as `total`, where another table tells it without judging the rows.
    """
    by = list(by)
    rows = df.select(
        *by,
        F.floor(F.col(ordinal) / batch_size).cast("bigint").alias("__batch"),
        (F.col(ordinal) % batch_size).alias("__pos"),
        _flag(flag).cast("int").alias("__ok"),
        *([T.image_folder_key(worst_case_image).alias("__key")] if worst_case_image else []),
    )
    if by:
        # one total per group, as few rows as the result has: broadcast, as a join by group
        # would sort all rows of a group in one task
        totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__total"))
        rows = rows.join(F.broadcast(totals), by)
        length = F.least(F.lit(batch_size), F.col("__total") - F.col("__batch") * batch_size)
    else:
        total = df.agg(F.count(F.lit(1)).alias("__total")).scalar() if total is None else total
        length = F.least(F.lit(batch_size), total - F.col("__batch") * batch_size)
    per_shard = F.ceil(length / n_shards)
    rows = rows.withColumn("__shard", F.floor(F.col("__pos") / per_shard).cast("int"))
    keys = [*by, "__batch", "__shard"]
    if worst_case_image:
        shards = (
            rows.groupBy(*keys, "__key")
            .agg(F.min("__ok").alias("__ok"), F.count(F.lit(1)).alias("__n"))
            .groupBy(*keys)
            .agg(F.avg("__ok").alias("__acc"), F.sum("__n").alias("__n"))
        )
    else:
        shards = rows.groupBy(*keys).agg(
            F.avg("__ok").alias("__acc"), F.count(F.lit(1)).alias("__n")
        )
    batches = shards.groupBy(*by, "__batch").agg(
        F.avg("__acc").alias("__acc"), F.sum("__n").alias("__n")
    )
    return batches.groupBy(*by).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("n_batches"),
        _percent(F.sum(F.col("__acc") * F.col("__n")) / F.sum("__n")).alias("acc"),
    )


def mean_accuracy(df: DataFrame, dataset: str = "dataset", flag: str = "verify") -> DataFrame:
    """Mean over data sets (macro) and over rows (micro)."""
    per = accuracy(df, [dataset], flag)
    return per.agg(
        F.count(F.lit(1)).alias("n_datasets"),
        _percent(F.avg(F.col("acc") / 100)).alias("macro_acc"),
        _percent(F.sum("n_correct") / F.sum("n")).alias("micro_acc"),
    )


def accuracy_table(df: DataFrame, dataset: str = "dataset", flag: str = "verify") -> DataFrame:
    """Dataset / Acc with a final Mean row, four decimals as text beside the number.

    The mean row is a rollup of the per-data-set rows, so the input is read once.
    """
    per = accuracy(df, [dataset], flag)
    table = per.rollup(dataset).agg(
        F.grouping(dataset).alias("is_mean"), F.avg("acc").alias("acc")
    )
    return table.select(
        F.when(F.col("is_mean") == 1, F.lit("Mean")).otherwise(F.col(dataset)).alias("dataset"),
        "acc",
        T.fixed_decimals("acc", 4).alias("acc_text"),
    )


def group_counts(df: DataFrame, key: str = "image_key", n: int = 10) -> DataFrame:
    """Rows per key, for the first `n` keys in order."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(key)
        .limit(n)
    )
