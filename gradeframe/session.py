"""Session helpers: settings for scoring jobs, and where intermediate tables go."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings a scoring job should run with.  Shuffle partitions are left to the
# cluster: adaptive execution coalesces small ones and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def held_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for what is planned or run here."""
    old = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session that names none (tests) gets a temporary folder, once.
    """
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.gradeframe.dir", None)
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gradeframe-")
        spark.conf.set("spark.gradeframe.dir", folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(
    df: DataFrame, label: str, partition_by: list[str] | None = None, compression: str | None = None
) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back.

    Cuts the lineage: later jobs read columns of the table, and losing an executor
    costs a re-read rather than a recomputation.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    writer = df.write.mode("errorifexists")
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
