"""Columns that depend on few texts, computed once for every distinct combination of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..session import written

#: Rows, and characters in them, up to which a table of distinct texts is broadcast.
BROADCAST_ROWS, BROADCAST_CHARACTERS = 100_000, 8 << 20


def joined_by_distinct(
    df: DataFrame,
    keys: list[str],
    compute: Callable[[DataFrame], DataFrame],
    most_rows: int = BROADCAST_ROWS,
    most_characters: int = BROADCAST_CHARACTERS,
) -> DataFrame:
    """Add the columns that `compute` adds to a table of the text columns `keys`.

    Every distinct combination is computed once and stored; the rows are joined with it.
    `df` is read twice, so it must give the same rows again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # structs with nulls in them are equal keys, so missing texts find their row
    rows = df.withColumn("__pair", F.struct(*keys))
    # computing is dear and the texts are small, so they are dealt out again
    distinct = rows.select("__pair").distinct().repartition(parts).select("__pair.*")
    found = compute(distinct)
    new = [c for c in found.columns if c not in keys]
    table = written(found.select(F.struct(*keys).alias("__pair"), F.struct(*new).alias("__found")), "pairs")
    length = sum((F.coalesce(F.length(f"__pair.{k}"), F.lit(0)) for k in keys), F.lit(0))
    n, characters = table.agg(F.count(F.lit(1)), F.sum(length)).first()
    few = n <= most_rows and (characters or 0) <= most_characters
    joined = rows.join(F.broadcast(table) if few else table.hint("merge"), "__pair", "left")
    return joined.withColumns({c: F.col(f"__found.{c}") for c in new}).drop("__pair", "__found")
