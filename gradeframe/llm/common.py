"""What several corpus operators share: tables, prefix sums, batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeframe.session import new_dir, written

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would; once a context."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(top)))
    version = hashlib.sha256(held.getvalue()).hexdigest()[:16]
    key = (spark.sparkContext.applicationId, version)
    if key not in _SHIPPED:
        path = os.path.join(tempfile.mkdtemp(prefix="gradeframe-"), f"gradeframe-{version}.zip")
        with open(path, "wb") as f:
            f.write(held.getvalue())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(key)


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run here remove their shuffle files when they have ended.

    The result is a written table by then, so nothing would read them again.
    """
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old) if old is not None else spark.conf.unset(CLEANUP)


class Scratch:
    """Written intermediate tables of one operator call, which can be dropped early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = new_dir(self.spark, f"{self.label}-{name}")
        writer = df.write.option("compression", "zstd")
        with shuffles_removed(self.spark):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_table(self.spark, self.paths.pop(name))


def ranged_prefix(df: DataFrame, group: list[str], order: list[str], values: dict[str, str | Column]) -> DataFrame:
    """Exclusive running sums over a global order, without a single sorted task.

    Rows are range-partitioned by ``group + order`` (balanced however large one group is)
    and written with their partition number.  Sums inside a partition are windows; what
    lies before a partition comes from the per-partition totals, one small row each.

    ``values`` names the sums: new column -> what is added up.  The new columns must not
    exist in ``df``.  Rows equal in ``group + order`` may change places with each other.
    """
    part = "__part"
    values = {name: F.expr(v) if isinstance(v, str) else v for name, v in values.items()}
    rows = df.withColumns({f"__v_{name}": v.cast("bigint") for name, v in values.items()})
    rows = written(rows.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part, *group).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    totals = totals.select(
        F.col(part).alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group],
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in values],
    )
    inside = Window.partitionBy(part, *group).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"__i_{n}": F.sum(f"__v_{n}").over(inside) - F.col(f"__v_{n}") for n in values})
    on = F.col(part) == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    rows = rows.join(totals, on)
    return rows.select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__i_{n}")).alias(n) for n in values])


def bounded_batches(spark: SparkSession, most: int) -> None:
    """Rows go to Python in Arrow batches of about ``most`` bytes, or of one row.

    Else 10,000 rows make a batch, however long their texts, and the JVM and the worker
    each hold it whole.  A limit that the session has is left as it is.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(most))


#: What a Python worker keeps from task to task; tasks that do not use it drop it.
KEPT: dict[str, object] = {}


def give_back(drop: bool = False) -> None:
    """Return the memory that this worker has freed to the system; ``drop``: what it keeps, too."""
    if drop:
        KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mapped(rows: DataFrame, run: Callable, schema, keeps: bool = False) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` by workers that hold little between tasks.

    Workers live on from stage to stage, and what one has freed is not the system's yet.
    ``keeps``: ``run`` uses KEPT.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            give_back(drop=True)
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(task, schema)


def text_batches(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text (or one row)."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(value) -> str:
    """Text of a string or binary Arrow scalar; null is empty, broken bytes are replaced."""
    data = value.as_py()
    return "" if data is None else data if isinstance(data, str) else data.decode("utf-8", "replace")


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose bits depend on all bits of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def grown(hashes: np.ndarray, n: int, last: np.ndarray | None = None) -> np.ndarray:
    """Rolling hashes of all n-word windows; ``last``: those of n - 1 words."""
    base = np.uint64(0x9E3779B97F4A7C15)
    if last is None:
        last = hashes
        for k in range(2, n + 1):
            last = grown(hashes, k, last)
        return last
    return last[: max(0, len(hashes) - n + 1)] * base + hashes[n - 1 :]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WEIGHTS = mix64(np.arange(1, 4097, dtype=np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and at which word each text starts.

    Words are runs of bytes without ASCII white space.  The hash is a weighted sum of the
    bytes, so one pass over the joined texts gives all of them.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[1:-1][ends[1:-1] < len(data)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(len(data), dtype=np.int64) - starts[np.maximum(0, np.cumsum(first) - 1)]
    np.maximum(place, 0, out=place)
    weight = _WEIGHTS[place & 4095]
    if place.max() > 4095:
        weight = np.where(place > 4095, mix64(place), weight)
    value = weight * (data.astype(np.uint64) + np.uint64(1))
    value[~inside] = 0
    hashes = mix64(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, ends)


HOT = 1000


def attached(rows: DataFrame, values: DataFrame, key: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``values``, a stored table of one row for each ``key``.

    Column ``size`` counts the key's rows.  Keys that hold more than one in HOT of all
    rows are fewer than HOT, so they are broadcast and their rows stay where they are; no
    task gets a hot key whole.  The rows of all other keys are shuffled.
    """
    total = values.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(values.where(F.col(size) * HOT > total))
    cold = values.where(F.col(size) * HOT <= total)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component), component the smallest id.

    Alternating star steps: every node links its larger neighbours to the smallest node
    next to it, then its smaller ones.  The number of edges never grows; rounds grow with
    the logarithm of the longest path.  Each round is written to the shared folder.
    Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, label)

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")

    def star(e: DataFrame, large: bool, name: str) -> DataFrame:
        """large: link larger neighbours to the minimum; else smaller ones and the node."""
        n = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = n.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("degree"))
        joined = attached(n, scratch.keep(low, f"{name}-low"), ["a"], "degree")  # a centre may be next to every node
        if large:
            linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return scratch.keep(linked.where("a <> b").distinct(), name)

    now = scratch.keep(edges.where("a <> b").select("a", "b").distinct(), "e0")
    step, seen = 0, None
    while True:
        step += 1
        new = star(star(now, True, f"large{step}"), False, f"e{step}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        scratch.drop(f"large{step}-low", f"large{step}", f"e{step}-low")
        if tuple(state) == seen:
            break
        seen, now = tuple(state), new
        scratch.drop(f"e{step - 1}")
    flat = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return flat.unionByName(roots.join(flat.select("id"), "id", "left_anti"))
