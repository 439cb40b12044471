"""Readers for benchmark, response and image files.  Schemas are always declared."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed as K, text as T
from ..functions.equivalence import _bind
from ..schemas import BENCHMARK_SCHEMAS, RESPONSES
from ..session import held_conf, written
from .json_ranges import json_records

def parsed_lines(lines: DataFrame, schema: str, strict: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``value``, one JSON object each, by a declared schema.

    A line is read as the only element of a list, so that text behind the object makes
    it broken too.  A field of another type than declared (say ``verify: "true"``) is
    NULL without breaking the line.
    """
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    parsed = F.from_json(wrapped, f"array<struct<{_as_struct(schema)}>>")
    broken = (
        F.raise_error(F.concat(F.lit("line is not a JSON object: "), F.col("value")))
        if strict
        else F.array()
    )

    def checked(rows: Column) -> Column:
        good = F.coalesce((F.size(rows) == 1) & F.get(rows, F.lit(0)).isNotNull(), F.lit(False))
        return F.when(good, rows).otherwise(broken)

    # exploded, not filtered: a filter on the parsed rows would parse every line again
    rows = lines.filter(T.strip("value") != "")
    return rows.select(*keep, F.explode(_bind(parsed, checked)).alias("__row")).select(*keep, "__row.*")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = RESPONSES) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a broken line is an error."""
    return parsed_lines(spark.read.text(path), schema, strict=True)


def read_jsonl_tolerant(
    spark: SparkSession, path: str | list[str], schema: str = RESPONSES
) -> DataFrame:
    """Like `read_jsonl`, but broken lines are dropped."""
    return parsed_lines(spark.read.text(path), schema, strict=False)


def read_jsonl_with_keys(
    spark: SparkSession, path: str | list[str], schema: str = RESPONSES, raw: str = "raw"
) -> DataFrame:
    """Like `read_jsonl`, with the line itself beside the fields.

    Needed where a key with a null value must be told from a missing key (see
    ``records.has_fields``).
    """
    lines = spark.read.text(path).withColumn(raw, F.col("value"))
    return parsed_lines(lines, schema, strict=True, keep=(raw,))


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession):
    """Settings for the listing of very many folders, which is done as a source is loaded.

    By default a listing is cut into 10,000 tasks, which take longer to start than to list;
    and the type of a partition's name, which no reader here uses, is tried on every folder.
    """
    tasks = min(int(spark.conf.get(LISTING)), 32 * spark.sparkContext.defaultParallelism)
    return held_conf(spark, {LISTING: str(tasks), "spark.sql.sources.partitionColumnTypeInference.enabled": "false"})


# files up to this size are parsed whole, a task taking many of them; larger ones by ranges
WHOLE_BYTES = 4 << 20


def _whole_files(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, bool]:
    """Text of each small JSON file, and whether there are larger files."""
    with _listed(spark):
        large = spark.read.text(path).filter(F.col("_metadata.file_size") > WHOLE_BYTES)
        small = spark.read.text(path, wholetext=True).filter(F.col("_metadata.file_size") <= WHOLE_BYTES)
    return small.filter(T.strip("value") != ""), not large.isEmpty()


def read_json_list(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON files that are one list of objects each; a damaged file is an error.

    Large files are read by many tasks.
    """
    kind = f"struct<{_as_struct(schema)}>"
    small, more = _whole_files(spark, path)
    no_record = F.raise_error(F.lit("not a JSON record: null")).cast(kind)
    out = small.select(F.explode(_strictly(F.col("value"), f"array<{kind}>")).alias("r")).select(F.when(F.col("r").isNotNull(), F.col("r")).otherwise(no_record).alias("r"))
    if more:
        out = out.union(json_records(spark, path, WHOLE_BYTES).select(_strictly(_without_mark("["), kind).alias("r")))
    return out.select("r.*")


def read_json_keyed(spark: SparkSession, path: str | list[str], schema: str, key: str = "record_id") -> DataFrame:
    """JSON files that are one object ``{id: record}`` each, as one row per record.

    Large files are read by many tasks; a damaged one is an error.
    """
    kind = f"struct<{_as_struct(schema)}>"
    small, more = _whole_files(spark, path)
    out = small.select(F.explode(_entries(F.col("value"), kind)).alias("e"))
    if more:
        entry = F.concat(F.lit("{"), _without_mark("{"), F.lit("}"))
        out = out.union(json_records(spark, path, WHOLE_BYTES).select(F.explode(_entries(entry, kind)).alias("e")))
    return out.select(F.col("e.id").alias(key), "e.r.*")


# a JSON string, an object that is nested three levels deep at most, a key with such an object
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_OBJECT = r"\{(?:[^{}\"]++|%s)*+\}" % _STRING
for _ in range(2):
    _OBJECT = r"\{(?:[^{}\"]++|%s|%s)*+\}" % (_STRING, _OBJECT)
_ENTRY = r"%s\s*+:\s*+%s" % (_STRING, _OBJECT)
_ENTRIES = r"(?s)\A\s*+\{\s*+%s\s*+(?:,\s*+%s\s*+)*+\}\s*+\z" % (_ENTRY, _ENTRY)
_ENTRY_PARTS = r"(?s)(%s)\s*+:\s*+(%s)" % (_STRING, _OBJECT)


def _entries(text: Column, kind: str) -> Column:
    """array<struct<id, r>> of a JSON object of records.

    The parser keeps one copy of every key name in the whole process, which for ids, all
    different, takes most of its time.  An object of plain records is thus read as a list
    ``[{"id": id, "r": record}]``; any other is parsed as it is.
    """

    def read(t: Column) -> Column:
        rows = F.regexp_replace(T.strip(t), _ENTRY_PARTS, '{"id":$1,"r":$2}')
        rows = F.concat(F.lit("["), F.substring(rows, F.lit(2), F.length(rows) - 2), F.lit("]"))
        as_list = _strictly(rows, f"array<struct<id:string,r:{kind}>>")
        as_map = F.map_entries(_strictly(t, f"map<string,{kind}>"))
        as_map = F.transform(as_map, lambda e: F.struct(e["key"].alias("id"), e["value"].alias("r")))
        return F.when(F.rlike(t, F.lit(_ENTRIES)), as_list).otherwise(as_map)

    return _bind(text, read)


def _without_mark(opener: str) -> Column:
    """A record without what stands before it: the file's bracket, or a comma."""
    first, later = (F.regexp_extract("text", rf"(?s)\A\s*\{mark}(.*)", 1) for mark in (opener, ","))
    return F.when(F.col("no") == 0, first).otherwise(later)


def _strictly(text: Column, kind: str) -> Column:
    """JSON text as a value; text that is none is an error.

    It is parsed once.  A column of it that is then exploded would be parsed again, by the
    filters that Spark adds, so it is exploded as it is.
    """
    # as the only element of a list, so that text behind the value breaks it too
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>", {"mode": "FAILFAST"})
    damaged = F.raise_error(F.concat(F.lit("not a JSON record: "), F.left(text, F.lit(100)))).cast(kind)

    def only(rows: Column) -> Column:
        return F.when((F.size(rows) == 1) & F.get(rows, F.lit(0)).isNotNull(), F.get(rows, F.lit(0))).otherwise(damaged)

    return _bind(parsed, only)


def _as_struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def read_benchmark(
    spark: SparkSession, dataset: str, root: str = K.DEFAULT_ROOT, path: str | None = None
) -> DataFrame:
    """A benchmark by name, in whichever of its formats the path has."""
    path = path or f"{root.rstrip('/')}/{K.BENCHMARK_FILES[dataset]}"
    schema = BENCHMARK_SCHEMAS[dataset]
    if path.endswith("jsonl"):
        rows = read_jsonl(spark, path, schema)
    elif not path.endswith("json"):
        rows = spark.read.parquet(path)
    elif dataset in K.KEYED_BENCHMARKS:
        rows = read_json_keyed(spark, path, schema)
    else:
        rows = read_json_list(spark, path, schema)
    return rows.withColumn("dataset", F.lit(dataset))


def _glob_regex(pattern: str) -> str:
    """A file name pattern of ``*`` and ``?`` as a regular expression."""
    return "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)


def read_result_files(
    spark: SparkSession,
    folder: str,
    schema: str = RESPONSES,
    pattern: str = "*.jsonl",
    tolerant: bool = False,
) -> DataFrame:
    """All result files of a folder, with ``file`` and ``dataset`` from their names.

    A result file may be a folder of part files of that name, as ``sinks.append_jsonl`` and
    partitioned writes leave them.  Already filtered files and the skipped data set are
    left out by name before any of their rows are used.
    """
    own, parent = F.col("_metadata.file_name"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    name = F.when(own.startswith("part-"), F.regexp_replace(F.url_decode(parent), r"\A[^/=]*=", "")).otherwise(own)
    lines = spark.read.option("recursiveFileLookup", True).text(folder).withColumn("file", name)
    lines = lines.filter(F.col("file").rlike(f"(?s)\\A(?:{_glob_regex(pattern)})\\z") & ~T.is_skipped_file("file"))
    rows = parsed_lines(lines, schema, strict=not tolerant, keep=("file",))
    return rows.withColumn("dataset", T.dataset_from_file("file"))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image files as path, extension and base64 text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    with _listed(spark):
        files = files.load(path)
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        T.file_extension("path").alias("image_format"),
        # base64 as one line
        F.regexp_replace(F.base64("content"), r"\s", "").alias("image_base64"),
    )


def with_file_ordinal(rows: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Add the 0-based row number within each file, in file order.

    `rows` is a file scan (filters and projections allowed).  They are stored once, each
    with its split and a number that grows inside it, so that counts and rows come from the
    same scan: another scan may be split elsewhere, when executors have come or gone.
    Splits are shifted by the row counts before them; only one row per split is sorted.
    """
    block = ["__file", "__start"]
    numbered = rows.withColumns(
        {
            "__file": F.col("_metadata.file_path"),
            "__start": F.col("_metadata.file_block_start"),
            "__mono": F.monotonically_increasing_id(),
        }
    )
    numbered = written(numbered, "numbered", compression="zstd")
    blocks = numbered.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"), F.min("__mono").alias("__first"))
    before = Window.partitionBy("__file").orderBy("__start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = blocks.select(
        *block,
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    # one row per split; without the hint all rows are shuffled before its size is known
    out = numbered.join(F.broadcast(shifts), block).withColumn(
        ordinal, (F.col("__mono") + F.col("__shift")).cast("bigint")
    )
    return out.drop("__mono", "__shift", *block)
