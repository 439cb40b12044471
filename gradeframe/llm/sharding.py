"""Contiguous shards of nearly equal bytes, from global prefix sums.

Documents are ordered by ``doc_id``.  Sizes are added up inside range partitions, the
per-partition totals give what lies before each partition, and the resulting global byte
offsets are cut at equal targets.  DataFrame functions only; texts are never shuffled,
only (doc_id, size, checksum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranged_prefix


def byte_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``size``: UTF-8 bytes of the text plus 1; null and empty texts have size 1.  A
    document belongs to the shard in whose target range its middle byte lies, so shard
    sizes differ from the target by less than the largest document at each cut.
    ``slot`` counts 0, 1, 2, ... inside the shard in the order of doc_id.

    Null texts have the checksum of the empty text.  A null doc_id comes first.  Repeated
    rows are separate rows with neighbouring slots.  An empty table gives no rows.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).cast("bigint").alias("text_crc32"),
    )
    placed = ranged_prefix(narrow, [], ["doc_id", "text_crc32", "size"], {"bytes_before": "size", "row": F.lit(1)})
    total = narrow.agg(F.sum("size")).first()[0] or 1
    middle = (2 * F.col("bytes_before") + F.col("size")).cast("decimal(30,0)") * n_shards
    target = F.lit(2 * total).cast("decimal(30,0)")
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle / target).cast("int")))
    first = placed.groupBy("shard").agg(F.min("row").alias("first")).withColumnRenamed("shard", "__shard")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("__shard")).select(  # n_shards rows
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write whole documents as Parquet, one folder ``shard=N`` per shard, in slot order.

    Rows equal in doc_id and text are written as often as they occur.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    keyed = docs.select(*own, F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).cast("bigint").alias("__crc"))
    places = byte_shards(docs, n_shards).groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    places = places.select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__c"), "shard", "slot")
    rows = keyed.join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__crc") == F.col("__c")))
    rows.select(*own, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
