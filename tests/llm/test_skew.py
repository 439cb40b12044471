"""Hot keys: joins that split them, and components without a doc_id."""

from fixtures import documents

from pyspark.sql import functions as F

from gradeframe.llm import minmax
from gradeframe.llm.common import attached


def test_attached_equals_a_join(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2001).alias("k"), F.col("id").alias("v"))
    values = rows.groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("size")).where("k <> 7")
    got = attached(rows, values, ["k"], "size").select("k", "v", "m")
    assert sorted(got.collect()) == sorted(rows.join(values, "k").select("k", "v", "m").collect())
    assert attached(rows, values.limit(0), ["k"], "size").count() == 0


def test_hot_key_stays_out_of_the_shuffle(spark):
    """A key of a third of all rows is in no partition of the join's exchange."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    values = rows.groupBy("k").agg(F.count("*").alias("size"))
    got = attached(rows, values, ["k"], "size").withColumn("p", F.spark_partition_id())
    assert got.where("k = -1").select("p").distinct().count() == rows.rdd.getNumPartitions()


def test_buckets_in_tiles(spark, monkeypatch):
    """Buckets cut into small tiles give what one task a bucket gives."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(base[:59] + [f"x{i}"]), "en", "a"))  # all near each other
        rows.append((100 + i, " ".join(base[i % 3 : 57] + [f"y{i}", f"z{i}", "end"]), "en", "a"))
    table = documents(spark, rows)
    key = lambda df: sorted((r["doc"]["doc_id"], r["component_id"], r["kept"]) for r in df.collect())
    one = key(minmax.near_duplicates(table, 3, 85))
    monkeypatch.setattr(minmax, "TILE", 3)
    assert key(minmax.near_duplicates(table, 3, 85)) == one


def test_null_doc_id_counts_as_the_largest(spark):
    text, other = "one two three four five six", "seven eight nine ten eleven"
    rows = [(None, text, "en", "a"), (7, text, "en", "a"), (5, text, "en", "a"), (None, other, "en", "a"), (None, other, "en", "a"), (None, None, "en", "a")]
    got = minmax.near_duplicates(documents(spark, rows), 3, 85).collect()
    found = sorted(((r["doc"]["doc_id"], r["component_id"], r["kept"], r["stays"]) for r in got), key=str)
    assert found == sorted([
        (None, 5, False, False), (7, 5, False, False), (5, 5, True, True),
        (None, None, True, True), (None, None, False, False), (None, None, True, True),
    ], key=str)
