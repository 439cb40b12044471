"""From raw documents to token ids, in stages that are written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the
columns of ``documents``, whatever these are beside doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import bpe, langid, minmax, mixing, suffix
from gradeframe.llm.common import WORD, Scratch, bounded_batches, shuffles_removed
from gradeframe.llm.queries import tokenizer_path
from gradeframe.session import written

#: A document goes if less than this share of its letters is evidence for learned languages.
LEAST_SHARE = 0.4

#: Bytes of text that a Python worker takes at once; workers live on from stage to stage.
BATCH_BYTES = 2 << 20

#: Bytes of an Arrow batch: rows that pass through Python bring their text twice.
ARROW_BYTES = 2 * BATCH_BYTES

#: Slots, of 256 words each, that one file of the mix holds at most.
SLOTS_PER_PART = 1 << 17


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that the labelled ones teach, one or several mixed.

    Null, empty and letterless texts go, and those of which all learned languages together
    have less than LEAST_SHARE.
    """
    bounded_batches(spark, ARROW_BYTES)
    found = langid.identify(docs, langid.fit(docs), carry=tuple(docs.columns), batch_bytes=BATCH_BYTES)
    return found.where((F.col("lang_pred") != "und") & (F.col("evidence") >= LEAST_SHARE)).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8."""
    bounded_batches(spark, ARROW_BYTES)
    return minmax.near_duplicates(docs, shingle=5, percent=80).where("stays").select("doc.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents; documents that lose all words go.

    A character of which a part was removed goes whole.  ``n_chars`` is counted anew.
    """
    bounded_batches(spark, ARROW_BYTES)
    found = suffix.without_repeats(docs, characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("doc.text"))
    rows = found.select("doc", "n_removed", text.alias("text"))
    rows = rows.where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(WORD)))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return rows.select(*[own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix in the order of its schedule, once for each pass over their source.

    A row stands where the first slot that reads it in this pass does, so any stretch of
    the output holds the sources near their shares.  The last document that a pass reaches
    is taken whole.  Null and empty texts and texts without words have no slot and go;
    rows that repeat are documents of their own; an empty table gives no rows.
    """
    scratch = Scratch(spark, "mix")
    docs = scratch.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    with shuffles_removed(spark):
        pieces = mixing.mix_sources(docs, row="__row").pieces
    chosen = pieces.groupBy(F.col("rid").alias("__rid"), "epoch").agg(F.min("slot").alias("__slot"))
    chosen = scratch.keep(chosen.groupBy("__rid").agg(F.collect_list("__slot").alias("__slots")), "chosen")
    slots = (chosen.agg(F.max(F.array_max("__slots"))).first()[0] or 0) + 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // SLOTS_PER_PART))
    # stored with their slots, so the files of this shuffle and the first copy go before the next one
    rows = scratch.keep(docs.join(chosen, F.col("__row") == F.col("__rid")).drop("__row"), "taken")
    scratch.drop("documents")
    rows = rows.withColumn("__slot", F.explode("__slots"))
    # slots are numbers without gaps, so equal ranges need no sample of the rows
    rows = rows.repartitionById(parts, F.expr(f"int(__slot * {parts} DIV {slots})")).sortWithinPartitions("__slot", "__rid")
    return rows.select(*[c for c in docs.columns if c != "__row"])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the hash of what they decode to, and whether that is the text."""
    bounded_batches(spark, ARROW_BYTES)
    return bpe.encode_documents(docs, tokenizer_path(), ("n_tokens", "ids", "decoded_sha256", "restored"), room=50_000, batch_bytes=BATCH_BYTES)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{n}")
    return docs
