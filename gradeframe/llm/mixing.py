"""Mix sources to target weights on a low-discrepancy schedule.

A source gets as many slots as its target has blocks, the last of them perhaps short.  The
points ``frac((k + 1/2) * golden ratio)`` of all slots k are put in order, and each source
has as many neighbouring ones as it has slots, so no source lacks a slot and every stretch
of the mix has each source close to its share.  The r-th slot of a source takes the r-th
block of equal word count from the source's stream: its documents in a shuffled order, then
again in another one (a source is used twice at most).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.session import written

from .common import WORD, ranged_prefix

GOLDEN = 0.6180339887498949


@dataclass
class Mix:
    documents: DataFrame  # rid, doc_id, source, size, source_size, target, taken, first_slot (null: not taken), n_slots
    schedule: DataFrame  # slot, source, rank
    pieces: DataFrame  # slot, source, rank, rid, doc_id, epoch, word_from, word_to


def targets(sizes: list[tuple[str | None, int]], weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take from each source (code point order, null last).

    ``share`` of all words is split by weight; what exceeds ``most`` times a source's size
    is split again among the sources that are below, until none is above.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap = [most * n for _, n in sizes]
    left, fixed = share * sum(n for _, n in sizes), set()
    while True:
        open_w = sum(w[i] for i in range(len(w)) if i not in fixed)
        rest = left - sum(cap[i] for i in fixed)
        got = [cap[i] if i in fixed else rest * w[i] / open_w for i in range(len(w))]
        over = {i for i in range(len(w)) if i not in fixed and got[i] > cap[i]}
        if not over:
            return got
        fixed |= over


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, block: int = 256, seed: int = 11, row: str | None = None) -> Mix:
    """The mix of all documents by source.

    ``size``: words of the text, 0 for null or empty texts, which are never taken.  A null
    source is a source of its own.  Repeated rows are separate documents, ordered among
    themselves arbitrarily but with the same sizes.  Reruns give the same mix: order
    depends on doc_id, seed and size only.  An empty table, or one without words, gives a
    mix without slots.  Every source gives the whole words of its target, and one if that is
    a fraction of a word.  ``row`` names a column that identifies rows, to be ``rid`` of the
    result; otherwise rows are numbered.  Other columns are ignored.

    One row per *source* (not per document) goes through the driver.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", (F.col(row) if row else F.monotonically_increasing_id()).alias("rid"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    narrow = written(narrow, "mix-sizes")
    by_source = [(r[0], r[1]) for r in narrow.groupBy("source").agg(F.sum("size")).collect()]
    by_source.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    goal = targets(by_source, weights, share) if by_source else []
    stops = [max(1, int(g)) if g > 0 else 0 for g in goal]
    ends = list(accumulate(-(-n // block) for n in stops))  # slots of this and all earlier sources
    plan = spark.createDataFrame(
        [(i, s, n, g, stop) for i, ((s, n), g, stop) in enumerate(zip(by_source, goal, stops, strict=True))],
        "s_no int, s_name string, source_size bigint, target double, s_stop bigint",
    )

    point = F.pmod((F.col("id") + 0.5) * GOLDEN, F.lit(1.0))
    points = spark.range(ends[-1] if ends else 0).select(F.col("id").alias("slot"), point.alias("point"))
    points = ranged_prefix(points, [], ["point", "slot"], {"place": F.lit(1)})
    bounds = F.array(*[F.lit(e) for e in ends[:-1]]).cast("array<bigint>")
    slots = points.select("slot", F.size(F.filter(bounds, lambda e: e <= F.col("place"))).alias("s_no"))
    # rank inside the source: counts of earlier chunks, then the place inside the chunk
    chunk = 1 << 12
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / chunk))
    counts = slots.groupBy("s_no", "chunk").count()
    earlier = Window.partitionBy("s_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("s_no", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("chunk", "s_no").orderBy("slot")
    slots = slots.withColumn("n", F.row_number().over(inside) - 1).join(counts, ["s_no", "chunk"])
    slots = slots.select("slot", "s_no", (F.col("earlier") + F.col("n")).alias("rank"))

    known = narrow.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s_name"))).drop("s_name")  # a row per source
    passes = known.where("size > 0").withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    passes = passes.withColumn("order", F.xxhash64(F.col("doc_id"), F.col("epoch"), F.lit(seed)))
    stream = ranged_prefix(passes, ["s_no", "epoch"], ["order", "doc_id", "size"], {"before": "size"})
    stream = stream.withColumn("start", F.col("before") + F.col("epoch") * F.col("source_size"))
    stream = stream.withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("s_stop"))).where("start < stop")
    blocks = stream.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    pieces = blocks.join(slots, ["s_no", "rank"]).select(
        "slot", "s_no", "source", "rank", "rid", "doc_id", "epoch",
        (F.greatest("start", F.col("rank") * block) - F.col("start")).alias("word_from"),
        (F.least("stop", (F.col("rank") + 1) * block) - F.col("start")).alias("word_to"),
    )
    taken = pieces.groupBy(F.col("rid").alias("__rid")).agg(
        F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots")
    )
    documents = known.join(taken, F.col("rid") == F.col("__rid"), "left").select(
        "rid", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        "first_slot", F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"),
    )
    schedule = slots.join(F.broadcast(plan), "s_no").select("slot", F.col("s_name").alias("source"), "rank")
    return Mix(documents, schedule, pieces.drop("s_no"))
