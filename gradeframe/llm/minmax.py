"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two values of the signature, its minimum and
its maximum, so half as many hash evaluations give signatures of the same length, and
their estimates vary less.  Bands of the signature bring candidates together; a link
counts only after both full shingle sets have been compared.

Documents with equal sets are one node from the start, so large groups of copies cost
nothing.  Within a bucket, members are first compared with a lead, the one in the most
crowded buckets; what is in different components after that is compared pair by pair, so
that no link between candidates is lost.  Odd sketches keep most pairs that are not linked
from being formed: two sets differ in at least as many shingles as their sketches in bits,
which rules out pairs for certain and no linked one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, attached, components, grown, mapped, mix64, odd_numbers, ship, text_batches, word_hashes

SKETCH_BITS = 2048
TILE = 512  # members of a bucket that meet its leads, or another tile, in one task
PERMS_PER_BAND = 3  # six values: three minima and three maxima


def bands_needed(similarity: float, miss: float) -> int:
    """Bands so that a pair exactly at the threshold is overlooked with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity ** (2 * PERMS_PER_BAND)))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters are lower-cased."""
    words, starts = word_hashes([t.lower() for t in texts])
    out = []
    for i in range(len(texts)):
        own = words[starts[i] : starts[i + 1]]
        out.append(np.unique(mix64(grown(own, min(size, len(own))))) if len(own) else own)
    return out


def min_max(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a set under every permutation, in blocks of bounded size."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(hashes), 2048):
        values = (hashes[None, at : at + 2048] ^ offsets[:, None]) * factors[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the sketch whether an odd number of the set's hashes choose it."""
    chosen = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(chosen.astype(np.uint8)).view(np.int64)


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    values = np.concatenate([low.reshape(-1, PERMS_PER_BAND), high.reshape(-1, PERMS_PER_BAND)], axis=1)
    key = np.arange(len(values), dtype=np.uint64)
    for c in range(values.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ values[:, c])
    return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, seed: int) -> DataFrame:
    """All columns of ``docs`` as struct ``doc``; n_shingles, f1, f2 (of the
    set), bands, odd sketch."""
    ship(docs.sparkSession)
    out = docs.select(F.struct("*").alias("doc"), docs.text.cast("binary").alias("t"))
    schema = T.StructType([
        out.schema["doc"], T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("odd", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = odd_numbers(2 * bands * PERMS_PER_BAND, seed)
        factors, offsets = numbers[::2], mix64(numbers[1::2])
        for batch in text_batches(batches, most=2 << 20):
            sets = shingle_sets([x.as_py() or b"" for x in batch.column(1)], shingle)
            f1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            f2 = [int(mix64(s ^ np.uint64(seed)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            keys = [band_keys(*min_max(s, factors, offsets)) if len(s) else None for s in sets]
            odd = [odd_sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc", "n_shingles", "f1", "f2", "bands", "odd"],
            )

    return mapped(out, run, schema)


def linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough; texts: rid, text."""
    left = texts.select(F.col("rid").alias("u"), F.col("text").cast("binary").alias("u_text"))
    right = texts.select(F.col("rid").alias("v"), F.col("text").cast("binary").alias("v_text"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "u_text", "v_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # a lead's pairs follow each other
        for batch in text_batches(batches, 2, 2 << 20):
            sets = shingle_sets([x.as_py() or b"" for x in batch.column(2)], shingle)
            keep = []
            for a, v, text in zip(sets, batch.column(1).to_pylist(), batch.column(3), strict=True):
                if v != last:
                    last, own = v, shingle_sets([text.as_py() or b""], shingle)[0]
                common = len(np.intersect1d(a, own, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(a) + len(own) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return mapped(both, run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-6, lead_rounds: int = 1, seed: int = 7) -> DataFrame:
    """One row per document: doc (all its columns as a struct), rid, n_shingles,
    component_id, kept, stays.

    Linked are documents whose shingle sets have 100 * intersection >= percent * union.
    ``component_id``: smallest doc_id reachable over links; ``kept``: it is the document's
    own; ``stays``: true for exactly one row of each component, also if rows repeat.

    Null and empty texts, and texts without words, have no shingles and link with
    nothing.  Texts with fewer words than a shingle have one shingle, of all words.
    A null doc_id counts as the largest: component_id is null only if the whole component
    has none, and then the row that stays is kept.  Rows that repeat are linked.  An empty table gives no rows.  Nulls in other columns
    and any further column names are passed through in ``doc``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minmax")
    bands = bands_needed(percent / 100, miss)
    t = scratch.keep(signatures(docs, shingle, bands, seed).withColumn("rid", F.monotonically_increasing_id()), "documents")

    # nodes: one row of each distinct set
    whole = ["n_shingles", "f1", "f2"]
    nodes = t.where("n_shingles > 0").groupBy(*whole).agg(F.min("rid").alias("node"), F.count("*").alias("copies"))
    nodes = scratch.keep(nodes, "nodes")
    heads = nodes.select(F.col("node").alias("rid"))
    entries = t.select("rid", "bands").join(heads, "rid", "left_semi").select("rid", F.explode("bands").alias("key"))
    crowded = scratch.keep(entries.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowded")
    entries = scratch.keep(attached(entries, crowded, ["key"], "crowd"), "candidates")
    texts = t.select("rid", F.col("doc.text").alias("text"))

    # weight: how crowded a document's buckets are; the most central one is the best lead
    weights = entries.groupBy("rid").agg(F.sum("crowd").alias("weight"))
    weights = weights.join(t.select("rid", F.col("n_shingles").alias("n"), "odd"), "rid")
    # a bucket is dealt in tiles, so that no task gets a crowded one whole
    tiles = F.expr(f"(crowd - 1) DIV {TILE} + 1")
    entries = entries.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("rid"), "tiles")).drop("crowd")
    entries = scratch.keep(entries.join(weights, "rid"), "entries")

    def every_tile(rows: DataFrame) -> DataFrame:
        return rows.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))).drop("tiles")

    def able(a: str, b: str) -> Column:
        """Whether two documents can be similar enough.

        Their sets differ in at least as many shingles as their odd sketches in bits.
        """
        # one column for each 64 bits, so that it is compiled into the join
        differ = " + ".join(f"bit_count({a}odd{i} ^ {b}odd{i})" for i in range(SKETCH_BITS // 64))
        close = f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n)"
        return F.expr(f"{close} AND {100 + percent} * ({differ}) <= {100 - percent} * ({a}n + {b}n)")

    def unfolded(rows: DataFrame, sketch: str, prefix: str = "") -> DataFrame:
        return rows.select("*", *[F.col(sketch)[i].alias(f"{prefix}odd{i}") for i in range(SKETCH_BITS // 64)])

    def mixed(found: DataFrame) -> DataFrame:
        """Entries of the buckets that hold more than one component, with the main one."""
        own = entries.join(found, entries.rid == found.id, "left")
        own = own.select("key", "tile", "tiles", "rid", F.coalesce("component", "rid").alias("c"), "n", "odd", "weight")
        sizes = own.groupBy("key", "tiles", "c").agg(F.count("*").alias("size"))
        main = sizes.groupBy("key", "tiles").agg(F.max(F.struct("size", "c")).alias("m"), F.count("*").alias("parts"))
        main = scratch.keep(main.where("parts > 1").select("key", "tiles", F.col("m.c").alias("main")), "main")
        return own.join(every_tile(main), ["key", "tile"])

    tested: list[DataFrame] = []
    found = spark.createDataFrame([], "id bigint, component bigint")
    now = entries.select("key", "tile", "tiles", "rid", F.col("rid").alias("c"), "n", "odd", "weight", F.lit(None).cast("bigint").alias("main"))

    def test(pairs: DataFrame, name: str) -> bool:
        """Confirm pairs not tested yet; whether there were any."""
        nonlocal found, now
        for done in tested:
            back = done.select(F.col("u").alias("v"), F.col("v").alias("u"))
            pairs = pairs.join(done, ["u", "v"], "left_anti").join(back, ["u", "v"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs-{name}")
        if pairs.isEmpty():
            return False
        tested.append(pairs)
        new = scratch.keep(linked(pairs, texts, shingle, percent), f"edges-{name}")
        if not new.isEmpty():
            edges = new.select(F.col("u").alias("a"), F.col("v").alias("b"))
            edges = edges.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
            found = scratch.keep(components(edges, "minmax-components"), f"found-{name}")
            now = scratch.keep(mixed(found), f"mixed-{name}")
            scratch.drop("main")
        return True

    for turn in range(lead_rounds):
        # the lead: the most central member, then others
        draw = -F.col("weight") if turn == 0 else F.xxhash64("rid", F.lit(turn))
        draw = F.struct(draw.alias("draw"), *[F.col(c).alias(c) for c in ("rid", "c", "n", "odd")])
        leads = scratch.keep(now.groupBy("key", "tiles").agg(F.min(draw).alias("lead")), f"leads{turn}")
        leads = every_tile(leads).select("key", "tile", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("rid", "c", "n", "odd")])
        pairs = unfolded(now, "odd").join(unfolded(leads, "lead_odd", "lead_"), ["key", "tile"]).where((F.col("c") != F.col("lead_c")) & able("", "lead_"))
        test(pairs.select(F.col("rid").alias("u"), F.col("lead_rid").alias("v")).distinct(), f"lead{turn}")
    # what is still apart: all pairs across components that share a bucket; members of the
    # bucket's main component are never compared with each other
    apart = unfolded(now, "odd").drop("odd")
    a, b = apart.where("main IS NULL OR c <> main").alias("a"), every_tile(apart).alias("b")
    rest = a.join(b, F.expr("a.key = b.key AND a.tile = b.tile AND a.c <> b.c AND (coalesce(b.c = b.main, false) OR a.c < b.c)") & able("a.", "b."))
    test(rest.select(F.col("a.rid").alias("u"), F.col("b.rid").alias("v")).distinct(), "rest")
    found = scratch.keep(found, "components")
    scratch.drop(*[n for n in scratch.paths if n not in ("documents", "nodes", "components")])

    nodes = nodes.join(found, nodes.node == found.id, "left").select(*whole, "copies", F.coalesce("component", "node").alias("c"))
    rows = t.select("rid", F.col("doc.doc_id").alias("d"), *whole)
    own = attached(rows, scratch.keep(nodes, "classes"), whole, "copies").select("rid", "d", "c")
    own = scratch.keep(own.unionByName(rows.where("n_shingles = 0").select("rid", "d", F.col("rid").alias("c"))), "own")
    first = F.min(F.struct(F.col("d").isNull().alias("absent"), "d", "rid")).alias("first")
    first = scratch.keep(own.groupBy("c").agg(first, F.count("*").alias("size")), "first")
    own = attached(own, first, ["c"], "size").select(F.col("rid").alias("r"), F.col("first.d").alias("component_id"), F.col("first.rid").alias("stayer"))
    stays = F.col("rid") == F.col("stayer")
    # a component of which no row has a doc_id keeps the row that stays
    return t.join(own, F.col("rid") == F.col("r")).select("doc", "rid", "n_shingles", "component_id", F.coalesce(F.col("doc.doc_id") == F.col("component_id"), F.col("component_id").isNull() & stays).alias("kept"), stays.alias("stays"))
