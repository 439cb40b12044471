"""Nearest neighbours by inner product, from randomly rotated one-bit codes.

A vector is stored as the signs of its rotated residual to a centroid (packed bits), the
residual's length, and the inner product between residual and code.  These give an
unbiased estimate of the inner product with a query and a bound on its error; only
vectors whose upper bound reaches the best exact scores so far are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.session import written

from .common import ship


def usable(embedding: str) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.col(embedding).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@dataclass
class Codebook:
    dim: int
    centroids: np.ndarray  # lists x dim
    radius: np.ndarray  # mean distance of the sample's vectors to their centroid
    rotation: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)).argmax(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, packed signs, residual length and correction of each vector."""
        at = self.nearest(x)
        rest = x - self.centroids[at]
        length = np.linalg.norm(rest, axis=1)
        turned = (rest / np.maximum(length, 1e-30)[:, None]) @ self.rotation.T
        bits = turned > 0
        correction = np.abs(turned).sum(axis=1) / np.sqrt(self.dim)
        return at, np.packbits(bits, axis=1), length, correction


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    c = np.unique(x, axis=0)[rng.permutation(len(np.unique(x, axis=0)))[:k]]
    for _ in range(rounds):
        at = (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c).astype(np.float32)
    at = (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
    far = np.linalg.norm(x - c[at], axis=1)
    return c, (np.bincount(at, far, len(c)) / np.maximum(1, np.bincount(at, minlength=len(c)))).astype(np.float32)


def fit(vectors: DataFrame, dim: int, lists: int, sample: int, seed: int) -> Codebook:
    """Centroids from at most about ``sample`` vectors, chosen by a hash of vec_id."""
    n = vectors.count()
    most = min(1_000_000, -(-1_000_000 * sample // max(1, n)))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < most)
    x = np.array([r[0] for r in rows.select("embedding").orderBy("vec_id").limit(2 * sample).collect()], np.float32).reshape(-1, dim)
    if not len(x):  # no row was drawn
        x = np.array([r[0] for r in vectors.select("embedding").limit(1).collect()], np.float32).reshape(-1, dim)
    c, far = k_means(x, lists, seed)
    return Codebook(dim, c, far, rotation(dim, seed))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), np.float32).reshape(-1, dim)


def search(table: DataFrame, k: int = 20, every: int = 20, probe: float = 1.0, list_rows: int = 8192, sample: int = 16384,
           most_lists: int = 4096, block_rows: int = 8192, epsilon: float = 1.9, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query.

    ``table``: vec_id, embedding.  Queries are rows whose vec_id is divisible by
    ``every``, candidates all rows with another vec_id.  All vectors are indexed, in lists
    of about ``list_rows`` (at most ``most_lists`` lists, fitted on ``sample`` vectors);
    a query reads the codes of the ``probe`` share of the lists that promise the largest
    products.  The default reads all: on vectors that hardly cluster, half of the lists
    hold less than nine tenths of the true neighbours.
    Lists are cut into blocks of about ``block_rows`` by a hash, so a list that holds a
    third of all vectors is many tasks; so are many queries of one list.

    Scores are exact, in double precision; ties go to the smaller vec_id.  Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do rows
    without vec_id; only vectors of equal dimension meet.  A query row that repeats
    has its results once for each row.  No vectors, no rows.
    """
    spark = table.sparkSession
    ship(spark)
    vectors = table.where(usable("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.monotonically_increasing_id().alias("row")
    ).where(usable("embedding"))  # finite as floats, too
    found = None
    for (dim,) in vectors.select(F.size("embedding")).distinct().collect():  # one row per dimension
        part = _search(vectors.where(F.size("embedding") == dim), dim, k, every, probe, list_rows, sample, most_lists, block_rows, epsilon, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, dim: int, k, every, probe, list_rows, sample, most_lists, block_rows, epsilon, seed) -> DataFrame:
    spark = vectors.sparkSession
    n = vectors.count()
    book = fit(vectors, dim, min(most_lists, max(1, n // list_rows)), sample, seed)
    shared = spark.sparkContext.broadcast(book)  # most_lists x dim floats at most
    lists = len(book.centroids)
    probes = min(lists, max(8, int(np.ceil(probe * lists))))

    def index(batches):
        own = shared.value
        for batch in batches:
            at, bits, length, correction = own.encode(matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(at, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()),
                 pa.array(length, pa.float32()), pa.array(correction, pa.float32())],
                ["vec_id", "embedding", "row", "list", "code", "length", "correction"],
            )

    rows = written(vectors.mapInArrow(index, "vec_id bigint, embedding array<float>, row bigint, list int, code binary, length float, correction float"), "ann-index")
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    blocks = sizes.select(F.col("list").alias("l"), F.ceil(F.col("n") / block_rows).alias("blocks"))

    def choose(batches):
        own = shared.value
        for batch in batches:
            q = matrix(batch.column(1), dim)
            promise = q @ own.centroids.T + np.linalg.norm(q, axis=1)[:, None] * own.radius * np.float32(0.3)
            chosen = np.argpartition(-promise, probes - 1, axis=1)[:, :probes] if probes < lists else np.tile(np.arange(lists), (len(q), 1))
            rep = pa.array(np.repeat(np.arange(len(q)), probes))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rep) for i in range(3)], pa.array(chosen.ravel(), pa.int32())], ["query_id", "q", "query_row", "list"])

    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", "row")
    queries = queries.mapInArrow(choose, "query_id bigint, q array<float>, query_row bigint, list int")
    asked = queries.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("parts")).withColumnRenamed("list", "ql")
    blocks = written(blocks.join(asked, F.col("l") == F.col("ql"), "left").select("l", "blocks", F.coalesce("parts", F.lit(0)).alias("parts")), "ann-blocks")
    blocks = F.broadcast(blocks)  # a row per list, most_lists at most
    cut = lambda column, n: F.pmod(F.xxhash64(column, F.lit(seed)), F.col(n))
    base = rows.join(blocks, rows.list == blocks.l).where("parts > 0")
    base = base.select("list", cut("row", "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "vec_id", "embedding", "row", "code", "length", "correction")
    queries = queries.join(blocks, queries.list == blocks.l)
    queries = queries.select("list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), cut("query_row", "parts").alias("part"), "query_id", "q", "query_row")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_row": [], "vec_id": [], "row": [], "score": []}
        if left.num_rows and right.num_rows:
            own = shared.value
            at = left.column("list")[0].as_py()
            ids, row = np.asarray(left.column("vec_id")), np.asarray(left.column("row"))
            x = matrix(left.column("embedding"), dim).astype(np.float64)
            bits = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            sign = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
            length, correction = (np.asarray(left.column(c)) for c in ("length", "correction"))
            scale = length / np.maximum(correction, 1e-6) / np.sqrt(np.float32(dim))
            spread = length * np.sqrt(np.maximum(0, 1 - correction**2)) / np.maximum(correction, 1e-6) * np.float32(epsilon / np.sqrt(max(1, dim - 1)))
            queries = matrix(right.column("q"), dim)
            for start in range(0, len(queries), 256):
                q = queries[start : start + 256]
                guess = (q @ own.rotation.T) @ sign.T * scale + (q @ own.centroids[at])[:, None]
                for i in range(len(q)):
                    j = start + i
                    q_id, q64 = right.column("query_id")[j].as_py(), q[i].astype(np.float64)
                    upper = guess[i] + spread * np.linalg.norm(q[i])
                    upper[ids == q_id] = -np.inf
                    # exact scores of the best guesses give the bar that others must be able to reach
                    first = np.argpartition(-upper, min(2 * k, len(upper)) - 1)[: 2 * k]
                    first = first[ids[first] != q_id]
                    score = (x[first] * q64).sum(axis=1)
                    bar = np.sort(score)[-k] if len(score) >= k else -np.inf
                    chosen = np.flatnonzero((upper >= bar - 1e-5 * abs(bar)) & (ids != q_id)) if len(score) >= k else np.flatnonzero(ids != q_id)
                    score = (x[chosen] * q64).sum(axis=1)
                    best = np.lexsort((row[chosen], ids[chosen], -score))[:k]
                    out["query_id"].append(np.full(len(best), q_id))
                    out["query_row"].append(np.full(len(best), right.column("query_row")[j].as_py()))
                    out["vec_id"].append(ids[chosen][best])
                    out["row"].append(row[chosen][best])
                    out["score"].append(score[best])
        kinds = {"score": np.float64}
        return pa.table({c: np.concatenate(v).astype(kinds.get(c, np.int64)) if v else np.empty(0, kinds.get(c, np.int64)) for c, v in out.items()})

    key = ["list", "block", "part"]
    pairs = base.groupBy(*key).cogroup(queries.groupBy(*key))
    return pairs.applyInArrow(compare, "query_id bigint, query_row bigint, vec_id bigint, row bigint, score double")
