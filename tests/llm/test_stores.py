"""WARC archives and nearest neighbours."""

import hashlib
import io
import zlib

import numpy as np
from check_oracles import compare, connect

from gradeframe.llm import ann, queries, warc

SMALL = "/root/testdata/sf0.001"


def test_registered_queries_equal_their_sql(spark):
    con = connect(SMALL)
    for name, sql in queries.ORACLES.items():
        assert compare(spark, con, queries.QUERIES[name], sql, SMALL) == "", name


def pages(spark):
    big = "x" * 2_500_000
    same = "y" * 1000
    rows = [
        (1, "http://a/\r\nb ü", "short"), (2, None, "short"), (3, "u", None), (4, "u", ""), (5, "u", same), (6, "u", same), (7, "u", same),
        (8, "u", big), (9, "u", big), (10, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 200), (None, "u", same), (7, "u", same), (11, "u", "z" * 999), (12, "u", "z" * 999),
    ]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, digest string, payload string").repartition(3), rows


def test_archive_round_trip(spark):
    df, rows = pages(spark)
    files, chunks = warc.archived(df)
    got = chunks.collect()
    by_record = {}
    for r in sorted(got, key=lambda r: (r["file"], r["record_id"], r["record_type"], r["chunk_no"])):
        by_record.setdefault((r["record_id"], r["target_uri"]), []).append(r)
    last = [r for r in got if r["last"]]
    assert len(last) == len(rows) == sum(f["n_records"] for f in files.collect())
    want = sorted((warc.name_of(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((r["record_id"], r["bytes_so_far"], r["sha1"]) for r in last) == want
    assert all(r["sha1"] == r["announced"] for r in last)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in last)
    assert [k for k in kinds if k[1] == "revisit"] == sorted(
        [(warc.name_of(i), "revisit", warc.name_of(7)) for i in (None, 5, 6)] + [(warc.name_of(8), "revisit", warc.name_of(9))]
    )
    large = [r for r in got if r["record_id"] == warc.name_of(9)]
    assert len(large) == 3 and b"".join(bytes(r["data"]) for r in sorted(large, key=lambda r: r["chunk_no"])) == b"x" * 2_500_000
    assert max(len(r["data"]) for r in got) <= warc.PIECE


def test_small_chunks_and_running_digests():
    payload = bytes(range(256)) * 40
    record = b"".join(warc.record(1, "u", payload, hashlib.sha1(payload).digest(), "response", None, "2000-01-01T00:00:00Z"))
    gz = zlib.compress(record, wbits=31)
    got = list(warc.chunks(io.BytesIO(gz + gz), 100))
    assert len(got) == 2 * 103
    so_far = b""
    for r in got[:103]:
        so_far += r["data"]
        assert r["sha1"] == hashlib.sha1(so_far).hexdigest() and r["bytes_so_far"] == len(so_far)


def test_damaged_archive():
    record = b"".join(warc.record(1, "u", b"p" * 5000, hashlib.sha1(b"p" * 5000).digest(), "response", None, "x"))
    try:
        list(warc.chunks(io.BytesIO(zlib.compress(record[:-200], wbits=31)), 100))
    except ValueError:
        return
    raise AssertionError("a cut record was read")


def test_no_pages(spark):
    files, chunks = warc.archived(pages(spark)[0].limit(0))
    assert files.count() == chunks.count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[200:700] = x[200]  # a vector that a third of the rows share
    rows = [(i, v.tolist(), "clash", "clash") for i, v in enumerate(x)]
    rows += [(2000, None, "", ""), (2020, [0.0] * 24, "", ""), (2040, [float("nan")] + [1.0] * 23, "", ""), (2060, [None] + [1.0] * 23, "", ""), (2080, [float("inf")] * 24, "", ""), (2100, [1.0, 2.0], "", "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, row string, list string").repartition(4)
    got = {}
    for r in ann.search(df, list_rows=300, block_rows=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        score = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
        ids = np.array([i for i in range(1500) if i != q])
        best = ids[np.lexsort((ids, -score[ids]))][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(score[f[1]] - f[2]) < 1e-12 for f in found)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hits += len(set(best.tolist()) & {f[1] for f in found})
    assert hits >= 0.97 * 20 * len(got)


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.7])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.search(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.limit(0)).count() == 0


def test_error_bound_holds_for_most_pairs():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((4000, 64)).astype(np.float32), rng.standard_normal((20, 64)).astype(np.float32)
    c, far = ann.k_means(x, 4, 1)
    book = ann.Codebook(64, c, far, ann.rotation(64, 1))
    at, bits, length, correction = book.encode(x)
    sign = np.unpackbits(bits, axis=1, count=64).astype(np.float32) * 2 - 1
    guess = (q @ book.rotation.T) @ sign.T * (length / correction / 8) + q @ c.T[:, at]
    spread = length * np.sqrt(1 - correction**2) / correction * 1.9 / np.sqrt(63)
    error = np.abs(guess - q @ x.T) / (spread * np.linalg.norm(q, axis=1)[:, None])
    assert (error <= 1).mean() > 0.9 and abs((guess - q @ x.T).mean()) < 0.05
