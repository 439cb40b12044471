"""Near-duplicates and repeated byte strings against brute force."""

import hashlib
import re

import numpy as np
import pytest
from fixtures import documents, texts, words

from gradeframe.llm import minmax, queries, suffix

SMALL = "/root/testdata/sf0.001"


def corpus(spark):
    rows = [(r["doc_id"] + 1000, r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return texts() + rows


def shingles(text, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, n, percent):
    sets = [shingles(t, n) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    roots = [root(i) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    least = {r: min((ids[i] for i in range(len(rows)) if roots[i] == r), key=lambda x: (x is not None, x or 0)) for r in set(roots)}
    return [(ids[i], len(sets[i]), least[roots[i]]) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, n, percent):
    rows = corpus(spark)
    got = minmax.near_duplicates(documents(spark, rows), n, percent).collect()
    assert order((r["doc"]["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == order(groups(rows, n, percent))
    stays = [r for r in got if r["stays"]]
    assert len(stays) == len({(r["component_id"], r["n_shingles"] == 0 and r["rid"]) for r in got})
    assert {r["doc"]["rid"] for r in got} == {"clash"}


def test_long_chains_are_one_component(spark):
    """Each text is near the next one only; the ends share nothing."""
    rows = [(i, " ".join(f"t{k}" for k in range(i * 3, i * 3 + 60)), "en", "a") for i in range(40)]
    got = minmax.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert {r["component_id"] for r in got} == {0}


def test_no_documents(spark):
    assert minmax.near_duplicates(documents(spark, [])).count() == 0
    assert suffix.without_repeats(documents(spark, [])).count() == 0


def removal(rows):
    """What an earlier document's 50-byte strings cover, by a table of all strings."""
    key = lambda i: (i is None, i or 0)
    first = {}
    data = [(i, (t or "").encode()) for i, t, _, _ in rows]
    for i, b in data:
        for q in range(len(b) - 49):
            s = b[q : q + 50]
            if s not in first or key(i) < key(first[s]):
                first[s] = i
    out = []
    for i, b in data:
        off = bytearray(len(b))
        for q in range(len(b) - 49):
            if key(first[b[q : q + 50]]) < key(i):
                off[q : q + 50] = b"\1" * 50
        kept = bytes(c for c, o in zip(b, off) if not o)
        spans = len(re.findall(b"\1+", bytes(off)))
        out.append((i, len(b), sum(off), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return [(r["doc"]["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()]


def test_repeated_strings_equal_brute_force(spark, monkeypatch):
    rows = corpus(spark)
    assert order(found(suffix.without_repeats(documents(spark, rows)))) == order(removal(rows))


def test_strings_of_exactly_fifty_bytes(spark):
    base = "".join(f"{i:03d}/" for i in range(200))
    rows = [(1, base, "en", "a")]
    for n in (49, 50, 51, 60, 72, 73, 100, 199):
        rows.append((n, f"<{n}>" + base[17 : 17 + n] + f"[{n}]", "en", "a"))
        rows.append((n + 1000, base[-n:] + f"[{n}", "en", "a"))
        rows.append((n + 2000, base[:n], "en", "a"))
    assert order(found(suffix.without_repeats(documents(spark, rows)))) == order(removal(rows))


def test_segments_of_a_long_text_agree(monkeypatch):
    """The names do not depend on where a text is cut."""
    data = b"".join(b"%d," % (i * i % 9973) for i in range(3000))
    whole = next(suffix.named([data]))
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    cut = list(suffix.named([data]))
    assert len(cut) > 10
    assert sum((n.byte.tolist() for n in cut), []) == whole.byte.tolist()
    every = lambda n: n.long(np.arange(len(n.at)))[0].tolist()
    assert sum((every(n) for n in cut), []) == every(whole)
    assert sum((n.around[n.place].tolist() for n in cut), []) == whole.around[whole.place].tolist()
    assert sum((n.key[n.place].tolist() for n in cut), []) == whole.key[whole.place].tolist()


def test_registered_queries(spark):
    rows = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op3_minmax_dedup(spark, SMALL).collect()
    assert order((r[0], r[1], r[2], r[3]) for r in got) == order((i, n, c, i == c) for i, n, c in groups(rows, 3, 85))
    assert order(tuple(r) for r in queries.op6_suffix_dedup(spark, SMALL).collect()) == order(removal(rows))
