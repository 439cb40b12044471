"""Turn repair against an exhaustive search, token alignment against a direct walk, URL verdicts."""

import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from gradeframe.llm import alignment, queries, repair, urls
from gradeframe.llm.alignment import Csr

from fixtures import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """All edit texts up to a length, shortest cost first; rows: (role, text)."""
    seen, marked = set(), []
    for role, text in rows:
        tail = WORD.findall(text)
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "" if tail[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    best = None
    for inserts in product(range(3), repeat=len(rows) + 1):
        for own in product("DKR", repeat=len(rows)):
            cost = 2 * sum(inserts) + sum({"D": 3, "K": 0, "R": 2}[c] for c in own)
            cost += sum(c != "D" and m[2] == "truncated" for c, m in zip(own, marked, strict=True))
            if best and cost > best[0] or any(c != "D" and m[2] in ("blank", "duplicate") for c, m in zip(own, marked, strict=True)):
                continue
            letters = "".join("I" * n + c for n, c in zip(inserts, [*own, ""], strict=True))
            if best and (cost, letters) >= best[:2]:
                continue
            turns, at = [], 0
            slots = []
            for c in letters:
                if c == "I":
                    slots.append((None, ""))
                    continue
                if c != "D":
                    slots.append((marked[at][0] if c == "K" else None, marked[at][1]))
                at += 1
            for role, text in slots:
                before = turns[-1][0][:1] if turns else ""
                turns.append((role if role is not None else "assistant" if before == "u" else "user", text))
            if LEGAL.fullmatch("".join(r[:1] for r, _ in turns)) and all(r for r, _ in turns):
                best = (cost, letters, "\n".join(f"{r}:{t}" for r, t in turns))
    counts = Counter(m[2] for m in marked)
    illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return counts["blank"], counts["duplicate"], counts["truncated"], illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)


def test_repair_is_the_cheapest_and_first(spark):
    draw = random.Random(3)
    table, turns = [], {}
    for conv in range(60):
        n = draw.randint(0, 4)
        own = [(draw.choice(["user", "assistant", "system", "tool", "upper"]), draw.choice(["Well.", "Yes!", "no end", " ", "", "So?\n", "Ends. \x1c"])) for _ in range(n)]
        turns[conv] = own
        table += [(conv, i * 2, *r) for i, r in enumerate(own)]
    heads = conversations(spark, [(c, None, None, None) for c in turns])
    for block in (1, 3, 128):
        got = {r.conv_id: r for r in repair.repair(heads, conversations(spark, table), block=block).collect()}
        assert sorted(got) == sorted(turns)
        for conv, own in turns.items():
            r = got[conv]
            want = cheapest(own)
            assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want, (block, own)
            assert r.gaps == max(0, len(own) - 1)


def test_repair_of_nulls_ties_and_nothing(spark):
    empty = conversations(spark, [])
    assert repair.repair(empty).collect() == []
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (7, 3, "", "x."), (7, 3, "", "x."), (7, 9, "assistant", "y.")]
    got = {r.conv_id: r for r in repair.repair(conversations(spark, rows)).collect()}
    # a null role and text are one space, so the row is blank and goes; rows that repeat are duplicates
    assert (got[None].gaps, got[None].blank, got[None].duplicate, got[None].audit) == (0, 1, 1, "DKDI")
    # an empty role has no initial to keep
    assert (got[7].gaps, got[7].duplicate, got[7].audit) == (5, 1, "RDK")
    assert repair.repair(conversations(spark, [(1, 1, "user", "Hi.")]), empty).first()[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_is_cut_into_blocks(spark):
    n = 3_000
    rows = [(1, i, ("user", "assistant", "tool")[i * i % 3], f"turn {i % 700}" + "." * (i % 2)) for i in range(n)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "x" * 300_000 + ".")]
    whole = repair.repair(conversations(spark, rows), block=8_000).orderBy("conv_id").collect()
    for block in (1, 7, 128):
        assert repair.repair(conversations(spark, rows), block=block).orderBy("conv_id").collect() == whole
    assert whole[1].audit == "KK"


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! End?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    want = Counter()
    for c, t, role, text in rows:
        c, t_, role, text = (" " if v is None else v for v in (c, t, role, text))
        kind = zlib.crc32(f"{c}:{t_}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want[(t, "user" if kind == 4 else role, text)] += 2 if kind == 3 else 1
    got = Counter((r.turn, r.role, r.text) for r in repair.damaged(conversations(spark, rows)).collect())
    assert got == want


def test_csr_product():
    draw = np.random.default_rng(1)
    for height, width, depth in ((0, 3, 4), (5, 0, 2), (6, 40, 7), (30, 5, 30)):
        dense = [(draw.random(s) < 0.3) * draw.integers(1, 5, s) for s in ((height, width), (width, depth))]
        sparse = [Csr(np.r_[0, np.cumsum((d > 0).sum(1))], np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense]
        for other, want in ((sparse[1], dense[0] @ dense[1]),):
            got, full = sparse[0].dot(other), np.zeros_like(want)
            full[got.rows(), got.indices] = got.values
            assert (full == want).all()
        back, full = sparse[0].transposed(), np.zeros((width, height), int)
        full[back.rows(), back.indices] = back.values
        assert (full == dense[0].T).all()


def direct(rows, a_ids, b_ids, strings):
    """Per document, walked byte by byte: counts, groups, links that end together."""
    out = []
    for (_, text, *_), a, b in zip(rows, a_ids, b_ids, strict=True):
        data = (" " + text).encode() if text else b""
        if not text or any(b"".join(strings[side][i] for i in ids) != data for side, ids in enumerate((a, b))):
            out.append(([], [], []))
            continue
        ends = []
        for side, ids in enumerate((a, b)):
            at, own = 0, {}
            for n, i in enumerate(ids):
                at += len(strings[side][i])
                own[at] = n
            ends.append(own)
        common = sorted(ends[0].keys() & ends[1].keys())
        out.append((a, b, [(ends[0][e], ends[1][e]) for e in common]))
    return out


@pytest.fixture(scope="module")
def tokenizer_files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def test_alignment_against_a_direct_walk(spark, tokenizer_files):
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [*texts(), (30, "a ▁ b", "en", "x"), (31, " " * 12_000 + "x <s> <0x41> <|endoftext|>", "en", "x"), (32, "日本語" * 3_000, "ja", "x"), (33, "\r\n\x00 é", "fr", "x")]
    docs = documents(spark, rows)
    t = Tokenizer.from_file(tokenizer_files[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_files[2])
    strings = alignment.Tokenizers(open(tokenizer_files[0], "rb").read(), tokenizer_files[1], open(tokenizer_files[2], "rb").read()).strings
    a = [e.ids for e in t.encode_batch([" " + (r[1] or "") for r in rows], add_special_tokens=False)]
    b = [sp.encode(r[1] or "") for r in rows]
    want = direct(rows, a, b, strings)
    counts = Counter((x[i], y[j]) for x, y, links in want for i, j in links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    answers = Counter()
    for (doc_id, *_), (x, y, links) in zip(rows, want, strict=True):
        pairs = [(x[i], y[j]) for i, j in links]
        bounds = [(0, 0), *[(i + 1, j + 1) for i, j in links]]
        spelled = ";".join(f"{','.join(map(str, x[p:r]))}|{','.join(map(str, y[q:s]))}" for (p, q), (r, s) in zip(bounds, bounds[1:]))
        digest = hashlib.sha256(spelled.encode()).hexdigest() if x else ""
        answers[(doc_id, len(x), len(y), len(links), len(links), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest)] += 1
    got = alignment.link_counts(docs, *tokenizer_files)
    assert Counter(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == answers
    assert sum(not x for x, _, _ in want) == 3  # null, empty, and the text whose mark the model reads as a space

    full = {r.doc_id: r for r in alignment.align(docs, *tokenizer_files).collect()}
    for (doc_id, *_), (x, y, links) in zip(rows, want, strict=True):
        r = full[doc_id]
        assert (r.a_ids, r.b_ids) == (x, y)
        assert [(s.a, s.b) for s in r.links if s.together] == links
        ends = [np.r_[0, np.cumsum([len(strings[side][i]) for i in ids])] for side, ids in enumerate((x, y))]
        assert all(s.bytes == min(ends[0][s.a + 1], ends[1][s.b + 1]) - max(ends[0][s.a], ends[1][s.b]) for s in r.links[:2_000])
        assert sum(s.bytes for s in r.links) == ends[0][-1]  # every byte lies in one token of each
        inside = [(g.b_from, g.b_to) for g in r.groups for _ in range(g.a_from, g.a_to)]
        assert [(g.b_from, g.b_to) for g in r.group_links] == inside
    assert alignment.link_counts(documents(spark, []), *tokenizer_files).collect() == []


def test_pairs_are_bounded_by_the_vocabularies(tokenizer_files):
    t = alignment.Tokenizers(open(tokenizer_files[0], "rb").read(), tokenizer_files[1], open(tokenizer_files[2], "rb").read())
    assert alignment.most_pairs(*t.strings) < 500_000
    assert alignment.most_pairs([b"ab", b"b"], [b"b", b"b", b"cab"]) == 2 + 2 + 2


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match("[^?#]*", rest[len(host) :])[0]


def test_urls_and_rules(spark):
    odd = [
        None, "", "no mark", "://", "http://", "HTTP://EXAMPLE.Org/es/A?b#c", "https://a.example.org/en/12", "https://example.org/en/2", "x://org", "x://org/", "x://org?q=/",
        "http://myorg/x", "http://a.com/de/1://b.org/", "http://É.com/fr/", "http://a.com#/de/", "http://com/de/", "http://x.net/" + "a1" * 50_000, "http://a\nb.com/de/", "http://a.com/d\ne/?x",
    ]
    draw = random.Random(5)
    common = [f"http{draw.choice(['', 's'])}://{draw.choice('abc')}.example.{draw.choice(['org', 'com', 'net'])}/{draw.choice(['en', 'es', 'de', 'fr'])}/{draw.randint(1, 99)}" for _ in range(600)]
    rows = [(i, u, "clash", "clash") for i, u in enumerate([*odd, *common, *odd])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, score string").repartition(4)
    labelled = urls.labelled_by(pages, queries.RULES)
    model = urls.fit(labelled, trees=3)
    got = {r.page_id: r for r in urls.judge(pages, model, queries.RULES).select("row.page_id", "host", "path", "rule", "verdict", "score").collect()}
    assert len(got) == len(rows)
    for i, url, *_ in rows:
        host, path = host_path(url)
        fits = [(h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert 0 <= r.score <= 1 and r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))
    # without labels, or with labels of one kind, the share of blocked ones decides
    none = urls.fit(labelled.where("false"))
    assert none.trees is None and {r.verdict for r in urls.judge(pages, none).collect()} == {"allow"}
    assert {r.verdict for r in urls.judge(pages, urls.fit(labelled.where("blocked"))).collect()} == {"block"}
    assert urls.judge(pages.limit(0), model).collect() == []


def test_features_and_statistics(spark):
    import math

    draw = random.Random(9)
    own = ["".join(draw.choices("abc01/.-=&?%#é\n", k=draw.randint(0, 40))) for _ in range(50)]
    rows = urls.described(spark.createDataFrame([(f"http://h.x/{u}",) for u in own], "url string")).select("row.url", "*").collect()
    for r in rows:
        counts, n = Counter(r.url), len(r.url)
        assert math.isclose(r.entropy, -sum(c / n * math.log2(c / n) for c in counts.values()), abs_tol=1e-9)
        assert r.digit_ratio == sum(c.isdigit() for c in r.url) / n and r.depth == sum(bool(p) for p in host_path(r.url)[1].split("/"))
        query = re.search(r"\?([^#]*)", r.url)
        assert r.parameters == sum(bool(p) for p in (query[1].split("&") if query else ()))
    labels = [(f"http://{'ab'[i % 2]}.x/p{i}", i % 2 == 0 or i % 7 == 0) for i in range(40)]
    table = urls.fit(spark.createDataFrame(labels, "url string, blocked boolean"), trees=1).statistics
    level = {(r.n, r.blocked) for r in table.where("level = 'suffix2'").collect()}
    assert level == {(20, 20), (20, sum(i % 7 == 0 for i in range(1, 40, 2)))}
    assert all(sum(f.n for f in r.folds.values()) == r.n for r in table.collect())


def test_held_out_urls(spark):
    """Labels that host suffix and segment decide are found again on URLs not learned from."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = urls.labelled_by(pages, queries.RULES)
    held = "crc32(url) % 4 = 0"
    found = urls.judge(labelled.where(held), urls.fit(labelled.where(f"NOT {held}"))).selectExpr("row.blocked = (verdict = 'block') AS right").collect()
    assert sum(r.right for r in found) / len(found) > 0.85
