"""Language, repetition rules and BPE, whole texts at a time."""

import hashlib
import random

import pytest
from fixtures import documents, texts, words

from gradeframe.llm import bpe, langid, quality, queries

SMALL = "/root/testdata/sf0.001"


def test_languages_of_held_out_documents(spark):
    got = queries.op1_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id")
    held = got.where("held_out").select("lang_pred", "lang").collect()
    assert len(held) > 20
    assert sum(r[0] == r[1] for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "es", "ja", "ru"]
    got = {r["doc"]["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {5, 6, 7, 20}
    assert got[18]["lang_pred"] == "ja" and got[22]["lang_pred"] == "ru"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_foreign_span_inside_a_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["lang"]: r["text"] for r in docs.where("n_chars > 2000 and lang in ('en', 'de')").collect()}
    de = " ".join(w for w in rows["de"].split() if w.isalpha())[:900].rsplit(" ", 1)[0]
    en = " ".join(w for w in rows["en"].split() if w.isalpha())[:1800].rsplit(" ", 1)[0]
    mixed = documents(spark, [(1, f"{en} {de}", None, None)])
    got = langid.identify(mixed, langid.fit(docs)).first()
    assert got["lang_pred"] == "en"
    spans = [(s["lang"], s["n_words"]) for s in got["spans"]]
    assert sum(n for lang, n in spans if lang == "de") > 0.7 * len(de.split())
    assert len(spans) < 12 and sum(n for _, n in spans) == got["n_words"]


def repetition(text):
    """The rules by direct counting."""
    w = words(text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>")}
    lines = [x for x in (text or "").split("\n") if words(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out |= {"n_lines": len(lines), "n_dup_lines": len(again), "line_chars": sum(map(len, lines)), "dup_line_chars": sum(map(len, again))}
    for n in quality.REPEATED:
        seen, cover = set(), set()
        for i in range(len(w) - n + 1):
            gram = tuple(w[i : i + n])
            if gram in seen:
                cover |= set(range(i, i + n))
            seen.add(gram)
        out[f"dup_chars_{n}"] = sum(len(w[i]) for i in cover)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 5000 else set()
    out["n_repeat_words"] = len({j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)})
    return out


def test_repetition_rules(spark):
    rng = random.Random(4)
    rows = texts()
    for i in range(40):
        some = [rng.choice(["aa", "b", "ccc", "dä"]) for _ in range(rng.randrange(60))]
        rows.append((100 + i, " ".join(some) + rng.choice(["", "\n" + " ".join(some[:12])]), "en", "a"))
    got = quality.repetition(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {(r[0], tuple(sorted(repetition(r[1]).items()))) for r in rows}
    names = sorted(repetition("x"))
    assert {(r["doc_id"], tuple((c, r[c]) for c in names)) for r in got} == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[1] and kept[15] and not kept[5] and not kept[13] and not kept[19]


@pytest.fixture(scope="module")
def reference_tokenizer():
    import tokenizers

    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library(reference_tokenizer):
    own = bpe.Bpe(open(queries.tokenizer_path(), "rb").read(), room=50)
    rng = random.Random(1)
    pool = list("abcdeftnoiu  \n\t'srlvem.,!?0123½²éüßñ語日本ж́  ​\x1c\x85🙂") + ["the ", "'s", "<|endoftext|>", "  ", " \n"]
    cases = [t for _, t, _, _ in texts() if t] + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in cases:
        want = reference_tokenizer.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert got == want, text[:80]
        assert own.decode(got) == reference_tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_documents(spark, reference_tokenizer):
    docs = documents(spark)
    path = queries.tokenizer_path()
    got = bpe.encode_documents(docs, path, ("ids", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    by_id = {(r["doc_id"], tuple(r["ids"])) for r in got}
    assert by_id == {(i, tuple(reference_tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in texts()}
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()
    assert sorted(((r["doc_id"] or -1, r["text"]) for r in back)) == sorted((i or -1, t or "") for i, t, _, _ in texts())
    assert bpe.encode_documents(docs.limit(0), path).count() == 0
