"""The stages, each against what it is to do with its own input."""

import hashlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, words
from test_dedup import groups, order, removal, texts

import __spark_entry__ as entry
from gradeframe.llm import bpe, common, suffix
from gradeframe.llm.queries import tokenizer_path
from gradeframe.session import written

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [written(documents(spark), "test-pipeline")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SMALL), "test-pipeline"))
    return docs


def plain(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 6
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language_stage(stages):
    gone = {r[0] for r in plain(stages[0])} - {r[0] for r in plain(stages[1])}
    assert gone == {5, 6, 7, 20}


def test_language_stage_keeps_mixed_texts(spark):
    own = [("en", "river stone cloud "), ("ru", "книга земля город "), ("el", "λόγος κόσμο νερόν ")]
    rows = [(i, text * 20, lang, "a") for i, (lang, text) in enumerate(own)]
    rows += [(3, "".join(text * 20 for _, text in own), None, "a"), (4, "წიგნი მიწაა " * 20, None, "a")]
    rows += [(5, own[0][1] * 10 + "წიგნი მიწაა ქალაქ " * 20, None, "a")]  # a third is learned
    got = corpus_pipeline.language_id(spark, documents(spark, rows), SMALL)
    assert {r["doc_id"] for r in got.collect()} == {0, 1, 2, 3}


def test_near_duplicate_stage(stages):
    before, after = plain(stages[1]), plain(stages[2])
    found = groups(before, 5, 80)
    assert len(after) == len({c for _, _, c in found})
    assert {r[0] for r in after} == {c for _, _, c in found}


def test_repeated_strings_stage(stages):
    before, after = plain(stages[2]), {r[0]: r[1] for r in plain(stages[3])}
    for (i, text, _, _), (_, _, removed, _, _) in zip(before, removal(before)):
        if not removed:
            assert after[i] == text
        elif i in after:
            assert len(after[i].encode()) <= len(text.encode()) - removed and words(after[i])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_repeated_strings_stage_cuts_nothing_else(spark):
    shared = "й" + "".join(chr(0x430 + i % 31) for i in range(40)) + "é"
    rows = [
        (1, "first " + shared + "è", "en", "a"),
        (2, "genuine � mark " + shared + "ê and another � mark 日本", "en", "a"),  # ê shares its first byte with è
        (3, "untouched � mark", "en", "a"),
        (4, None, "en", "a"),
        (5, " \t\n", "en", "a"),
        (6, "", "en", "a"),
        (7, shared, "en", "a"),  # all of it repeats
    ]
    got = corpus_pipeline.suffix_dedup(spark, documents(spark, rows), SMALL).collect()
    want = {r[0]: r[1] for r in rows[:6]} | {2: "genuine � mark and another � mark 日本"}
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_whole_characters():
    data = "a日é😀z".encode() + b"\x80\x80\xe6\x97z"  # behind z: bytes of no character
    for first, stop, want in [(0, 1, (0, 1)), (2, 3, (1, 4)), (3, 5, (1, 6)), (9, 10, (6, 10)), (6, 7, (6, 10)), (11, 12, (11, 12)), (12, 14, (12, 14))]:
        off = np.zeros(len(data), bool)
        off[first:stop] = True
        suffix.whole_characters(data, off)
        assert np.flatnonzero(off).tolist() == list(range(*want))


def test_mix_stage(stages):
    before, after = {r[0]: r for r in plain(stages[3])}, plain(stages[4])
    assert after and all(before[r[0]] == r for r in after)
    assert max(sum(r[0] == i for r in after) for i in before) <= 2
    taken = sum(len(words(r[1])) for r in after)
    assert taken >= 1.4 * sum(len(words(r[1])) for r in before.values())


def test_mix_shuffles_texts_once_while_it_is_written(spark):
    """The files of two shuffles of all texts, beside a copy, took more disk than the stage has."""
    rows = corpus_pipeline.mix(spark, documents(spark), SMALL)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan, plan


def test_mix_is_written_in_the_order_of_its_schedule(spark, monkeypatch):
    """Any quarter of the output holds the sources as the whole does, however many files it has."""
    rows = [(i, f"{i} " + "w " * (150 + i * 37 % 300), "en", "abc"[i % 3]) for i in range(900)]
    outputs = []
    for most in (1 << 17, 40):
        monkeypatch.setattr(corpus_pipeline, "SLOTS_PER_PART", most)
        outputs.append([(r["doc_id"], r["source"], len(words(r["text"]))) for r in corpus_pipeline.mix(spark, documents(spark, rows), SMALL).collect()])
    out = outputs[0]
    assert out == outputs[1]

    def shares(part):
        whole = sum(n for _, _, n in part)
        return [sum(n for _, s, n in part if s == source) / whole for source in "abc"]

    quarter = len(out) // 4
    for k in range(4):
        assert shares(out[k * quarter : (k + 1) * quarter]) == pytest.approx(shares(out), abs=0.03)
    assert corpus_pipeline.mix(spark, documents(spark, []), SMALL).count() == 0


def test_encoding_stage(stages):
    import tokenizers

    from gradeframe.llm.queries import tokenizer_path

    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = [(r[0], library.encode(r[1], add_special_tokens=False).ids) for r in plain(stages[4])]
    assert order((r["doc_id"], r["ids"]) for r in stages[5].collect()) == order(want)


def test_encoding_stage_decodes(stages, spark):
    want = [(r[0], hashlib.sha256(r[1].encode()).hexdigest(), True) for r in plain(stages[4])]
    assert order((r["doc_id"], r["decoded_sha256"], r["restored"]) for r in stages[5].collect()) == order(want)
    broken = documents(spark, [(1, "a", "en", "a"), (2, None, "en", "a")]).selectExpr("doc_id", "if(doc_id = 1, cast(x'61ff' as string), text) as text")
    assert {r["doc_id"]: r["restored"] for r in corpus_pipeline.encode(spark, broken, SMALL).collect()} == {1: False, 2: True}


def test_entry_lists_the_corpus_queries(spark):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.queries()["pipeline"](spark, SMALL).count() > 0
    assert texts() and order([])== []


def test_batches_for_python_are_bounded_by_bytes(stages, spark):
    """10,000 rows made a batch, so it grew with the texts: 40 MB here."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    rows = spark.range(0, 10_000, 1, 1).selectExpr("struct(id, repeat('x', 2000) AS text) AS doc", "repeat('x', 2000) AS text")
    found = rows.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    assert sum(r.n for r in found) == 10_000
    assert max(r.bytes for r in found) <= corpus_pipeline.ARROW_BYTES + (64 << 10)
    one = spark.range(0, 3, 1, 1).selectExpr(f"repeat('x', {2 * corpus_pipeline.ARROW_BYTES}) AS text")
    assert sum(r.n for r in one.mapInArrow(sizes, "n bigint, bytes bigint").collect()) == 3  # a longer text is a batch


def test_a_limit_of_the_session_is_kept(spark):
    old = spark.conf.get(common.ARROW_BYTES, None)
    spark.conf.set(common.ARROW_BYTES, "12345")
    try:
        common.bounded_batches(spark, 1 << 20)
        assert spark.conf.get(common.ARROW_BYTES) == "12345"
    finally:
        spark.conf.set(common.ARROW_BYTES, old) if old is not None else spark.conf.unset(common.ARROW_BYTES)


def test_workers_drop_the_tokenizer_of_an_earlier_stage(spark, monkeypatch):
    with open(tokenizer_path(), "rb") as f:
        description = f.read()
    assert bpe.loaded(description, 100) is bpe.loaded(description, 100)
    asked = []
    rows = spark.createDataFrame([(1,)], "n bigint")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: asked.append(run))
    for keeps, held in ((True, 1), (False, 0)):
        common.mapped(rows, lambda batches: ((b, len(common.KEPT)) for b in batches), "n bigint", keeps=keeps)
        assert list(asked[-1](iter("ab"))) == [("a", held), ("b", held)]
