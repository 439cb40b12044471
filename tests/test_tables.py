"""Sources, sinks, metrics, jobs and streaming on small fixtures."""

import base64
import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from gradeframe import build_prompt
from gradeframe.functions import fixed as K
from gradeframe.operators import generation, judging, metrics, records
from gradeframe.operators.evaluate import evaluate_responses, judge_trials
from gradeframe.plans import jobs
from gradeframe.plans.catalog import QUERIES
from gradeframe.session import written
from gradeframe.sources import readers, sinks
from gradeframe.sources.json_ranges import json_records
from gradeframe.streaming import incremental


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def jsonl(path, rows):
    return write(path, "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))


SCHEMA = "answer string, parsed_answer string, question string, verify boolean"
LINES = [
    '{"answer":"1","parsed_answer":"é","question":"q","verify":true}', "", "   ",
    '{"answer":"2","verify":"true"}', '{"answer":"3","verify":1}', '{"answer":null,"verify":false}',
]


def test_jsonl(spark, folder):
    good = write(f"{folder}/good.jsonl", "\n".join(LINES))
    rows = readers.read_jsonl(spark, good, SCHEMA).collect()
    assert [(r.answer, r.verify) for r in rows] == [("1", True), ("2", None), ("3", None), (None, False)]
    assert rows[0].parsed_answer == "é"
    for broken in ('{"answer":', '{"answer":"9"} tail', "[1]"):
        bad = write(f"{folder}/bad{len(broken)}.jsonl", "\n".join([*LINES, broken]))
        assert readers.read_jsonl_tolerant(spark, bad, SCHEMA).count() == 4
        with pytest.raises(Exception, match="not a JSON object"):
            readers.read_jsonl(spark, bad, SCHEMA).collect()


def test_key_presence(spark, folder):
    path = write(f"{folder}/k.jsonl", '{"answer":null,"parsed_answer":"1","question":"q"}\n{"parsed_answer":"1","question":"q"}\n')
    rows = readers.read_jsonl_with_keys(spark, path, SCHEMA)
    assert records.with_required_fields(rows, raw="raw").count() == 1
    assert records.with_required_fields(rows).count() == 0


def test_json_benchmarks(spark, folder):
    records_ = [{"question": "a", "image": "i.png", "answer": "1", "choices": ["x", "y"]},
                {"question": "b", "image": "j.png", "answer": "2", "choices": None}]
    write(f"{folder}/MathVista/testmini.json", json.dumps({"7": records_[0], "9": records_[1]}, indent=1))
    rows = readers.read_benchmark(spark, K.MATHVISTA, folder).orderBy("record_id").collect()
    assert [(r.record_id, r.question, r.choices) for r in rows] == [("7", "a", ["x", "y"]), ("9", "b", None)]
    write(f"{folder}/MathVerse/testmini.json", json.dumps([{"question_for_eval": "e", "image": "i", "answer": "3"}] * 2, indent=1))
    assert readers.read_benchmark(spark, K.MATHVERSE, folder).count() == 2
    jsonl(f"{folder}/MATH-V/data/test.jsonl", [{"id": "1", "question": "q", "options": [], "image": "x", "answer": "4"}])
    assert readers.read_benchmark(spark, K.MATH_V, folder).first().answer == "4"
    sinks.write_parquet(spark.createDataFrame([("p",)], "question string"), f"{folder}/table")
    assert readers.read_benchmark(spark, K.DYNAMATH, path=f"{folder}/table").first().dataset == K.DYNAMATH


def test_images(spark, folder):
    os.makedirs(f"{folder}/im/sub")
    for name, data in (("a.png", b"\x00\x01" * 100), ("sub/b.jpg", b"xyz")):
        with open(f"{folder}/im/{name}", "wb") as f:
            f.write(data)
    images = readers.read_images(spark, f"{folder}/im")
    got = {os.path.basename(r.path): r for r in images.collect()}
    assert base64.b64decode(got["a.png"].image_base64) == b"\x00\x01" * 100
    assert got["b.jpg"].image_format == "jpg"
    requests = spark.createDataFrame([(1, f"{folder}/im/a.png"), (2, "none.png")], "id int, image string")
    joined = {r.id: r.image_base64 for r in judging.with_images(requests, images).collect()}
    assert joined[1] and joined[2] is None


def test_file_ordinal(spark, folder):
    for f in range(3):
        jsonl(f"{folder}/n{f}.jsonl", [{"answer": str(i), "question": "x" * 50} for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.with_file_ordinal(spark.read.text(folder))
        got = rows.select("ord", F.get_json_object("value", "$.answer").cast("int").alias("a")).collect()
        assert len(got) == 9000 and all(r.ord == r.a for r in got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_ordinal_whatever_the_splits(spark, folder):
    """The result may be read when files are cut elsewhere than when it was planned."""
    jsonl(f"{folder}/n.jsonl", [{"answer": str(i)} for i in range(20_000)])
    got = []
    for first, second in ((1, 7), (4, 11)):
        spark.conf.set("spark.sql.files.minPartitionNum", str(first))
        try:
            rows = readers.with_file_ordinal(spark.read.text(folder))
            spark.conf.set("spark.sql.files.minPartitionNum", str(second))
            got.append(sorted((r.ord, r.value) for r in rows.collect()))
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got[0] == got[1] == [(i, json.dumps({"answer": str(i)})) for i in range(20_000)]


def _odd_json(draw, depth=3):
    """A value with brackets, quotes and escapes in its strings."""
    kind = draw.random()
    if depth == 0 or kind < 0.4:
        return "".join(draw.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", " ", "日"]) for _ in range(draw.randint(0, 12)))
    if kind < 0.7:
        return [_odd_json(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    return {_odd_json(draw, 0): _odd_json(draw, depth - 1) for _ in range(draw.randint(0, 3))}


@pytest.mark.parametrize("indent, split", [(None, 100), (2, 300)])
def test_json_files_in_many_ranges(spark, folder, indent, split):
    import random

    draw = random.Random(split)
    files = {}
    for name in ("a", "b", "none"):
        rows = [{"answer": _odd_json(draw, 0), "n": i, "more": _odd_json(draw)} for i in range(0 if name == "none" else 30)]
        files[name] = rows
        for shape, value in (("list", rows), ("keyed", {f'{name}}}"{i}': r for i, r in enumerate(rows)})):
            os.makedirs(f"{folder}/{shape}", exist_ok=True)
            with open(f"{folder}/{shape}/{name}.json", "w", encoding="utf-8") as f:
                f.write(json.dumps(value, indent=indent, ensure_ascii=draw.random() < 0.5) + ("\n" if name == "a" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.read_json_list(spark, f"{folder}/list", "answer string, n int").collect()
        assert sorted((r.n, r.answer) for r in got) == sorted((r["n"], r["answer"]) for rows in files.values() for r in rows)
        got = readers.read_json_keyed(spark, f"{folder}/keyed", "answer string, n int", "id").collect()
        assert sorted((r.id, r.n, r.answer) for r in got) == sorted((f'{name}}}"{i}', r["n"], r["answer"]) for name, rows in files.items() for i, r in enumerate(rows))
        places = json_records(spark, f"{folder}/list/a.json").orderBy("no").collect()
        assert [json.loads(r.text.lstrip("[, \n"))["n"] for r in places] == list(range(30)) == [r.no for r in places]
        assert spark.read.option("lineSep", "}").text(f"{folder}/list/a.json").rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", [
    '[{"answer": "1"}', '{"a": {"answer": "1"}\n', '[{"answer": "1}]', '[{"answer": "1"}] x', '[{"answer": "1"} {"answer": "2"}]', '[1, {"answer": "1"}]',
])
def test_damaged_json_files(spark, folder, text):
    with open(f"{folder}/bad.json", "w") as f:
        f.write(text)
    read = readers.read_json_keyed if text[0] == "{" else readers.read_json_list
    with pytest.raises(Exception, match="file is not one list|not a JSON record|Malformed|MALFORMED"):
        read(spark, f"{folder}/bad.json", "answer string").collect()


def test_append_and_split(spark, folder):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "answer string, is_match boolean")
    sinks.append_jsonl(df, f"{folder}/out")
    sinks.append_jsonl(df, f"{folder}/out")
    assert spark.read.schema("answer string").json(f"{folder}/out").count() == 6
    for _ in range(2):
        sinks.write_split(df, f"{folder}/split")
    back = spark.read.schema("answer string, is_match boolean, split string").json(f"{folder}/split")
    assert {(r.answer, r.is_match, r.split) for r in back.collect()} == {
        ("a", True, "filtered_match"), ("b", False, "filtered_mismatch"), ("c", None, "filtered_mismatch")}


def test_prompts(spark):
    rows = [
        (1, K.MATH_V, "q", ["1", "2", "3", "4", "5"], None, "i.png", None, None),
        (2, K.MATH_V, "q", list("ABCDE"), None, "i.png", None, None),
        (3, K.MATHVISTA, "q", None, ["x"], "i.png", None, None),
        (4, K.OLYMPIAD, "see <img_3> and <img_12>", None, None, None, "OE_MM_en", "ctx"),
        (5, K.OLYMPIAD, "q", None, None, None, "OE_TO_en", "ctx"),
        (6, K.OLYMPIAD, "q", None, None, None, "OE_TO_en", None),
        (7, K.DYNAMATH, "q", None, None, "/abs/i.png", None, None),
    ]
    df = spark.createDataFrame(
        rows, "id int, dataset string, question string, options array<string>, choices array<string>, image string, `from` string, context string"
    )
    got = {r.id: r for r in build_prompt(df, system_prompt="S", root="R/").collect()}
    assert got[1].prompt_question == "q\n(A) 1\n(B) 2\n(C) 3\n(D) 4\n(E) 5\n"
    assert got[2].prompt_question == "q"
    assert got[3].prompt_question == "q\n\nPlease select the correct answer from the following options:\n(A) x"
    assert got[3].images == ["R/MathVista/i.png"]
    assert [p.image for p in got[4].messages[0].content[:2]] == [
        f"{K.OLYMPIAD_IMAGE_DIR}/img_3.jpg", f"{K.OLYMPIAD_IMAGE_DIR}/img_12.jpg"]
    assert len(got[4].messages) == 1 and got[4].messages[0].content[0].min_pixels == 224 * 224
    assert got[5].prompt_question == "ctx\n\nq" and got[6].prompt_question == "q"
    assert [m.role for m in got[5].messages] == ["system", "user"] and len(got[5].messages[1].content) == 1
    assert got[7].images == ["/abs/i.png"]
    assert got[7].messages[1].content[0].max_pixels == 1280 * 28 * 28
    assert got[7].prompt == "system: S\nuser: <image>q\nassistant: "


def trials(spark, spec):
    """spec: image number -> list of (verify, matches)."""
    rows = [
        (f"d/image{k}.png", "q", "5", "5.0" if ok else "6", v)
        for k, flags in spec.items()
        for v, ok in flags
    ]
    rows.append(("d/other.png", "q", "5", "5", True))
    return spark.createDataFrame(rows, "image string, question string, answer string, parsed_answer string, verify boolean")


def test_trial_metrics(spark):
    df = trials(spark, {
        1: [(True, True)] * 10,
        2: [(True, True)] * 9 + [(True, False)],
        3: [(False, True)] + [(True, True)] * 9,
        4: [(True, True)] * 11,
    })
    all_rows = metrics.trial_summary(judge_trials(df)).first()
    assert (all_rows.qualified_count, all_rows.match_qualified_images, all_rows.total_file_records) == (3, 2, 42)
    assert (all_rows.match_count, all_rows.mismatch_count, all_rows.verify_true_records) == (40, 1, 41)
    assert all_rows.match_ratio == pytest.approx(2 / 3)
    assert all_rows.verify_true_ratio == pytest.approx(2 / 501)
    verified = metrics.trial_summary(judge_trials(df, require_verified=True)).first()
    assert (verified.qualified_count, verified.match_qualified_images, verified.total_records) == (2, 1, 40)
    strict = metrics.strict_trials(df).first()
    assert strict.qualified_count == 2 and strict.acc == pytest.approx(2 / 501)
    assert metrics.strict_trials(df, total=0).first().acc == 0.0


def test_metric_identities(spark):
    rows = [(i, f"a/image{i % 50}.png", i % 3 != 0, "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "ord bigint, image string, verify boolean, dataset string")
    acc = metrics.accuracy(df).first().acc
    assert metrics.sharded_accuracy(df, batch_size=100, n_shards=4).first().acc == pytest.approx(acc)
    assert metrics.sharded_accuracy(df, batch_size=1000, n_shards=1).first().acc == pytest.approx(acc)
    one_trial = df.withColumn("image", F.concat(F.lit("a/image"), "ord", F.lit(".png")))
    assert metrics.worst_case_accuracy(one_trial).first().acc == pytest.approx(acc)
    per = {r.dataset: r.acc for r in metrics.accuracy(df, ["dataset"]).collect()}
    assert metrics.mean_accuracy(df).first().macro_acc == pytest.approx(sum(per.values()) / 2)
    by = {r.dataset: r.acc for r in metrics.sharded_accuracy(
        df.withColumn("ord", F.floor(F.col("ord") / 2)), ["dataset"], batch_size=50, n_shards=5).collect()}
    assert by == pytest.approx(per)
    empty = df.filter("false")
    assert metrics.accuracy(empty).first().acc == 0.0
    assert metrics.worst_case_accuracy(empty).first().acc == 0.0


def shard_model(flags, batch, shards):
    total = n = 0
    for i in range(0, len(flags), batch):
        part = flags[i : i + batch]
        size = -(-len(part) // shards)
        accs = [sum(part[j : j + size]) / len(part[j : j + size]) for j in range(0, len(part), size)]
        total += sum(accs) / len(accs) * len(part)
        n += len(part)
    return 100 * total / n


def test_uneven_shards(spark):
    flags = [i % 7 < 3 for i in range(103)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "ord bigint, verify boolean")
    for batch, shards in ((10, 3), (50, 8), (7, 4)):
        got = metrics.sharded_accuracy(df, batch_size=batch, n_shards=shards).first().acc
        assert got == pytest.approx(shard_model(flags, batch, shards))


def test_published_means(spark):
    # five accuracies per model and their published mean
    table = [(40.5, 68.0, 25.7, 45.5, 21.8, 41.2), (42.7, 68.0, 26.4, 48.2, 22.4, 48.5),
             (41.8, 73.7, 28.4, 46.4, 17.8, 42.7), (43.4, 66.7, 31.4, 50.1, 22.6, 46.4)]
    rows = [(m, d, x) for m, (_, *accs) in enumerate(table) for d, x in enumerate(accs)]
    df = spark.createDataFrame(rows, "model int, dataset int, acc double")
    got = {r.model: r.mean for r in df.groupBy("model").agg(F.avg("acc").alias("mean")).collect()}
    for m, (mean, *_) in enumerate(table):
        assert got[m] == pytest.approx(mean, abs=0.1)


def test_process_result_files(spark, folder):
    base = f"{folder}/in"
    jsonl(f"{base}/MathVista_a.jsonl", [
        {"answer": "B", "parsed_answer": "$B$", "question": "q", "choices": ["x", "y"]},
        {"answer": "x", "parsed_answer": "B", "question": "q", "choices": ["x", "y"]},
        {"answer": "x", "question": "q"},
    ])
    jsonl(f"{base}/DynaMath.jsonl", [
        {"answer": "5", "parsed_answer": "$5$" if k else "4", "question": "q", "verify": True, "image": f"a/image{k}.png"}
        for k in range(3) for _ in range(10)
    ])
    jsonl(f"{base}/We-Math.jsonl", [{"answer": "1"}])
    jsonl(f"{base}/filtered_match_z.jsonl", [{"answer": "1"}])
    write(f"{base}/notes.txt", "nothing")
    got = {r.file: r for r in jobs.process_result_files(spark, base, f"{folder}/out").collect()}
    assert set(got) == {"MathVista_a.jsonl", "DynaMath.jsonl"}
    vista, trial = got["MathVista_a.jsonl"], got["DynaMath.jsonl"]
    assert (vista.match_count, vista.mismatch_count, vista.total_records, vista.match_ratio_text) == (1, 1, 3, "33.33")
    assert (trial.qualified_count, trial.match_qualified_images, trial.match_ratio_text) == (3, 2, "66.67")
    split = spark.read.schema("answer string, is_match boolean, file string, split string").json(f"{folder}/out/trials")
    assert {(r.split, r["count"]) for r in split.groupBy("split").count().collect()} == {
        ("filtered_match", 20), ("filtered_mismatch", 10)}
    one = jobs.process_result_file(spark, f"{base}/MathVista_a.jsonl", f"{folder}/one").collect()
    assert [r.file for r in one] == ["MathVista_a.jsonl"]


def test_evaluate_jsonl(spark, folder):
    path = jsonl(f"{folder}/MathVerse.v2.jsonl", [{"answer": "1", "resp": "\\boxed{1}"}, {"answer": "1", "resp": "\\boxed{2}"}])
    acc, rows = jobs.evaluate_jsonl(spark, path)
    assert acc.first().asDict() == {"dataset": "MathVerse", "acc": 50.0, "acc_text": "50.0000"}
    assert rows.count() == 2
    assert jobs.evaluate_jsonl(spark, f"{folder}/absent.jsonl") == (None, None)
    bad = write(f"{folder}/Bad.jsonl", '{"answer":"1","resp":"x"}\n{"answer"\n')
    assert jobs.evaluate_jsonl(spark, bad) == (None, None)


def test_generate_and_evaluate(spark, folder):
    def fake_model(batches):
        for frame in batches:
            n = frame["prompt"].str.len() % 2
            yield frame[["id"]].assign(
                resp=n.map({0: "\\boxed{5}", 1: "<think>hm"}),
                finish_reason=n.map({0: "stop", 1: "length"}),
            )

    def fake_salvage(batches):
        for frame in batches:
            cue = "</think>think is over, now give the **Final Answer**"
            assert frame["prompt"].str.endswith(cue).all()
            yield frame[["id"]].assign(resp=" \\boxed{5}", finish_reason="stop")

    rows = [(i, i, K.DYNAMATH if i % 2 else K.MATHVERSE, "q" * i, "q" * i, f"a/image{i % 4}.png", "5" if i < 8 else "6")
            for i in range(12)]
    df = spark.createDataFrame(rows, "id bigint, ord bigint, dataset string, question string, question_for_eval string, image string, answer string")
    evaluated, table = jobs.generate_and_evaluate(df, fake_model, fake_salvage, f"{folder}/out", first_n=10)
    got = {r.id: r for r in evaluated.collect()}
    assert len(got) == 10 and got[3].verify and not got[9].verify
    assert any("</think>think is over" in r.resp for r in got.values())
    accs = {r.dataset: r.acc for r in table.collect()}
    # images 1 and 3 of the trial benchmark: image1 has ids 1, 5, 9 and 9 is wrong
    assert accs == pytest.approx({K.DYNAMATH: 50.0, K.MATHVERSE: 80.0, "Mean": 65.0})
    assert spark.read.schema("id bigint").json(f"{folder}/out").count() == 10


def test_salvage_without_reply_and_judge_without_response(spark):
    df = spark.createDataFrame([(1, "<think>x", "length"), (2, "<think>x", "stop"), (3, "<think>x</think>", "length")],
                               "id int, resp string, finish_reason string")
    replies = spark.createDataFrame([(2, "R"), (3, "R")], "id int, resp string")
    got = {r.id: r.resp for r in generation.with_salvaged(df, replies).collect()}
    assert got == {1: "<think>x</think>think is over, now give the **Final Answer**", 2: "<think>x", 3: "<think>x</think>"}
    responses = spark.createDataFrame([(1, "\\boxed{1}")], "id int, judge_resp string")
    rows = spark.createDataFrame([(1, "c", "1"), (2, "c", "1")], "id int, completion string, solution string")
    got = {r.id: r.external_cap_verify for r in judging.score_judged(rows, ["external_cap_verify"], caption=responses).collect()}
    assert got == {1: 1.0, 2: 0.0}
    with pytest.raises(Exception, match="more than one response"):
        judging.score_judged(rows, ["external_cap_verify"], caption=responses.unionByName(responses)).collect()


def test_stream_equals_batch_and_goes_on(spark, folder):
    def arrive(n, rows):
        jsonl(f"{folder}/in/MathVerse.{n}.jsonl", rows)

    schema = "answer string, resp string"
    arrive(1, [{"answer": "1", "resp": "\\boxed{1}"}, {"answer": "2", "resp": "\\boxed{1}"}])
    table, checkpoint = f"{folder}/totals", f"{folder}/check"

    def run():
        rows = incremental.stream_responses(spark, f"{folder}/in", schema)
        query = incremental.start_running_accuracy(incremental.running_accuracy(rows), table, checkpoint)
        query.awaitTermination()
        return incremental.read_totals(spark, table).first().asDict()

    assert run() == {"dataset": "MathVerse", "n": 2, "n_correct": 1, "acc": 50.0}
    arrive(2, [{"answer": "3", "resp": "\\boxed{3}"}] * 2)
    assert run() == {"dataset": "MathVerse", "n": 4, "n_correct": 3, "acc": 75.0}
    batch = evaluate_responses(spark.read.schema(schema).json(f"{folder}/in"))
    assert metrics.accuracy(batch).first().acc == 75.0
    # a batch that was cut off while it wrote is not read; a broken line ends the stream
    write(f"{table}/totals-000000000009/part-0.parquet", "half")
    assert incremental.read_totals(spark, table).first().acc == 75.0
    write(f"{folder}/broken/MathVerse.1.jsonl", '{"answer":"1","resp":"1"}\n{"answer"\n')
    for tolerant in (False, True):
        rows = incremental.stream_responses(spark, f"{folder}/broken", schema, tolerant=tolerant)
        query = incremental.start_running_accuracy(incremental.running_accuracy(rows), f"{folder}/t{tolerant}")
        if tolerant:
            query.awaitTermination()
            assert incremental.read_totals(spark, f"{folder}/t{tolerant}").first().n == 1
        else:
            with pytest.raises(Exception, match="not a JSON object"):
                query.awaitTermination()
    scored = evaluate_responses(incremental.stream_responses(spark, f"{folder}/in", schema))
    incremental.start_append_scored(scored, f"{folder}/scored", f"{folder}/check2").awaitTermination()
    assert spark.read.schema("verify boolean").json(f"{folder}/scored").filter("verify").count() == 3


def test_running_worst_case_equals_the_batch(spark, folder):
    """After every arrival; a late wrong trial takes its image back; restarted between arrivals."""
    import random

    draw = random.Random(2)
    ddl, table, check = "image string, verify boolean, benchmark string", f"{folder}/t", f"{folder}/c"
    arrivals = [[(f"d/{'x' if i % 9 == 0 else 'y'}/{draw.randint(0, 25)}.png", draw.random() < 0.9, "m") for i in range(120)] for _ in range(3)]
    arrivals[0] += [("d/late/1.png", True, "n")] * 2
    arrivals[2] += [("d/late/1.png", False, "n"), (None, True, "n"), ("d/late/1.png", None, "n")]
    seen = []
    for number, rows in enumerate(arrivals):
        jsonl(f"{folder}/in/{number}.jsonl", [dict(zip(("image", "verify", "benchmark"), r, strict=True)) for r in rows])
        seen += rows
        stream = incremental.stream_responses(spark, f"{folder}/in", ddl)
        changes = incremental.image_changes(stream.drop("dataset").withColumnRenamed("benchmark", "dataset"), n_trials=5)
        incremental.start_worst_case(changes, table, check).awaitTermination()
        got = {r.dataset: r for r in incremental.worst_case_totals(incremental.read_totals(spark, table)).collect()}
        batch = spark.createDataFrame(seen, "image string, verify boolean, dataset string")
        for r in metrics.worst_case_accuracy(batch, ["dataset"]).collect():
            assert (got[r.dataset].n_images, round(got[r.dataset].acc, 9)) == (r.n_images, round(r.acc, 9)), number
        trials = {}
        for image, right, name in seen:
            trials.setdefault((name, image), []).append(bool(right))
        for name, r in got.items():
            own = [t for (d, _), t in trials.items() if d == name]
            full = [t for t in own if len(t) == 5]
            assert (r.qualified_count, r.strict_count) == (len(full), sum(sum(t) == 5 for t in own))
            assert r.match_ratio == (sum(map(all, full)) / len(full) if full else 0.0)
    assert got["n"].acc == 50.0  # the image without a name is right, the late one is not any more


def test_written_table_is_read_back(spark):
    df = spark.range(10).withColumn("x", F.lit("a"))
    assert written(df, "t", ["x"]).count() == 10


def test_damaged_json_files_are_errors(spark, folder):
    write(f"{folder}/list.json", '[{"answer":"1"},{"answer":"2"')
    write(f"{folder}/keyed.json", '{"1":{"answer":"1"},"2":{"answer"')
    write(f"{folder}/empty.json", "{}")
    for read in (readers.read_json_list, readers.read_json_keyed):
        with pytest.raises(Exception):
            read(spark, f"{folder}/{'list' if read is readers.read_json_list else 'keyed'}.json", "answer string").collect()
    assert readers.read_json_keyed(spark, f"{folder}/empty.json", "answer string").count() == 0


def test_other_failures_are_not_a_bad_file(spark, folder):
    path = jsonl(f"{folder}/MathVerse.jsonl", [{"answer": "1", "resp": "1"}])

    def broken(a, b):
        return F.raise_error(F.lit("the solver is gone")).cast("boolean")

    with pytest.raises(Exception, match="solver is gone"):
        jobs.evaluate_jsonl(spark, path, equal=broken)


def test_prompt_of_an_unknown_benchmark(spark):
    df = spark.createDataFrame([(1, "Else", "how many?"), (2, None, "how many?")], "id int, dataset string, question string")
    assert all("how many?" in r.prompt and r.images == [] for r in build_prompt(df).collect())


def test_replies_are_never_broadcast(spark):
    """Their size is estimated from a scan that an explode has made far larger."""
    rows = spark.range(5).select(F.col("id").alias("sid"), F.lit("<think>1").alias("resp"), F.lit("1").alias("answer"), F.lit("length").alias("finish_reason"))
    judge = spark.range(5).select("id", F.lit("\\boxed{1}").alias("judge_resp"))
    joined = (
        judging.with_responses(rows, judge, "sid"),
        judging.score_judged(rows, ["external_cap_verify"], "sid", caption=judge, completion="resp", solution="answer"),
        generation.with_salvaged(rows, rows.select("sid", F.lit(" 1").alias("resp")), "sid"),
    )
    for df in joined:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
        assert df.count() == 5


def test_running_worst_case_needs_no_python_per_image(spark, folder):
    """Calling Python for every image took longer than judging its trials."""
    jsonl(f"{folder}/in/0.jsonl", [{"image": "d/1.png", "verify": True}])
    stream = incremental.stream_responses(spark, f"{folder}/in", "image string, verify boolean")
    plan = incremental.image_changes(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Arrow" not in plan


def test_small_json_files_are_parsed_whole(spark, folder, monkeypatch):
    """Small files need no sums over ranges; files on either side of the limit give the same rows."""
    for i, n in enumerate((1, 3, 40)):
        rows = [{"answer": f"{i}-{j} }}\"]"} for j in range(n)]
        write(f"{folder}/l/{i}.json", json.dumps(rows))
        write(f"{folder}/k/{i}.json", json.dumps({f"{i}/{j}": r for j, r in enumerate(rows)}))
    read = lambda: [sorted(map(tuple, f(spark, f"{folder}/{d}", "answer string").collect())) for f, d in ((readers.read_json_list, "l"), (readers.read_json_keyed, "k"))]
    ranges = []
    monkeypatch.setattr(readers, "json_records", lambda *a: ranges.append(a) or json_records(*a))
    whole = read()
    assert not ranges and [len(x) for x in whole] == [44, 44]
    monkeypatch.setattr(readers, "WHOLE_BYTES", 100)
    assert read() == whole and len(ranges) == 2


def test_stream_by_pair_goes_on_from_the_batch_before(spark, folder):
    """Totals by distinct answers are those of the batch; a repeated batch replaces its own folder only."""
    schema, table, checkpoint = "answer string, resp string", f"{folder}/totals", f"{folder}/check"

    def run(check=checkpoint):
        rows = incremental.stream_responses(spark, f"{folder}/in", schema)
        incremental.start_running_accuracy_by_pair(rows, table, check).awaitTermination()
        return [r.asDict() for r in incremental.read_totals(spark, table).sort("dataset").collect()]

    first = [{"answer": "1", "resp": "\\boxed{1}"}, {"answer": "2", "resp": "\\boxed{1}"}, {"resp": "\\boxed{1}"}] * 5
    jsonl(f"{folder}/in/MathVerse.1.jsonl", first)
    assert run() == [{"dataset": "MathVerse", "n": 15, "n_correct": 5, "acc": 5 / 15 * 100}]
    jsonl(f"{folder}/in/MathVerse.2.jsonl", [{"answer": "3", "resp": "\\boxed{\\frac{6}{2}}"}] * 5)
    jsonl(f"{folder}/in/We-Math.2.jsonl", [{"answer": "3", "resp": "\\boxed{4}"}])
    want = [{"dataset": "MathVerse", "n": 20, "n_correct": 10, "acc": 50.0}, {"dataset": "We-Math", "n": 1, "n_correct": 0, "acc": 0.0}]
    assert run() == want
    # the batch is lost on its way to the log and runs again
    for name in (f"{checkpoint}/commits/1", f"{checkpoint}/commits/.1.crc"):
        os.remove(name)
    assert run() == want
    lines = readers.read_jsonl(spark, f"{folder}/in", schema)
    plan = lines.select("resp")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1  # every line is parsed once


def test_result_rows_by_pair_are_those_row_by_row(spark):
    files = ("DynaMath.jsonl", "MathVista_x.jsonl", "mathverse-7.jsonl", "other.jsonl")
    questions = ("Which?\nA: red\nB: 4/2\nC: blue", "How many?", None, "Pick (A) red (B) 2")
    answers = ("2", "A", "$B$", "red", None, "", "0.5", " x+1 ", "a")
    models = ("2.0", "a", "\\boxed{2}", "B", None, "red", "1/2", "1+x", "$A$", "2")
    rows = [
        (f, "a/image7.png" if i % 3 else "x.png", q, a, m, True, ["red", "2"] if i % 5 == 0 else None)
        for i, (f, q, a, m) in enumerate(itertools.product(files, questions, answers, models))
    ]
    df = spark.createDataFrame(rows, "file string, image string, question string, answer string, parsed_answer string, verify boolean, choices array<string>")
    order = ["file", "question", "answer", "parsed_answer", "image"]
    for require_verified in (False, True):
        want = jobs.judge_result_rows(df, require_verified)
        got = jobs.judge_result_rows(df, require_verified, by_pair=True)
        assert got.columns == want.columns
        want = [r for r in want.sort(*order).collect()]
        assert [r for r in got.sort(*order).collect()] == want
        assert {r.is_match for r in want} == {True, False, None}
    # a row per pair that is open is stored, not a row per row
    assert spark.read.parquet(*got.inputFiles()).count() < len(rows) / 4


def test_sharded_accuracy_keeps_the_rows_of_a_group_apart(spark):
    """Totals of groups are broadcast, and a given row count is not counted again."""
    df = spark.range(5000).selectExpr("id % 2 AS g", "id div 2 AS ord", "id % 3 = 0 AS verify").repartition(4)
    out = metrics.sharded_accuracy(df, by=["g"], batch_size=1000, n_shards=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r.n for r in out.sort("g").collect()] == [2500, 2500]
    alone = df.where("g = 0")
    given = metrics.sharded_accuracy(alone, batch_size=1000, n_shards=7, total=F.lit(2500))
    assert given.collect() == metrics.sharded_accuracy(alone, batch_size=1000, n_shards=7).collect()
    assert "Subquery" not in given._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def tables(spark, folder):
    spark.range(1, 301).selectExpr("id AS o_orderkey", "CAST(id * 7 AS double) AS o_totalprice").write.parquet(f"{folder}/sf/orders.parquet")
    spark.range(40).selectExpr("id AS page_id", "if(id = 3, NULL, concat('<p>', id)) AS html").write.parquet(f"{folder}/sf/pages.parquet")
    return f"{folder}/sf"


def test_texts_are_written_as_by_the_partitioned_writer(spark, folder):
    """A file for every name, as Spark's writer leaves them, without a checksum file beside each."""
    rows = [("b.png", "x"), ("b.png", "y\u00e9"), ("a/b:c=%1", "z"), (None, None), ("7", "")]
    df = spark.createDataFrame(rows, "name string, value string").coalesce(1).sortWithinPartitions("name")
    df.write.partitionBy("name").text(f"{folder}/spark")
    sinks.write_texts(df, f"{folder}/own", "name")

    def files(top):
        found = {}
        for at, _, names in os.walk(top):
            for n in names:
                if n.endswith(".txt"):
                    found[os.path.basename(at)] = open(f"{at}/{n}", "rb").read()
        return found

    assert files(f"{folder}/own") == files(f"{folder}/spark")
    assert all(n == "part-00000.txt" for _, _, names in os.walk(f"{folder}/own") for n in names)
    # written again, a partition replaces its files
    sinks.write_texts(df, f"{folder}/own", "name")
    assert files(f"{folder}/own") == files(f"{folder}/spark")
    apart = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "name string, value string").coalesce(1)
    with pytest.raises(Exception, match="do not follow each other"):
        sinks.write_texts(apart, f"{folder}/apart", "name")


def test_images_are_not_written_by_a_committer(spark, tables):
    images = QUERIES["a12_images"](spark, tables)
    files = images.inputFiles()
    assert len(files) == 40 and not any("-c000" in f for f in files)
    got = {r.name: base64.b64decode(r.image_base64).decode() for r in images.collect()}
    assert got == {f"{i}.png": "\n" if i == 3 else f"<p>{i}\n" for i in range(40)}


def test_listing_tasks_are_bounded(spark, folder):
    """Many folders are listed by few tasks; the session's settings are as before."""
    rows = spark.range(400).selectExpr("id AS name", "'[]' AS value").coalesce(1)
    sinks.write_texts(rows, f"{folder}/many", "name")
    key = readers.LISTING
    before = spark.conf.get(key)
    with readers._listed(spark):
        assert int(spark.conf.get(key)) == min(int(before), 32 * spark.sparkContext.defaultParallelism)
    assert spark.conf.get(key) == before
    assert readers.read_json_list(spark, f"{folder}/many", "a int").count() == 0


@pytest.mark.parametrize("query", ["a04_json_list_scan", "a04_json_keyed_scan"])
def test_small_json_files_are_parsed_once(spark, tables, query):
    """No filter parses a file again; only plain objects are read another way."""
    out = QUERIES[query](spark, tables)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == (1 if "list" in query else 2)
    assert not any("-c000" in f for f in out.inputFiles())


def test_keyed_records_are_those_of_the_parser(spark, folder):
    """Ids are read as values where all records are plain objects, as keys elsewhere."""
    good = {
        "twice": ('{"a": {"answer": "1"}, "a": {"answer": "2"}}', [("a", "1"), ("a", "2")]),
        "signs": ('{"a$1\\\\": {"answer": "q\\"}{ $2 ,\\\\", "z": {"y": [{}]}}, "b\\u0041" :\n{"answer": 5}, "c":{}}', [("a$1\\", 'q"}{ $2 ,\\'), ("bA", "5"), ("c", None)]),
        "null": ('{"a": {"answer": "1"}, "n": null}', [("a", "1"), ("n", None)]),
        "deep": ('{"a": {"answer": {"q": {"r": {"s": {"t": 1}}}}}}', [("a", '{"q":{"r":{"s":{"t":1}}}}')]),
        "empty": ("\n{ }\n", []),
        "long": (json.dumps({str(i): {"answer": "{" * 50} for i in range(20000)}), [(str(i), "{" * 50) for i in range(20000)]),
    }
    for name, (text, want) in good.items():
        write(f"{folder}/{name}/x.json", text)
        assert [tuple(r) for r in readers.read_json_keyed(spark, f"{folder}/{name}", "answer string", "id").collect()] == want, name
    for i, text in enumerate(('{"a": {"answer": "1"},}', '{"a": {"answer": "1"}} x', '{"a": {"answer": "1" 3}}', '{"a": {"answer": "1"} "b": {}}', '[{"a": {}}]')):
        write(f"{folder}/bad{i}/x.json", text)
        with pytest.raises(Exception):
            readers.read_json_keyed(spark, f"{folder}/bad{i}", "answer string", "id").collect()


@pytest.mark.parametrize("query, ending", [
    ("a01_jsonl_scan", ".json.gz"), ("a06_evaluated_file", ".zstd.parquet"), ("a07_folder_of_result_files", ".json.gz"), ("b06_first_rows", ".zstd.parquet"),
])
def test_stored_copies_are_compressed(spark, tables, query, ending):
    files = QUERIES[query](spark, tables).inputFiles()
    assert files and all(f.endswith(ending) for f in files)


def test_rows_with_ordinals_are_not_shuffled(spark, folder):
    """The counts per split are broadcast, so rows stay where they were read."""
    for f in range(2):
        jsonl(f"{folder}/n{f}.jsonl", [{"answer": str(i)} for i in range(50)])
    out = readers.with_file_ordinal(spark.read.text(folder), "line")
    assert sorted(r.line for r in out.collect()) == sorted([*range(50)] * 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
