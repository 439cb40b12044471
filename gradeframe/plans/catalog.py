"""Registered queries: one per operator, over whole derived or supplied tables.

Keys start with the operator's id in the survey.  ``oracles.ORACLES`` holds the SQL
that has to give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed as K, prompts as P, text as T
from ..functions.choices import choice_info, with_choice_match
from ..functions.equivalence import answers_equal, final_answer, parse_answer, same_text
from ..functions.rewards import score
from ..operators import generation, judging, metrics, records
from ..operators.evaluate import (
    compared_by_pair,
    evaluate_responses,
    evaluate_responses_by_pair,
    judge_trials,
    with_equal,
    with_equal_by_pair,
)
from ..session import held_conf, new_dir, written
from ..sources import readers, sinks
from ..streaming import incremental
from . import derived as D, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Lines of a gzip file, which one task reads.
GZIP_ROWS = 1_000_000


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def _r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _opts(options: Column) -> Column:
    """Options as one comparable text."""
    return F.array_join(F.transform(options, lambda o: F.concat_ws("=", o["letter"], o["text"])), "|")


# ------------------------------------------------------------ text over responses
def _on_responses(name: str, value: Callable[[], Column | dict]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = value()
        cols = v if isinstance(v, dict) else {"value": v}
        return D.responses(spark, sf).select("sid", *(c.alias(n) for n, c in cols.items()))

    QUERIES[name] = run


_on_responses("d01_boxed_last", lambda: T.boxed_last("resp"))
_on_responses(
    "d02_boxed_all",
    lambda: {"n_boxed": T.boxed_count("resp"), "last_boxed": T.boxed_final("resp")},
)
_on_responses("d03_answer_tag", lambda: T.answer_tag("resp"))
_on_responses("d04_answer_tag_multiline", lambda: T.answer_tag_multiline("resp"))
_on_responses("d05_think_body", lambda: T.think_body("resp"))
_on_responses("d06_desc_body", lambda: T.desc_body("resp"))
_on_responses(
    "d07_wrap_math",
    lambda: {
        "wrapped": T.wrap_math("answer"),
        "twice": T.wrap_math(T.wrap_math("answer")),
        "unless_dollar": T.wrap_math_unless_dollar(F.concat(F.lit("$"), F.col("answer"))),
    },
)
_on_responses(
    "d10_select_answer",
    lambda: {
        "boxed_prompt": T.select_answer("resp", K.SYSTEM_PROMPT_THINK_BOXED),
        "tag_prompt": T.select_answer("resp", K.SYSTEM_PROMPT_THINK_ANSWER),
    },
)
_on_responses("d11_image_number", lambda: T.image_number("image"))
_on_responses("d12_image_folder_key", lambda: T.image_folder_key("image"))
_on_responses("d14_without_image_token", lambda: T.without_image_token("question"))
_on_responses(
    "d16_tag_counts",
    lambda: {
        "n_think": T.occurrences("resp", K.THINK_OPEN),
        "one_answer": T.occurs_once("resp", K.ANSWER_OPEN),
    },
)
_on_responses(
    "d18_salvage_text", lambda: T.salvage_prompt(F.col("question"), F.col("resp"))
)
_on_responses(
    "d19_judge_prompts",
    lambda: {
        "caption": T.caption_judge_prompt("resp", "question"),
        "thinking": T.thinking_judge_prompt("question", T.strip(T.think_body("resp"))),
    },
)
_on_responses("e01b_final_answer", lambda: final_answer("resp"))


@query("e01b_final_answer_of_texts")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", final_answer("text").alias("value"))


@query("d08_options_from_question")
def _(spark, sf):
    items = D.choice_items(spark, sf)
    options = T.options_from_question("question", "dataset")
    return items.withColumn("o", options).select(
        "item_id", _opts(F.col("o")).alias("options"),
        F.array_join(T.option_list("o"), "|").alias("by_letter"),
    )


@query("d09_options_until_semicolon")
def _(spark, sf):
    return D.bench_items(spark, sf).select(
        "item_id", _opts(T.options_until_semicolon("option", K.WE_MATH)).alias("options")
    )


@query("d20_marks_in_long_texts")
def _(spark, sf):
    r = D.long_responses(spark, sf)
    return r.select(
        "doc_id",
        F.length(T.think_body("resp")).alias("think_length"),
        F.length(T.desc_body("resp")).alias("desc_length"),
        T.answer_tag("resp").alias("tag"),
        T.answer_tag_multiline("resp").alias("tag_any_line"),
        T.boxed_last("resp").alias("last_box"),
        T.boxed_count("resp").alias("n_boxes"),
        T.has_desc_think_answer_format("graded").alias("in_format"),
    )


@query("d13_squeeze_documents")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id", T.squeeze("text").alias("squeezed"), T.strip("text").alias("stripped")
    )


@query("d15_formatted_numbers")
def _(spark, sf):
    lines = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    share = F.col("l_quantity") / 64
    return lines.select(
        "l_orderkey", "l_linenumber",
        T.fixed_decimals(F.col("l_quantity"), 4).alias("four"),
        T.fixed_decimals(F.col("l_quantity"), 2).alias("two"),
        T.percent_text(share).alias("percent"),
    )


@query("d17_option_letters")
def _(spark, sf):
    return D.table(spark, sf, "part").select(
        "p_partkey", T.letter_at((F.col("p_partkey") % 6).cast("int")).alias("letter")
    )


@query("l12_token_counts")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", T.token_count("text").alias("tokens"))


@query("l09_base64_round_trip")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    encoded = F.base64(F.encode("text", "UTF-8"))
    return docs.select(
        "doc_id",
        F.regexp_replace(encoded, r"\s", "").alias("encoded"),
    )


@query("l06_json_fields")
def _(spark, sf):
    events = D.table(spark, sf, "events").select("event_id", "props")
    return events.select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"),
        F.array_join(F.json_object_keys("props"), ",").alias("keys"),
    )


# ------------------------------------------------------------------- equivalence
@query("e01_equivalent")
def _(spark, sf):
    # the two halves of a comparison
    def compare(a: Column, b: Column) -> Column:
        return answers_equal(parse_answer(a), parse_answer(b))

    pairs = compared_by_pair(D.answer_pairs(spark, sf), "is_equal", "answer", "model_answer", compare)
    return pairs.select("l_orderkey", "l_linenumber", "form", "is_equal")


@query("e01_expressions")
def _(spark, sf):
    pairs = D.expression_pairs(spark, sf)
    return with_equal_by_pair(pairs, "is_equal", "answer", "model_answer").select("l_orderkey", "l_linenumber", "form", "is_equal")


@query("e03_equal_or_same_text")
def _(spark, sf):
    pairs = D.answer_pairs(spark, sf)
    return with_equal_by_pair(pairs, "is_equal", "answer", "model_answer").select(
        "l_orderkey", "l_linenumber", "form", "is_equal",
        same_text("answer", "model_answer").alias("is_same"),
    )


@query("e02_choice_match")
def _(spark, sf):
    return with_choice_match(D.choice_items(spark, sf)).select(
        "item_id", "normalized_answer", "normalized_parsed_answer", "is_match"
    )


@query("e02a_choice_info")
def _(spark, sf):
    given = F.coalesce("choices", F.array().cast("array<string>"))
    found = T.options_from_question("question", "dataset")
    items = D.choice_items(spark, sf).withColumns({"given": given, "found": found})
    options = F.when(F.size("given") == 0, F.col("found")).otherwise(F.array().cast(T.OPTIONS_TYPE))
    items = items.withColumn("options", options)
    listed = F.when(F.size("options") > 0, T.option_list("options")).otherwise(F.col("given"))
    info = choice_info(T.strip("answer"), "listed", F.col("options"))
    return items.withColumn("listed", listed).withColumn("i", info).select("item_id", "i.letter", "i.index", "i.text")


@query("h06_lookup_by_name")
def _(spark, sf):
    # one row per benchmark: a fixed handful, so the broadcast cannot grow
    config = spark.createDataFrame(sorted(K.IMAGE_DIRS.items()), "dataset string, folder string")
    items = D.bench_items(spark, sf).select("item_id", "dataset")
    return items.join(F.broadcast(config), "dataset")


@query("x05_custom_equality")
def _(spark, sf):
    def same_lower(a: Column, b: Column) -> Column:
        return F.lower(T.strip(a)) == F.lower(T.strip(b))

    items = D.choice_items(spark, sf)
    return with_equal(items, "is_equal", "answer", "parsed_answer", same_lower).select(
        "item_id", "is_equal"
    )


# ------------------------------------------------------------------------ rewards
REWARD_QUERIES = {
    "f01_math_acc": "external_math_acc",
    "f02_math_format": "external_math_format",
    "f03_r1v_acc": "external_r1v_acc",
    "f04_compare_acc": "external_compare_acc",
    "f05_answer_format": "external_answer_format",
    "f06_answer_tag_acc": "external_answer_tag_acc",
    "f07_answer_tag_acc_gauss": "external_answer_tag_acc_gauss",
    "f08_soft_overlong": "soft_overlong",
    "f09_boxed_verify": "external_boxed_verify",
    "f10_boxed_format": "external_boxed_format",
    "f11_tag_count": "external_tag_count",
    "f12_boxed_count": "external_boxed_count",
    "f13_boxed_pos": "external_boxed_pos",
    "f14_acc_format": "external_acc_format",
    "f15_answer_tag_length_acc": "external_answer_tag_length_acc",
    "f18_cap_length": "external_cap_length",
    "f19_cap_check": "external_cap_check",
}
# answers that take little to extract, so that reading the responses twice pays
BY_PAIR = {
    "external_compare_acc", "external_answer_tag_acc", "external_answer_tag_acc_gauss", "external_answer_tag_length_acc",
}
REWARD_PARAMS = {"soft_overlong": {"soft_max_length": 30, "soft_cache_length": 20}}


def _reward_query(reward: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scored = score(
            D.responses(spark, sf), [reward], "resp", "answer", params=REWARD_PARAMS, by_pair=reward in BY_PAIR
        )
        return scored.select("sid", _r6(reward).alias("reward"))

    return run


for _name, _reward in REWARD_QUERIES.items():
    QUERIES[_name] = _reward_query(_reward)

JUDGE_QUERIES = {
    "f16_thinking_verify": "external_thinking_verify",
    "f17_cap_verify": "external_cap_verify",
    "f20_mm": "external_mm",
}


def _judge_query(reward: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scored = judging.score_judged(
            D.responses(spark, sf), [reward], "sid",
            thinking=D.judge_responses(spark, sf, "thinking"), caption=D.judge_responses(spark, sf, "caption"),
            completion="resp", solution="answer",
        )
        return scored.select("sid", _r6(reward).alias("reward"))

    return run


for _name, _reward in JUDGE_QUERIES.items():
    QUERIES[_name] = _judge_query(_reward)


@query("x01_score_many_rewards")
def _(spark, sf):
    names = [
        "external_answer_tag_acc", "external_boxed_verify", "external_acc_format",
        "external_tag_count", "external_boxed_count", "external_math_format",
    ]
    scored = score(D.responses(spark, sf), names, "resp", "answer")
    return scored.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), *(_r6(F.avg(n)).alias(n) for n in names)
    )


@query("x02_gauss_with_sigma")
def _(spark, sf):
    name = "external_answer_tag_acc_gauss"
    scored = score(
        D.responses(spark, sf), [name], "resp", "answer", params={name: {"sigma": 2.0}}, by_pair=True
    )
    return scored.select("sid", _r6(name).alias("reward"))


# --------------------------------------------------------- judge and generation
@query("j01_thinking_requests")
def _(spark, sf):
    return judging.thinking_requests(D.responses(spark, sf), "sid", "resp").select(
        "id", "user", "image", "image_format", F.length("system").alias("system_length")
    )


@query("j01_caption_requests")
def _(spark, sf):
    return judging.caption_requests(D.responses(spark, sf), "sid", "resp")


@query("j02_judge_scores")
def _(spark, sf):
    names = ["external_cap_verify", "external_thinking_verify"]
    return judging.score_judged(
        D.responses(spark, sf), names, "sid",
        thinking=D.judge_responses(spark, sf, "thinking"), caption=D.judge_responses(spark, sf, "caption"),
        completion="resp", solution="answer",
        params={"external_thinking_verify": {"strict_reference": True}},
    ).select("sid", F.col(names[0]).alias("caption"), F.col(names[1]).alias("thinking"))


@query("j03_generate")
def _(spark, sf):
    # defined here so that it travels to the workers by value
    def echo_model(batches):
        """Stands in for a model: boxes the prompt's length, or stops in a thought."""
        for frame in batches:
            n = frame["prompt"].str.len()
            cut = n % 3 == 0
            box = "so \\boxed{" + n.astype(str) + "}"
            yield frame[[frame.columns[0]]].assign(
                resp=box.where(~cut, "<think>it is " + n.astype(str)),
                finish_reason=(~cut).map({True: "stop", False: "length"}),
            )

    prompts = D.responses(spark, sf).select("sid", F.col("resp").alias("prompt"))
    return generation.generate(prompts, echo_model, "sid")


@query("j04_salvage")
def _(spark, sf):
    r = D.responses(spark, sf)
    second = generation.salvage_requests(r, "sid", "question", "resp").select(
        "sid",
        F.concat(F.lit(" \\boxed{"), F.length("prompt").cast("string"), F.lit("}")).alias("resp"),
    )
    return generation.with_salvaged(r, second, "sid").select("sid", "resp")


# ------------------------------------------------------------------------ prompts
def _prompt_query(dataset: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        items = D.bench_items(spark, sf).filter(F.col("dataset") == dataset)
        return P.build_prompt(items, system_prompt=K.SYSTEM_PROMPT_THINK_BOXED, root="bench").select(
            "item_id", "prompt_question", F.array_join("images", ",").alias("image_file")
        )

    return run


for _id, _ds in zip(("c01", "c02", "c03", "c04", "c05", "c06"), D.DATASETS):
    QUERIES[f"{_id}_prompt_{_ds.lower().replace('-', '_')}"] = _prompt_query(_ds)


@query("c07_prompt_competition")
def _(spark, sf):
    return P.build_prompt(D.olympiad_items(spark, sf)).select(
        "item_id", "prompt_question", F.array_join("images", ",").alias("image_file"),
        F.size("messages").alias("n_messages"),
    )


@query("c08_messages")
def _(spark, sf):
    prompts = P.build_prompt(D.bench_items(spark, sf), root="bench")
    user = F.get("messages", F.lit(1))
    image, text = F.get(user["content"], F.lit(0)), F.get(user["content"], F.lit(1))
    return prompts.select(
        "item_id",
        F.get("messages", F.lit(0))["role"].alias("first_role"),
        user["role"].alias("second_role"),
        image["image"].alias("image_file"),
        image["min_pixels"].alias("min_pixels"),
        image["max_pixels"].alias("max_pixels"),
        text["text"].alias("question_text"),
    )


@query("c11_flat_prompt")
def _(spark, sf):
    return P.build_prompt(
        D.bench_items(spark, sf), system_prompt=K.SYSTEM_PROMPT_THINK_ANSWER
    ).select("item_id", "prompt")


# ---------------------------------------------------------------- rows and files
@query("b01_required_fields")
def _(spark, sf):
    return records.with_required_fields(D.result_files(spark, sf)).select("sid", "file")


@query("b02_verified_rows")
def _(spark, sf):
    return records.verified(D.result_files(spark, sf)).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_verified")
    )


@query("b03_trial_records")
def _(spark, sf):
    rows = D.result_files(spark, sf).filter(T.is_trial_file("file"))
    return records.trial_records(judge_trials(rows))


@query("b04_standard_records")
def _(spark, sf):
    rows = D.result_files(spark, sf).filter(~T.is_trial_file("file"))
    return records.standard_records(
        jobs.judge_result_rows(rows).filter("is_scored")
    )


@query("b05_evaluated_rows")
def _(spark, sf):
    return evaluate_responses_by_pair(D.responses(spark, sf)).select("sid", "parsed_answer", "verify")


@query("b06_first_rows")
def _(spark, sf):
    # one row to a file line, in the order of their ids; the ordinal comes from the file
    rows = D.responses(spark, sf).select("sid", "resp")
    path = new_dir(spark, "ordered")
    ordered = rows.repartitionByRange("sid").sortWithinPartitions("sid").select(F.to_json(F.struct("sid", "resp")).alias("value"))
    ordered.write.options(compression="gzip", maxRecordsPerFile=GZIP_ROWS).text(path)
    lines = readers.with_file_ordinal(spark.read.text(path).withColumn("file", F.col("_metadata.file_name")), "line")
    # part files are named in the order of their ranges
    parsed = readers.parsed_lines(lines, "sid bigint, resp string", strict=True, keep=("file", "line"))
    counts = parsed.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file
    rows = parsed.join(F.broadcast(counts.select("file", before.alias("before"))), "file")
    return records.first_n(rows.withColumn("ord", (F.col("before") + F.col("line")).cast("bigint")), 200).select("ord", "sid", "resp")


@query("b07_truncated_thoughts")
def _(spark, sf):
    return records.truncated_thoughts(D.responses(spark, sf)).select("sid", "resp")


@query("b08_dataset_from_file")
def _(spark, sf):
    return (
        D.result_files(spark, sf)
        .groupBy("file", T.dataset_from_file("file").alias("dataset"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("b09_file_routes")
def _(spark, sf):
    files = D.result_files(spark, sf).select(
        F.when(T.is_trial_file("file"), "trials").otherwise("standard").alias("route"),
        T.is_skipped_file("file").alias("is_skipped"),
    )
    return files.groupBy("route", "is_skipped").agg(F.count(F.lit(1)).alias("n"))


@query("b10_kept_files")
def _(spark, sf):
    return D.result_files(spark, sf).filter(~T.is_skipped_file("file")).select("sid", "file")


@query("b11_rows_with_image_number")
def _(spark, sf):
    rows = D.bench_items(spark, sf).withColumn(
        "image",
        F.when(F.col("item_id") % 2 == 0, F.col("image")).otherwise(
            F.concat(F.lit("x/image"), F.col("item_id").cast("string"), F.lit(".png"))
        ),
    )
    return records.with_image_number(rows).select("item_id", "image_key")


@query("a05_parquet_scan")
def _(spark, sf):
    docs = readers.read_parquet(spark, f"{sf}/documents.parquet")
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")
    )


@query("a09_split_rows")
def _(spark, sf):
    judged = jobs.judge_result_rows(D.result_files(spark, sf)).filter("is_scored")
    path = new_dir(spark, "split")
    sinks.write_split(judged.select("file", "answer", "parsed_answer", "is_match"), path, ["file"])
    back = spark.read.schema(
        "answer string, parsed_answer string, is_match boolean, file string, split string"
    ).json(path)
    return back.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_match").alias("n_match")
    )


@query("a13_union_of_train_tables")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("text").alias("query"), "lang")
    talk = D.table(spark, sf, "conversations").select(F.col("text").alias("query"), "role")
    return records.combine(docs, talk)


@query("a14_output_names")
def _(spark, sf):
    return D.table(spark, sf, "pages").select(
        "page_id",
        T.result_file_name(T.base_name("url"), True).alias("match_file"),
        T.result_file_name(T.base_name("url"), False).alias("mismatch_file"),
        T.model_folder("url").alias("folder"),
        T.file_stem("url").alias("stem"),
    )


def _json_copy(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Rows as JSON lines in a folder ``<name>.jsonl``."""
    path = f"{new_dir(spark, 'json')}/{name}.jsonl"
    sinks.append_jsonl(rows, path, GZIP_ROWS, "gzip")
    return path


RESPONSE_FIELDS = ("sid", "image", "answer", "resp", "finish_reason")
RESPONSE_DDL = "sid bigint, image string, answer string, resp string, finish_reason string"


@query("a01_jsonl_scan")
def _(spark, sf):
    path = _json_copy(spark, D.responses(spark, sf).select(*RESPONSE_FIELDS), "r")
    return readers.read_jsonl(spark, path, RESPONSE_DDL)


@query("a02_tolerant_jsonl_scan")
def _(spark, sf):
    r = D.responses(spark, sf)
    line = F.to_json(F.struct("sid", "answer"))
    broken = r.select(F.when(F.col("sid") % 10 == 3, F.concat(line, F.lit(" oops{"))).otherwise(line))
    path = new_dir(spark, "broken")
    broken.write.text(path)
    return readers.read_jsonl_tolerant(spark, path, "sid bigint, answer string")


@query("a04_json_list_scan")
def _(spark, sf):
    # files that are one JSON list each, of up to a thousand rows
    r = D.responses(spark, sf)
    lists = r.groupBy(F.floor(F.col("sid") / 1000).alias("file")).agg(
        F.to_json(F.collect_list(F.struct("sid", "answer"))).alias("value")
    )
    path = new_dir(spark, "lists")
    sinks.write_texts(lists, path, "file")
    return readers.read_json_list(spark, path, "sid bigint, answer string").select("sid", "answer")


@query("a03_benchmark_scan")
def _(spark, sf):
    # a benchmark stored as a list of records, read by its name
    rows = D.bench_items(spark, sf).select(F.col("question_for_eval"), "image", F.col("item_id").cast("string").alias("answer"))
    root = new_dir(spark, "benchmarks")
    lists = rows.groupBy(F.pmod(F.col("answer").cast("bigint"), F.lit(16)).alias("part")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    lists.write.partitionBy("part").text(f"{root}/{K.BENCHMARK_FILES[K.MATHVERSE]}")
    return readers.read_benchmark(spark, K.MATHVERSE, root)


@query("a12_images")
def _(spark, sf):
    # pages stand for images: each is a file of its own
    pages = D.table(spark, sf, "pages").select(F.coalesce("html", F.lit("")).alias("value"), F.concat("page_id", F.lit(".png")).alias("name"))
    folder = new_dir(spark, "images")
    sinks.write_texts(pages.sortWithinPartitions("name"), folder, "name")
    images = readers.read_images(spark, folder)
    return images.select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("name"), "image_base64")


@query("a04_json_keyed_scan")
def _(spark, sf):
    # files that are one JSON object each, a record for every id
    r = D.responses(spark, sf)
    entry = F.struct(F.col("sid").cast("string").alias("key"), F.struct("answer").alias("value"))
    objects = r.groupBy(F.floor(F.col("sid") / 1000).alias("file")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    )
    path = new_dir(spark, "keyed")
    sinks.write_texts(objects, path, "file")
    rows = readers.read_json_keyed(spark, path, "answer string", "sid")
    return rows.select(F.col("sid").cast("bigint").alias("sid"), "answer")


@query("a06_evaluated_file")
def _(spark, sf):
    path = _json_copy(spark, D.responses(spark, sf).select(*RESPONSE_FIELDS), K.DYNAMATH)
    acc, _rows = jobs.evaluate_jsonl(spark, path, schema=RESPONSE_DDL)
    return acc.select("dataset", _r6("acc").alias("acc"), "acc_text")


@query("a08_appended_batches")
def _(spark, sf):
    r = D.responses(spark, sf).select("sid", "answer")
    path = new_dir(spark, "append")
    for i in range(2):
        sinks.append_jsonl(r.filter(F.col("sid") % 2 == i), path, None)
    return readers.read_jsonl(spark, path, "sid bigint, answer string")


# -------------------------------------------------------------------------- metrics
def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate_responses_by_pair(D.responses(spark, sf))


@query("g01_accuracy")
def _(spark, sf):
    per = metrics.accuracy(_judged(spark, sf), ["dataset"])
    return per.withColumn("acc", _r6("acc"))


@query("g02_worst_case_accuracy")
def _(spark, sf):
    per = metrics.worst_case_accuracy(_judged(spark, sf), ["dataset"])
    return per.withColumn("acc", _r6("acc"))


@query("g03_strict_trials")
def _(spark, sf):
    per = metrics.strict_trials(_judged(spark, sf), ["dataset"])
    return per.withColumn("acc", _r6("acc"))


@query("g04_qualified_trials")
def _(spark, sf):
    judged = judge_trials(D.result_files(spark, sf).filter(T.is_trial_file("file")))
    out = metrics.trial_summary(judged)
    return out.withColumns({c: _r6(c) for c in ("match_ratio", "verify_true_ratio")})


@query("g04_qualified_verified_trials")
def _(spark, sf):
    rows = D.result_files(spark, sf).filter(T.is_trial_file("file"))
    out = metrics.trial_summary(judge_trials(rows, require_verified=True))
    return out.withColumns({c: _r6(c) for c in ("match_ratio", "verify_true_ratio")})


@query("g05_match_ratio")
def _(spark, sf):
    rows = D.result_files(spark, sf).filter(~T.is_trial_file("file"))
    judged = jobs.judge_result_rows(rows)
    out = metrics.standard_summary(judged, ["file"], "is_scored")
    return out.withColumn("match_ratio", _r6("match_ratio"))


def _file_summary(judged: DataFrame) -> DataFrame:
    out = metrics.percent_texts(metrics.file_summary(judged), "match_ratio")
    ratios = ("match_ratio", "mismatch_ratio", "verify_true_ratio")
    return out.withColumns({c: _r6(c) for c in ratios})


@query("g06_file_summary")
def _(spark, sf):
    return _file_summary(jobs.judge_result_rows(D.result_files(spark, sf)))


@query("a07_folder_of_result_files")
def _(spark, sf):
    from ..schemas import RESPONSES

    # a folder of one file per name, as models leave them
    base = new_dir(spark, "results")
    writer = D.result_files(spark, sf).write.options(**sinks.JSON_OPTIONS, compression="gzip", maxRecordsPerFile=GZIP_ROWS)
    # a task keeps the files of its few names open, so its rows need not be sorted
    with held_conf(spark, {"spark.sql.maxConcurrentOutputFileWriters": "16"}):
        writer.partitionBy("file").json(base)
    lines = readers.read_result_files(spark, base, f"{RESPONSES}, sid bigint")
    return _file_summary(jobs.judge_result_rows(lines))


def _total(spark: SparkSession, sf: str) -> Column:
    """How many responses there are, which needs none of their texts."""
    return D.responses(spark, sf).agg(F.count(F.lit(1))).scalar()


@query("g07_sharded_accuracy")
def _(spark, sf):
    out = metrics.sharded_accuracy(_judged(spark, sf), batch_size=1000, n_shards=7, total=_total(spark, sf))
    return out.withColumn("acc", _r6("acc"))


@query("g07_sharded_per_dataset")
def _(spark, sf):
    judged = written(_judged(spark, sf).select("dataset", "ord", "verify"), "judged")
    # dense ordinals per data set: rows of earlier chunks, then the place inside the chunk
    rows = judged.withColumn("chunk", F.floor(F.col("ord") / 4096))
    earlier = Window.partitionBy("dataset").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("dataset", "chunk").count()
    counts = counts.select("dataset", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("chunk", "dataset").orderBy("ord")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1).join(counts, ["dataset", "chunk"])
    rows = rows.select("dataset", (F.col("earlier") + F.col("place")).alias("ord"), "verify")
    out = metrics.sharded_accuracy(rows, by=["dataset"], batch_size=1000, n_shards=7)
    return out.withColumn("acc", _r6("acc"))


@query("g07_sharded_worst_case")
def _(spark, sf):
    out = metrics.sharded_accuracy(
        _judged(spark, sf), batch_size=1000, n_shards=7, worst_case_image="image", total=_total(spark, sf)
    )
    return out.withColumn("acc", _r6("acc"))


@query("g08_mean_accuracy")
def _(spark, sf):
    out = metrics.mean_accuracy(_judged(spark, sf))
    return out.withColumns({c: _r6(c) for c in ("macro_acc", "micro_acc")})


@query("a11_accuracy_table")
def _(spark, sf):
    return metrics.accuracy_table(_judged(spark, sf)).withColumn("acc", _r6("acc"))


@query("g09_cross_file_summary")
def _(spark, sf):
    return metrics.cross_file_summary(jobs.judge_result_rows(D.result_files(spark, sf), by_pair=True))


@query("g10_verified_beside_match")
def _(spark, sf):
    rows = D.result_files(spark, sf).filter(T.is_trial_file("file"))
    out = metrics.trial_summary(judge_trials(rows))
    out = metrics.percent_texts(out, "match_ratio", "verify_true_ratio")
    return out.select("match_ratio_text", "verify_true_ratio_text", "verify_true_records")


@query("g11_first_groups")
def _(spark, sf):
    return metrics.group_counts(D.responses(spark, sf))


@query("g12_accuracy_per_benchmark")
def _(spark, sf):
    return jobs.accuracy_per_benchmark(_judged(spark, sf)).withColumn("acc", _r6("acc"))


@query("h05_counts_per_image")
def _(spark, sf):
    judged = _judged(spark, sf)
    return judged.groupBy("image_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("verify").alias("n_match")
    )


# ---------------------------------------------------------------- joins, sets, sorts
@query("h01_pairs_by_id")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = D.table(spark, sf, "labels").select("doc_id", "quality")
    pairs = records.pair_by_id(docs, labels, "doc_id")
    return pairs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), _r6(F.avg("quality") * 100).alias("acc"),
        F.sum("n_chars").alias("n_chars"),
    )


@query("h04_responses_by_id")
def _(spark, sf):
    joined = judging.with_responses(
        D.responses(spark, sf).select("sid", "answer"), D.judge_responses(spark, sf, "caption"), "sid"
    )
    return joined.select("sid", F.coalesce("judge_resp", F.lit("")).alias("judge_resp"))


@query("u02_split_is_complete")
def _(spark, sf):
    # stored once, as the jobs do: each part would judge every row again otherwise
    judged = written(jobs.judge_result_rows(D.result_files(spark, sf)), "judged")
    parts = records.matched(judged).withColumn("part", F.lit("match")).unionByName(
        records.mismatched(judged).withColumn("part", F.lit("mismatch"))
    )
    return parts.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------ streaming
@query("t01_running_accuracy")
def _(spark, sf):
    """Responses arrive as JSON lines; totals are kept by a streaming query."""
    base = new_dir(spark, "arrivals")
    r = D.responses(spark, sf).select("sid", F.col("dataset").alias("benchmark"), "answer", "resp")
    r.write.options(**sinks.JSON_OPTIONS).json(base)
    rows = incremental.stream_responses(spark, base, "sid bigint, benchmark string, answer string, resp string")
    rows = rows.withColumn("dataset", F.col("benchmark"))
    table = new_dir(spark, "totals")
    incremental.start_running_accuracy_by_pair(rows, table).awaitTermination()
    return incremental.read_totals(spark, table).withColumn("acc", _r6("acc"))


@query("t02_running_worst_case")
def _(spark, sf):
    """Responses arrive in several batches; a late wrong trial takes its image back."""
    base = new_dir(spark, "arrivals")
    r = D.responses(spark, sf).select("image", F.col("dataset").alias("benchmark"), "answer", "resp")
    r.write.options(**sinks.JSON_OPTIONS).json(base)
    # a file for each partition that the responses are dealt over, half of them at a time
    half = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    rows = incremental.stream_responses(spark, base, "image string, benchmark string, answer string, resp string", max_files=half)
    judged = evaluate_responses(rows.withColumn("dataset", F.col("benchmark")))
    table = new_dir(spark, "totals")
    incremental.start_worst_case(incremental.image_changes(judged), table).awaitTermination()
    totals = incremental.worst_case_totals(incremental.read_totals(spark, table))
    return totals.withColumns({c: _r6(c) for c in ("acc", "match_ratio")})
