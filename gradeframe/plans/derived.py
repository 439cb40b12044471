"""Tables derived from the supplied ones, for the registered queries.

The supplied tables hold no model answers, so prices and part attributes are turned
into responses, option lists and labels by row-wise expressions: every table grows
with its base table, and no row depends on another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal narrow rows out over the session's shuffle partitions.

    Each becomes many long rows further on, whatever the files they were read from.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _s(x: Column) -> Column:
    return x.cast("string")


_RESPONSE_SHAPES = r"""
CASE k
  WHEN 0 THEN concat(r'<think>r</think><answer>', s, r'</answer>')
  WHEN 1 THEN concat(r'<think>r</think>', '\n\n', r'\boxed{', s, '}')
  WHEN 2 THEN concat(r'so \boxed{\frac{', 2 * a, '}{2}}')
  WHEN 3 THEN concat(r'<think>first ', s, ' then')
  WHEN 4 THEN concat(r'\boxed{', a + 1, r'} no, \boxed{', s, '}')
  WHEN 5 THEN concat(r'\boxed{', s, r'} and \boxed{\frac{1}{2}')
  WHEN 6 THEN concat('<think>\n\nr\n\n</think>\n\n<answer>', a + 1, '</answer>')
  WHEN 7 THEN s
  ELSE concat('<desc>d\n</desc><think>long r</think><answer> ', s, '.0 </answer>')
END AS resp"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten trials per order, some missing: one response text of nine shapes each.

    The ids are dense but for the multiples of 37, so the row number is arithmetic.
    """
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    names = ", ".join(f"'{d}'" for d in DATASETS)
    return (
        orders.selectExpr(
            "o_orderkey AS image_key",
            "CAST(floor(o_totalprice) AS bigint) % 50 + 1 AS a",
            "explode(sequence(0, 9)) AS trial",
        )
        .selectExpr("*", "image_key * 10 + trial AS sid")
        .filter("sid % 37 <> 0")
        .selectExpr(
            "*", "CAST(a AS string) AS s", "if(image_key % 4 = 0, 4, sid % 9) AS k"
        )
        .selectExpr(
            "sid",
            "image_key",
            "trial",
            "sid - CAST(floor(sid / 37) AS bigint) - 1 AS ord",
            "concat('samples/image/image', image_key, '.png') AS image",
            "s AS answer",
            "if(k = 3, 'length', 'stop') AS finish_reason",
            _RESPONSE_SHAPES,
            f"array({names})[CAST(image_key % 6 AS int)] AS dataset",
            "concat('<image>What is value ', image_key, '?') AS question",
        )
    )


def long_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions as long as real ones: a document's text inside a desc and a think block.

    ``graded`` is the part of ``resp`` in front of the box.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = _s(F.col("doc_id"))
    graded = F.concat(
        F.lit("<desc>"), "text", F.lit("</desc>\n<think>"), "text", F.lit("</think>\n<answer>"), number, F.lit("</answer>")
    )
    box = F.concat(F.lit("\n\n\\boxed{"), number, F.lit("}"))
    return docs.select("doc_id", graded.alias("graded"), F.concat(graded, box).alias("resp"))


DATASETS = (K.MATH_V, K.WE_MATH, K.MATHVERSE, K.MATHVISTA, K.LOGICVISTA, K.DYNAMATH)


def judge_responses(spark: SparkSession, sf_dir: str, judge: str) -> DataFrame:
    """A judge's text per response; every seventh is missing, some have no box.

    The ``caption`` judge says what the ``thinking`` judge says of the next response.
    """
    r = responses(spark, sf_dir).filter(F.col("sid") % 7 != 0)
    sid, shift = F.col("sid"), 1 if judge == "caption" else 0
    turn = (sid + shift) % 5
    text = (
        F.when(turn == 0, F.lit("I cannot tell."))
        .when(turn == 1, F.concat(F.lit("Fine. \\boxed{"), F.col("answer"), F.lit("}")))
        .when(turn == 2, F.lit("Sound, \\boxed{1}"))
        .when(turn == 3, F.lit("No \\boxed{1}, rather \\boxed{0}"))
        .otherwise(F.concat(F.lit("It is \\boxed{\\text{"), F.col("answer"), F.lit("}}")))
    )
    return r.select(sid.alias("id"), text.alias("judge_resp"))


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of judged files of several models, some fields missing."""
    r = responses(spark, sf_dir)
    key, sid, a = F.col("image_key"), F.col("sid"), F.col("answer")
    files = (
        "DynaMath.jsonl",
        "MathVista_x.jsonl",
        "mathverse-7.jsonl",
        "We-Math.jsonl",
        "filtered_match_a.jsonl",
        "other.jsonl",
    )
    # every third image belongs to the first file, the rest to the others
    pick = F.when(key % 3 == 0, F.lit(0)).otherwise(key % 5 + 1)
    parsed = (
        F.when(sid % 11 == 5, F.lit(None).cast("string"))
        .when(key % 6 == 0, F.concat(F.lit("$"), a, F.lit("$")))
        .when(sid % 3 == 0, F.concat(a, F.lit(".0")))
        .when(sid % 3 == 1, F.concat(F.lit("\\boxed{"), a, F.lit("}")))
        .otherwise(a)
    )
    return r.select(
        "sid",
        F.element_at(F.array(*(F.lit(f) for f in files)), (pick + 1).cast("int")).alias("file"),
        "image",
        "image_key",
        F.when(sid % 13 != 0, F.col("question")).alias("question"),
        a.alias("answer"),
        parsed.alias("parsed_answer"),
        F.when(sid % 17 == 3, F.lit(None).cast("boolean"))
        .otherwise((key % 4 == 0) | (sid % 2 == 0))
        .alias("verify"),
        F.lit(None).cast("array<string>").alias("choices"),
    )


def bench_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark records of six benchmarks, one per part."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    size, size1 = _s(F.col("p_size")), _s(F.col("p_size") + 100)
    five = F.array("p_name", "p_brand", "p_type", size, size1)
    return p.select(
        key.alias("item_id"),
        F.element_at(F.array(*(F.lit(d) for d in DATASETS)), (key % 6 + 1).cast("int")).alias("dataset"),
        F.concat(F.lit("Which fits item "), _s(key), F.lit("?")).alias("question"),
        F.concat(F.lit("Eval: which fits item "), _s(key), F.lit("?")).alias("question_for_eval"),
        F.when(key % 4 == 0, F.array().cast("array<string>"))
        .when(key % 4 == 1, F.array(*(F.lit(x) for x in "ABCDE")))
        .otherwise(five)
        .alias("options"),
        F.when(key % 5 == 0, F.lit(None).cast("array<string>"))
        .when(key % 5 == 1, F.array("p_name", "p_type"))
        .otherwise(F.slice(five, 1, 4))
        .alias("choices"),
        F.concat(
            F.lit("A. "), F.col("p_name"), F.lit("; B. "), F.col("p_type"),
            F.lit("; C. size  "), size,
        ).alias("option"),
        F.concat(F.lit("images/p"), _s(key), F.lit(".jpg")).alias("image"),
        F.concat(F.lit("dir/p"), _s(key), F.lit(".png")).alias("image_path"),
        F.concat(F.lit("logic_"), _s(key), F.lit(".png")).alias("imagename"),
        F.when(key % 3 == 0, F.lit("B")).otherwise(F.col("p_type")).alias("answer"),
    )


def olympiad_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition items: text only or with image marks, some with a context."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("item_id"),
        F.lit(K.OLYMPIAD).alias("dataset"),
        F.when(key % 2 == 0, F.lit("OE_TO_maths_en")).otherwise(F.lit("OE_MM_maths_en")).alias("from"),
        F.when(key % 3 == 0, F.concat(F.lit("Given "), F.col("p_name"), F.lit("."))).alias("context"),
        F.when(key % 4 == 1, F.concat(F.lit("See <img_"), _s(key), F.lit("> and <img_7>.")))
        .when(key % 4 == 3, F.concat(F.lit("<img_"), _s(key), F.lit(">")))
        .otherwise(F.concat(F.lit("How big is "), F.col("p_type"), F.lit("?")))
        .alias("question"),
    )


def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice rows: options in a column or in the question, answers in all forms."""
    p = table(spark, sf_dir, "part")
    key, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    size = _s(F.col("p_size"))

    def q(*parts) -> Column:
        return F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))

    question = (
        F.when(key % 5 == 0, q("Pick one.\nA. ", name, "\nB. ", kind, "  x \nC. ", size))
        .when(key % 5 == 1, q("Choices:\nA:", name, "\nB:", kind, "\nC: ", size))
        .when(key % 5 == 2, q("Pick (A) ", name, " (C) ", kind, " (D) ", size))
        .when(key % 5 == 3, q("How many? A: ", name, " B: ", kind, " A: ", size))
        .otherwise(q("How many of ", name, "?"))
    )
    dataset = (
        F.when(key % 5 == 0, K.WE_MATH).when(key % 5 == 1, K.MATHVERSE).otherwise(K.UNKNOWN)
    )
    choices = F.when(key % 7 == 0, F.array(size, name, kind))
    answer = (
        F.when(key % 4 == 0, F.lit("A")).when(key % 4 == 1, name).when(key % 4 == 2, F.lit(" b "))
        .otherwise(size)
    )
    model = (
        F.when(key % 6 == 0, F.lit("a")).when(key % 6 == 1, F.lit("$A$")).when(key % 6 == 2, kind)
        .when(key % 6 == 3, q(size, ".0")).when(key % 6 == 4, q("\\text{", name, "}"))
        .otherwise(F.lit("B"))
    )
    return p.select(
        key.alias("item_id"),
        dataset.alias("dataset"),
        question.alias("question"),
        choices.alias("choices"),
        answer.alias("answer"),
        model.alias("parsed_answer"),
    )


def _notations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[..., Column], Column, Column]:
    """Line items, a function that joins parts of a text, and a quantity as text and as number."""
    line = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
        )
    )
    n = F.col("l_quantity").cast("int")

    def t(*parts) -> Column:
        return F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))

    return line, t, _s(n), n


def _pairs(line: DataFrame, forms: list[tuple[Column, Column]]) -> DataFrame:
    """Each line item's pair in one of the forms."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % len(forms)
    a = b = None
    for i, (left, right) in enumerate(forms):
        a = F.when(k == i, left) if a is None else a.when(k == i, left)
        b = F.when(k == i, right) if b is None else b.when(k == i, right)
    return line.select(
        "l_orderkey", "l_linenumber", k.cast("int").alias("form"),
        a.alias("answer"), b.alias("model_answer"),
    )


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of answers in many notations, from line item quantities; some differ."""
    line, t, s, n = _notations(spark, sf_dir)
    forms = [
        (t(s, ".0"), s),
        (t("$\\frac{", _s(n * 2), "}{2}$"), s),
        (t("\\dfrac{", s, "}{4}"), t(s, "/4")),
        (t(s, "\\%"), (n / 100).cast("string")),
        (t("2\\sqrt{", s, "}"), t("\\sqrt{", _s(n * 4), "}")),
        (t("x = ", s), s),
        (t("(", s, ", 2.0)"), t("\\left( ", s, ",2 \\right)")),
        (t("\\{2,", s, "\\}"), t("\\{", s, ", 2\\}")),
        (t("1,0", F.lpad(s, 2, "0")), t("10", F.lpad(s, 2, "0"))),
        (t(s, "\\text{ cm}"), s),
        (t(s, "^\\circ"), t(s, ".")),
        (F.col("l_returnflag"), t("(", F.col("l_returnflag"), ")")),
        (t("\\text{red ", s, "}"), t("red  ", s)),
        (t("2^{", _s(n % 11), "}"), _s(F.pow(F.lit(2.0), n % 11).cast("bigint"))),
        (t("\\frac{", s, "\\pi}{2}"), t(_s(n), "\\pi/2")),
        (t("1\\frac{", s, "}{100}"), t(_s(n + 100), "/100")),
        (s, _s(n + 1)),
        (t("x + ", s), t("x+", s)),
        (t("-", s), s),
        (F.lit(""), F.lit("")),
        (t("$\\boxed{", s, "}$"), s),
        (t("\\boxed{", _s(n + 1), "} no, \\boxed{", s, "}"), s),
        (t("**", s, "**"), s),
        (t("$", s), s),
        (t(s, " cm"), s),
        (t("1/2,", s), t("0.5,", s)),
        (F.lit("Tom, Bob"), F.lit("Bob, Tom")),
        (t("0.0000001", s), t("0.0000002", s)),
    ]
    return _pairs(line, forms)


def expression_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of expressions and of sets of numbers, from line item quantities; some differ."""
    line, t, s, n = _notations(spark, sf_dir)
    forms = [
        (t("x+", s), t(s, "+x")),
        (t("(x+", s, ")^2"), t("x^2+", _s(n * 2), "x+", _s(n * n))),
        (t("\\frac{x}{2}+", s), t("0.5x+", s)),
        (t("(x+", s, ")(x-", s, ")"), t("x^2-", _s(n * n))),
        (t("x^2+", s), t("x^2+", _s(n + 1))),
        (t("\\frac{1}{x+", s, "}"), t("(", s, "+x)^{-1}")),
        (t("2x+", s), t("2x-", s)),
        (t("y=", s, "x"), t("x \\cdot ", s)),
        (t("\\sin(x)+\\sqrt{", s, "x}"), t("\\sqrt{x}\\sqrt{", s, "}+\\sin x")),
        (t("\\frac{x^2-", _s(n * n), "}{x-", s, "}"), t("x+", s)),
        (t("listen ", s), t("silent ", s)),
        # sets of numbers
        (t("x>", s), t("(", s, ",\\infty)")),
        (t("[0,", s, "]\\cup[", s, ",", _s(n + 1), "]"), t("[0,", _s(n + 1), "]")),
        (t("(0,", s, ")"), t("[0,", s, "]")),
        (t("x\\geq ", s), t("x>", s)),
        (t("0<x\\le ", s), t("x \\in (0, ", s, "]")),
    ]
    return _pairs(line, forms)
