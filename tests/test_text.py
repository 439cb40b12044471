"""Text operators against small models of their semantics."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from gradeframe.functions import fixed as K, text as T


def texts(alphabet, n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


BOXES = ["\\boxed{", "{", "}", "a", "\n", "{{", "}}", "\\boxed", "x1", "\n\n\\boxed{"]
DEEP = ["\\boxed{" + "{" * k + "a" + "}" * (k - d) + "}" for k in range(30) for d in (0, 1)]
LONG = [
    "\\boxed{" + "\\frac{1}{2}" * 20000,
    "\\boxed{" + "\\frac{1}{2}" * 20000 + "}",
    "{" * 20000 + "\\boxed{" + "{" * 20000 + "}" * 20001,
]


def last_box(text):
    start = text.rfind("\\boxed{")
    if start < 0:
        return None
    depth = 1
    for i in range(start + 7, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start + 7 : i]
    return None


def box_regex():
    inner = r"\{.*?\}"
    for _ in range(2):
        inner = r"\{(?:(?>[^{}]+)|" + inner + r")*\}"
    return r"\\boxed\{((?:(?>[^{}]+)|" + inner + r")*)\}"


def test_last_box(values):
    sample = texts(BOXES, 6000, 24, 1) + DEEP + LONG
    assert values(sample, T.boxed_last("t")) == [last_box(t) for t in sample]


def test_all_boxes(values):
    sample = texts(BOXES, 6000, 24, 2) + DEEP
    pattern = regex.compile(box_regex(), regex.S)
    assert values(sample, T.boxed_all("t")) == [pattern.findall(t) for t in sample]


def test_long_boxes_do_not_overflow(values):
    assert values(LONG, T.boxed_count("t")) == [0, 1, 1]


def test_box_at_the_end(values):
    sample = ["x\n\n" + t for t in texts(BOXES, 6000, 16, 3)] + ["y\n\n" + t for t in DEEP]
    pattern = regex.compile(r".+\n\n" + box_regex() + r"(?![\s\S])", regex.S | regex.M)
    want = [bool(pattern.match(t)) for t in sample]
    assert sum(want) > 100
    assert values(sample, T.ends_with_box("t")) == want


TAGS = ["<think>", "</think>", "<answer>", "</answer>", "<desc>", "</desc>", "a", "\n", "\r", " ",
        "\u2028", "\x1c", "\n\n"]


def test_tag_bodies(values):
    sample = texts(TAGS, 6000, 12, 4)

    def first(t, flags=0):
        m = re.search("<answer>(.*?)</answer>", t, flags)
        return m.group(1).strip() if m else None

    def single(t, tag):
        found = re.findall(f"<{tag}>(.*?)</{tag}>", t, re.S)
        return found[0] if len(found) == 1 else None

    got = values(sample, T.answer_tag("t"), T.answer_tag_multiline("t"), T.think_body("t"), T.desc_body("t"))
    assert got == [(first(t), first(t, re.S), single(t, "think"), single(t, "desc")) for t in sample]


def test_whole_text_formats(values):
    blocks = ["<desc>", "</desc>", "<think>", "</think>", "<answer>", "</answer>", "x", "\n", "\x85", "\x1c"]
    sample = texts(blocks, 3000, 12, 5)
    rng = random.Random(6)
    for _ in range(4000):
        parts = ["<desc>", "d", "</desc>", rng.choice(["", "\n", "\x1c", "\x85"]), "<think>", "r",
                 "</think>", rng.choice(["", " ", "q"]), "<answer>", "a", "</answer>"]
        if rng.random() < 0.3:
            parts.insert(rng.randrange(len(parts)), rng.choice(blocks))
        sample.append("".join(parts))
    for _ in range(3000):
        parts = ["<think>\n\n", "r", "\n\n</think>\n\n", "<answer>", "a", "</answer>"]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts)), rng.choice(blocks + ["\n\n</think>\n\n<answer>"]))
        sample.append("".join(parts))
    desc = regex.compile(r"\A<desc>.*?</desc>\s*<think>.*?</think>\s*<answer>.*?</answer>\Z", regex.S)
    think = regex.compile(r"\A<think>\n\n.*?\n\n</think>\n\n<answer>.*?</answer>\Z", regex.S)
    want = [(bool(desc.match(t)), bool(think.match(t))) for t in sample]
    assert sum(w[0] for w in want) > 500 and sum(w[1] for w in want) > 500
    got = values(sample, T.has_desc_think_answer_format("t"), T.has_think_answer_format("t"))
    assert got == want


SPACES = [" ", "\t", "\n", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "a", "é"]


def test_whitespace(values):
    sample = texts(SPACES, 3000, 10, 7)
    got = values(sample, T.strip("t"), T.squeeze("t"), T.clean_option("t"))
    want = [
        (t.strip(), re.sub(r"\s+", " ", t.strip()),
         re.sub(r"\s+", " ", t.strip().replace("\n", " ").replace("\r", "")))
        for t in sample
    ]
    assert got == want


def options_model(text, dataset):
    def found(mark, stop):
        return re.findall(mark + r"\s*(.*?)(?=" + stop + r"|$)", text, re.S | re.M)

    colon, dot, paren = (r"([A-E]):", r"[A-E]:"), (r"([A-E])\.", r"[A-E]\."), (r"\(([A-E])\)", r"\([A-E]\)")
    if dataset in (K.WE_MATH, K.MATHVERSE):
        pairs = found(*(dot if dataset == K.WE_MATH else colon))
        return [(a, re.sub(r"\s+", " ", b.strip().replace("\r", ""))) for a, b in pairs]
    for notation in (colon, dot, paren):
        pairs = found(*notation)
        if len(pairs) >= 2:
            return [(a, b.strip()) for a, b in pairs]
    return []


@pytest.mark.parametrize("dataset", [K.WE_MATH, K.MATHVERSE, K.UNKNOWN])
def test_options(values, dataset):
    sample = texts(["A", "B", "C", "E", ":", ".", "(", ")", "(B) ", "A. ", "B: ", "x", " ", "\n", "\r", "yy", "\u2028"], 4000, 14, 8)
    got = values(sample, T.options_from_question("t", F.lit(dataset)))
    assert [[tuple(o) for o in row] for row in got] == [options_model(t, dataset) for t in sample]


def test_options_until_semicolon(values):
    sample = texts(["A.", "B. ", ";", "x", "\n", " ", "C:", "y"], 4000, 10, 9)
    for dataset, mark in ((K.WE_MATH, r"([A-E])\."), (K.MATHVERSE, r"([A-E]):")):
        got = values(sample, T.options_until_semicolon("t", dataset))
        want = [[(a, b.strip()) for a, b in re.findall(mark + r"\s*(.*?)(?=;|$)", t)] for t in sample]
        assert [[tuple(o) for o in row] for row in got] == want
    with pytest.raises(ValueError):
        T.options_until_semicolon("t", K.MATHVISTA)


def test_option_list_closes_gaps_and_keeps_the_last(values):
    got = values(["A: one C: two A: three"], T.option_list(T.options_from_question("t", F.lit(""))))
    assert got == [["three", "two"]]


def test_wrapping(values):
    sample = ["", "$", "1", "$1$", "$1", "1$"]
    assert values(sample, T.wrap_math("t")) == ["", "$", "$1$", "$1$", "$$1$", "$1$$"]
    assert values(sample, T.wrap_math_unless_dollar("t")) == ["$$", "$", "$1$", "$1$", "$1", "1$"]


def test_select_answer(values):
    sample = ["\\boxed{} t ", " no box ", "\\boxed{1}", "<answer> 2 </answer>", "<answer></answer> ", "<answer>a\nb</answer>"]
    assert values(sample, T.select_answer("t", K.SYSTEM_PROMPT_BOXED)) == [
        "\\boxed{} t", "no box", "$1$", "<answer> 2 </answer>", "<answer></answer>", "<answer>a\nb</answer>"]
    assert values(sample, T.select_answer("t", K.SYSTEM_PROMPT_THINK_ANSWER)) == [
        "\\boxed{} t", "no box", "\\boxed{1}", "$2$", "<answer></answer>", "<answer>a\nb</answer>"]


def test_image_keys(values):
    sample = ["a/image20.png", "image7.x.png", "image.png", "images3.png", "image12", "b/c/image003.jpeg", "image4.", "image9/x"]
    assert values(sample, T.image_number("t")) == [20, None, None, None, None, 3, 4, None]
    assert values(["a/b/c.png", "b/c.png", "c.png"], T.image_folder_key("t")) == ["b/c.png", "b/c.png", "c.png"]


def test_file_names(values):
    sample = ["MathVerse.jsonl", "x_we-math", "WeMath.jsonl", "a_MATHVISTA", "dynamath", "DynaMath_mathverse", "z"]
    assert values(sample, T.dataset_from_file("t")) == [
        K.MATHVERSE, K.WE_MATH, K.WE_MATH, K.MATHVISTA, K.DYNAMATH, K.MATHVERSE, K.UNKNOWN]
    assert values(sample, T.is_trial_file("t")) == [False] * 5 + [True, False]
    assert values(["a/b/c/d", "a/b", "a/b/c/"], T.model_folder("t")) == ["b/c/d", "a/b", "b/c/"]


def test_fixed_decimals(spark):
    rng = random.Random(3)
    xs = [15.625, 2.675, 0.125, 0.005, 0.015, 0.0, -2.5, 1e-12, 1e20, 99.995, 100.0]
    xs += [rng.randint(0, 20000) / rng.choice([8, 16, 64, 100, 1000, 3, 7]) for _ in range(5000)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for digits in (2, 4):
        rows = df.select("x", T.fixed_decimals("x", digits).alias("t")).collect()
        assert [r.t for r in rows] == [f"{r.x:.{digits}f}" for r in rows]


def test_counts(values):
    sample = texts(TAGS, 1000, 8, 10)
    got = values(sample, T.occurrences("t", "<think>"), T.occurs_once("t", "</answer>"))
    assert got == [(t.count("<think>"), t.count("</answer>") == 1) for t in sample]
    assert values(["a b, c!", ""], T.token_count("t")) == [5, 0]


def test_tags_against_python(values):
    import random
    import re

    rng = random.Random(3)
    parts = ["<answer>", "</answer>", "x", "\n", " ", "<answer", "</think>", "ü"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)]

    def first(text, flags):
        m = re.search("<answer>(.*?)</answer>", text, flags)
        return m and m[1].strip()

    def single(text):
        found = re.findall("<answer>(.*?)</answer>", text, re.S)
        return found[0] if len(found) == 1 else None

    assert values(texts, T.tag_body("t", "answer")) == [first(x, 0) for x in texts]
    assert values(texts, T.tag_body("t", "answer", True)) == [first(x, re.S) for x in texts]
    assert values(texts, T.single_tag_body("t", "answer")) == [single(x) for x in texts]
    assert values(texts, T.tag_bodies("t", "answer")) == [re.findall("<answer>(.*?)</answer>", x, re.S) for x in texts]


def test_repeated_marks_take_linear_time(values):
    import time

    n = 20_000
    cases = [
        (["\\boxed{" * n, "} " + "\\boxed{" * n], T.boxed_all("t"), [[], []]),
        (["<think>" * n, "</think>" + "<think>" * n], T.think_body("t"), [None, None]),
        (["<desc>" * n, "</desc>" + "<desc>" * n], T.desc_body("t"), [None, None]),
        (["<answer>" * n, "</answer>" + "<answer>" * n], T.answer_tag("t"), [None, None]),
        (["<answer>" * n, "</answer>\n" + "<answer>\n" * n], T.answer_tag_multiline("t"), [None, None]),
        (["<answer>" * n + "1</answer>"], F.length(T.answer_tag("t")), [8 * (n - 1) + 1]),
    ]
    values(["x"], T.boxed_all("t"))
    for texts, column, want in cases:
        start = time.perf_counter()
        assert values(texts, column) == want
        assert time.perf_counter() - start < 20


def test_decimals_of_large_numbers(spark):
    rows = [1e15 + 0.125, 2.0**52 + 0.5, 2.0**53 - 1, 2.0**53, 2.0**60, -(2.0**55)]
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    got = [r[0] for r in df.select(T.fixed_decimals("x", 2)).collect()]
    assert got == [f"{x:.2f}" for x in rows]
