"""Equivalence, choices and rewards: hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from gradeframe import REWARDS, register_reward, score, with_choice_match
from gradeframe.functions import fixed as K
from gradeframe.functions.equivalence import equivalent, equivalent_or_same, final_answer, parse_answer
from gradeframe.operators import evaluate
from gradeframe.operators.evaluate import evaluate_responses

EQUAL = [
    ("12", "12.0"), ("$\\frac{24}{2}$", "12"), ("12\\%", "0.12"), ("2\\sqrt{3}", "\\sqrt{12}"),
    ("x=12", "12"), ("1{,}234", "1,234"), ("1,234", "1234"), ("(A)", "A"), ("\\{2,1\\}", "\\{1, 2\\}"),
    ("\\text{red}", "red"), ("5\\text{ cm}", "5"), ("90^\\circ", "90"), ("2^{10}", "1024"),
    ("3\\times10^8", "300000000"), ("\\frac{\\sqrt{3}}{2}", "0.8660254"), ("\\frac{\\pi}{4}", "0.7853982"),
    ("1\\frac{1}{2}", "3/2"), ("-\\frac12", "-0.5"), ("( 1 , 2.0)", "(1,2)"), ("x + 1", "x+1"),
    ("12^2", "144"), ("A.", "A"), ("New York", "New York."), ("\\left(1,2\\right)", "(1,2)"),
    ("1,2", "2, 1"), ("\\pi", "3.14159265"), ("50%", "1/2"), ("\\frac{2\\pi}{3}", "2.0943951"),
    ("3.50", "3.5"), ("\\(7\\)", "7"), ("\\[7\\]", "$$7$$"), ("\\$5", "5"), ("\\dfrac{3}{4}", "0.75"),
]
DIFFERENT = [
    ("12", "13"), ("", ""), ("1/0", "2"), ("\\frac{1}{0}", "1"), ("5d", "5"), ("1e5", "100000"),
    ("C", "c"), ("(1,2)", "(2,1)"), ("12\\sqrt{2}cm", "12"), ("A", "B"), ("-3", "3"), (None, "1"), (None, None),
]

SAME_FUNCTION = [
    ("x+1", "1+x"), ("(x+1)^2", "x^2+2x+1"), ("\\frac{x}{2}", "0.5x"), ("(x+1)(x-1)", "x^2-1"), ("\\frac{x^2-1}{x-1}", "x+1"),
    ("\\sqrt{2}x", "x\\sqrt2"), ("2\\sqrt{x+1}", "\\sqrt{4x+4}"), ("\\frac{1}{x}", "x^{-1}"), ("y=2x+1", "1+2x"), ("f(x)=x^2", "x^{2}"),
    ("\\sin x+\\cos x", "\\cos x+\\sin(x)"), ("\\sin(2x)", "2\\sin x\\cos x"), ("\\frac{\\sqrt{3}}{3}a", "\\frac{a}{\\sqrt{3}}"),
    ("2^{n+1}", "2\\cdot2^n"), ("-\\frac{x+1}{2}", "\\frac{-x-1}{2}"), ("a_1+a_2", "a_2+a_1"), ("a_{10}b", "ba_{10}"), ("x", "\\frac{2x}{2}"),
    ("\\frac{\\pi r^2}{2}", "0.5\\pi r^2"), ("e^{2x}", "(e^x)^2"), ("\\ln(x^2)", "2\\ln x"), ("3-2", "1"), ("((((x))))", "x+0"), ("2(3+4)", "14"),
    ("\\sqrt[3]{8}x", "2x"), ("x^{100}", "x^{50}x^{50}"), ("\\frac{n(n+1)}{2}", "\\frac{n^2+n}{2}"), ("10-15", "-5"),
    ("\\alpha+\\beta", "\\beta+\\alpha"), ("\\tan\\theta", "\\frac{\\sin\\theta}{\\cos\\theta}"),
]
OTHER_FUNCTION = [
    ("\\sin^2", "\\cos^2"), ("x^2+2x+2", "(x+1)^2"), ("x+1", "x-1"), ("x+y", "x+z"), ("\\frac{x}{2}", "0.51x"),
    ("x+12345678901234567", "x+12345678901234568"), ("x+0.000000000001", "x"), ("listen", "silent"), ("no", "on"), ("AB", "BA"),
    ("two-way", "way-two"), ("1\\frac{1}{2}x", "0.5x"), ("(x", "x"), ("x+", "x"), ("\\frac{x}{0}", "\\frac{y}{0}"),
]

SAME_SET = [
    ("x>2", "(2,\\infty)"), ("[0,1]\\cup[1,2]", "[0,2]"), ("x\\ge 2", "[2,\\infty)"), ("2<x\\leq 5", "(2,5]"), ("5\\geq x>2", "(2, 5]"),
    ("x<1\\text{ or }x>2", "(-\\infty,1)\\cup(2,\\infty)"), ("x\\neq 3", "(-\\infty,3)\\cup(3,+\\infty)"), ("(0,1]\\cup(1,2)", "(0,2)"),
    ("[1,2]\\cup[0,1]", "[0,2]"), ("x \\in (0, \\frac{1}{2}]", "0<x\\le0.5"), ("\\mathbb{R}", "(-\\infty,\\infty)"),
    ("(-\\sqrt{2},\\sqrt{2})", "-\\sqrt2<x<\\sqrt2"), ("x>2", "y>2"), ("\\{x|x>2\\}", "(2,\\infty)"),
    ("\\left(-\\infty,-1\\right]\\cup\\left[1,\\infty\\right)", "x\\le-1 or x\\ge 1"), ("[0,3]\\cup[1,2]", "[0,3]"), ("(0,2\\pi]", "0<x\\leq 2\\pi"),
    ("2\\le x", "x\\ge2"), ("1/2<x<3/4", "(0.5,0.75)"),
]
OTHER_SET = [
    ("(0,1)", "[0,1]"), ("(0,1)\\cup(1,2)", "(0,2)"), ("(1,2)", "(2,1)"), ("x>2", "x\\ge2"), ("x>2", "x>3"), ("(a,b)", "[a,b]"), ("[2,2]", "[2,2)"),
    ("(1,2,3)", "(1,2,4)"),
]


def test_equivalence(spark):
    rows = [(a, b, True) for a, b in EQUAL + SAME_FUNCTION + SAME_SET] + [(a, b, False) for a, b in DIFFERENT + OTHER_FUNCTION + OTHER_SET]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select("a", "b", "want", equivalent("a", "b").alias("x"), equivalent("b", "a").alias("y")).collect()
    assert [r for r in got if r.x != r.want or r.y != r.want] == []


def test_random_unions_against_points(spark):
    """Two unions are equal if they hold the same points, ends and midpoints among them."""
    import random

    draw = random.Random(6)

    def union():
        parts = []
        for _ in range(draw.randint(1, 3)):
            lo = draw.randint(0, 4)
            parts.append((lo, draw.random() < 0.5, lo + draw.randint(1, 3), draw.random() < 0.5))
        return parts

    def holds(parts, x):
        return any((lo < x or lo == x and lc) and (x < hi or x == hi and hc) for lo, lc, hi, hc in parts)

    def text(parts, chain):
        if chain:
            return " or ".join(f"{lo}{'<' + '=' * lc}x{'<' + '=' * hc}{hi}" for lo, lc, hi, hc in parts)
        return "\\cup ".join(f"{'([' [lc]}{lo},{hi}{')]'[hc]}" for lo, lc, hi, hc in parts)

    rows, points = [], [i / 2 for i in range(-1, 16)]
    for _ in range(200):
        a, b = union(), union()
        if draw.random() < 0.5:  # the same set in other parts
            b = [p for lo, lc, hi, hc in a for p in ((lo, lc, (lo + hi) / 2, True), ((lo + hi) / 2, draw.random() < 0.5, hi, hc))]
        rows.append((text(a, draw.random() < 0.5), text(b, draw.random() < 0.5), [holds(a, x) for x in points] == [holds(b, x) for x in points]))
    df = spark.createDataFrame(rows, "a string, b string, want boolean").repartition(8)
    assert {r[2] for r in rows} == {True, False}
    assert df.where(equivalent("a", "b") != F.col("want")).collect() == []


def test_random_expressions_against_values(spark):
    """Sums and products written in two ways are equal; with one number changed they are not."""
    import random

    draw = random.Random(4)

    def tree(depth):
        if depth == 0:
            return draw.choice(["x", "y", "a_1", str(draw.randint(1, 9)), f"{draw.randint(1, 9)}.5"])
        return (draw.choice("+-*/^"), tree(depth - 1), str(draw.randint(2, 4)) if draw.random() < 0.2 else tree(depth - 1))

    def plain(t):
        if isinstance(t, str):
            return t
        op, a, b = t
        if op == "^":
            return f"({plain(a)})^{{{b if isinstance(b, str) and b.isdigit() else 2}}}"
        return f"({plain(a)}){op}({plain(b)})"

    def latex(t):
        if isinstance(t, str):
            return t
        op, a, b = t
        if op == "^":
            if isinstance(b, str) and b in ("2", "3"):
                return "\\cdot".join([f"({latex(a)})"] * int(b))
            return f"\\left({latex(a)}\\right)^{{{b if isinstance(b, str) and b.isdigit() else 2}}}"
        if op == "/":
            return f"\\frac{{{latex(a)}}}{{{latex(b)}}}"
        if op == "-":
            return f"-({latex(b)})+({latex(a)})"
        return f"({latex(b)}){'+' if op == '+' else ' '}({latex(a)})"

    rows = []
    for _ in range(150):
        t = tree(draw.randint(1, 3))
        rows += [(f"w+{plain(t)}", f"{latex(t)}+w", True), (f"w+{plain(t)}", f"{latex(t)}+w+0.001", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").repartition(8)
    assert df.where(equivalent("a", "b") != F.col("want")).collect() == []


def test_degenerate_answers_stay_cheap(spark):
    long = ["." * 20000, "0." + "3" * 20000, " " * 20000 + "x", "{" * 5000, "\\frac{" + "a" * 20000, "1," * 9000]
    df = spark.createDataFrame([(x,) for x in long], "t string")
    assert df.select(parse_answer("t").alias("p"), final_answer("t").alias("f")).filter("p.canon is null").count() == 0


def test_final_answer(values):
    cases = {
        "the answer is 12": "12", "so $x$ and $\\frac{1}{2}$.": "\\frac{1}{2}", "it is B, or C": "C",
        "A1 x-5": "5", "cost 1,234.50 dollars": "1,234.50", " hello ": "hello", "\\boxed{7} then 8": "7",
        "\\boxed{7} \\boxed{8": "8", "image20.png": "image20.png", "x 4\nno\ny 5 and 6.5\n\nend": "6.5",
        "7\nx8": "7", "5-3": "3", "\n-2\n": "-2", "is 3/4.": "3/4",
    }
    assert values(list(cases), final_answer("t")) == list(cases.values())


def test_custom_equality(spark):
    df = spark.createDataFrame([("a", "A"), ("a", "b")], "x string, y string")
    same = lambda a, b: F.lower(a) == F.lower(b)
    assert [r.z for r in df.select(equivalent_or_same("x", "y", same).alias("z")).collect()] == [True, False]


def test_evaluate_responses(spark):
    rows = [
        ("\\boxed{\\frac{1}{2}}", "0.5", True),
        ("no box, the answer is 12", "12", True),
        ("\\boxed{3} and \\boxed{4", "3", False),
        ("\\boxed{}", "", False),
        ("C", "C", True),
        (None, "1", False),
    ]
    df = spark.createDataFrame(rows, "resp string, answer string, want boolean")
    got = evaluate_responses(df).collect()
    assert [(r.resp, r.verify) for r in got] == [(r[0], r[2]) for r in rows]


CHOICES = [
    # answer, model answer, choices, question, dataset, normalized pair, match
    ("A", "a", None, "", K.UNKNOWN, ("A", "A"), True),
    ("A", "$A$", None, "", K.UNKNOWN, ("A", "A"), True),
    ("B", "two", ["one", "two"], "", K.MATHVISTA, ("B", "B"), True),
    ("two", "three", ["one", "two"], "", K.MATHVISTA, ("two", "three"), False),
    ("two", "$b$", ["one", "two"], "", K.MATHVISTA, ("B", "B"), True),
    # options A, C, D: the list closes the gap, so B means the second one
    ("B", "2 cm", None, "Pick (A) 1 cm (C) 2 cm (D) 3 cm", K.UNKNOWN, ("B", "B"), True),
    # C has place 2, its text has place 1
    ("C", "2 cm", None, "Pick (A) 1 cm (C) 2 cm (D) 3 cm", K.UNKNOWN, ("C", "B"), False),
    ("G", "G", None, "", K.UNKNOWN, ("G", "G"), True),
    ("12", "12.0", None, "", K.UNKNOWN, ("12", "12.0"), True),
    ("F", "B", ["a", "b", "c", "d", "e", "f", "g"], "", K.UNKNOWN, ("F", "B"), False),
    ("g", "6", ["a1", "b1", "c1", "d1", "e1", "f1", "g"], "", K.UNKNOWN, ("g", "6"), False),
    ("B", "10 m", None, "A. 9 m\nB. 10 m\nC. 11 m", K.WE_MATH, ("B", "B"), True),
]


def test_choices(spark):
    rows = [(i, *c[:5]) for i, c in enumerate(CHOICES)]
    df = spark.createDataFrame(
        rows, "i int, answer string, parsed_answer string, choices array<string>, question string, dataset string"
    )
    got = {r.i: r for r in with_choice_match(df).collect()}
    for i, case in enumerate(CHOICES):
        r = got[i]
        assert ((r.normalized_answer, r.normalized_parsed_answer), r.is_match) == case[5:], case


THINK = "<think>\n\nr\n\n</think>\n\n<answer>{}</answer>"
FULL = "<desc>a cat</desc>\n<think>a b c d</think> <answer>\n5</answer>"
REWARD_CASES = {
    "external_math_acc": [("\\boxed{5}", "5", 1.0), ("\\boxed{5}", "6", 0.0), ("x", "red cat", 1.0), ("x", "", 1.0)],
    "external_math_format": [(THINK.format(5), "5", 1.0), ("<think></think>", "", 0.25), (THINK.format(5) + "\n", "", 0.5)],
    "external_r1v_acc": [("<answer>red</answer>", "<answer> red </answer>", 1.0), ("is 5", "5.0", 1.0), ("red", "blue", 0.0)],
    "external_compare_acc": [("\\boxed{1} \\boxed{2}", "2", 1.0), ("2", "2", 0.0)],
    "external_answer_format": [(FULL, "", 1.0), (FULL + " ", "", 0.0)],
    "external_answer_tag_acc": [("<answer>5</answer>", "5.0", 1.0), ("5", "5", 1.0), ("<answer></answer>", "", 0.0),
                                ("<answer>\n5</answer>", "5", 0.0)],
    "external_answer_tag_acc_gauss": [("\\boxed{5}", "5", 1.0), ("\\boxed{5}", "6", math.exp(-1 / (2 + 1e-9))), ("a", "b", 0.0)],
    "external_boxed_verify": [("\\boxed{5}", "5", 1.0), ("\\boxed{5} \\boxed{6", "5", 0.5), ("5", "5", 0.5), ("\\boxed{4} or 5", "5", 0.0)],
    "external_boxed_format": [("\\boxed{}", "", 1.0), ("\\boxed{", "", 0.0)],
    "external_tag_count": [(FULL, "", 1.0), ("<think><think>", "", 0.0)],
    "external_boxed_count": [("\\boxed{1}", "", 1.0), ("\\boxed{1}\\boxed{2}", "", 0.0)],
    "external_boxed_pos": [("ab\\boxed{1}", "", 8 / 11), ("ab", "", 0.0), ("", "", 0.0)],
    "external_acc_format": [("5", "5", 1.0), ("so\n\n\\boxed{4}", "5", 0.0), ("4", "5", -1.0)],
    "external_answer_tag_length_acc": [("<answer>5</answer>", "5", 8 / 512), ("<answer>4</answer>", "5", 0.0)],
    "external_cap_length": [(FULL, "", 1.0), ("<desc>a</desc>", "", 0.0), ("<desc>a b</desc><think>c</think>", "", 0.0)],
    "external_cap_check": [(FULL, "5", 1.0), ("<desc>is 5</desc>", "5", 0.0), ("no", "5", 0.0)],
}


@pytest.mark.parametrize("name", sorted(REWARD_CASES))
def test_reward(spark, name):
    cases = REWARD_CASES[name]
    df = spark.createDataFrame([(i, c, s) for i, (c, s, _) in enumerate(cases)], "i int, completion string, solution string")
    got = {r.i: r[name] for r in score(df, [name]).collect()}
    assert [got[i] for i in range(len(cases))] == pytest.approx([w for *_, w in cases], abs=1e-12)


def test_soft_overlong(spark):
    df = spark.createDataFrame([("", "", n) for n in (5, 10, 20, 30, 50)], "completion string, solution string, n int")
    params = {"soft_overlong": {"soft_max_length": 30, "soft_cache_length": 20}}
    got = score(df, ["soft_overlong"], tokens="n", params=params).orderBy("n").collect()
    assert [r.soft_overlong for r in got] == [0.0, 0.0, -0.5, -1.0, -2.0]
    with pytest.raises(ValueError):
        score(df, ["soft_overlong"], params={"soft_overlong": {"soft_max_length": 5, "soft_cache_length": 5}})


def test_judged_rewards(spark):
    rows = [
        (FULL, "5", "good \\boxed{1}", "\\boxed{5}"),
        (FULL, "5", "bad \\boxed{0}", "\\boxed{4}"),
        (FULL, "1", "\\boxed{1}", None),
        ("no think", "5", "\\boxed{1}", "\\boxed{5}"),
    ]
    df = spark.createDataFrame(rows, "completion string, solution string, tj string, cj string")
    names = ["external_thinking_verify", "external_cap_verify", "external_mm"]
    got = score(df, names, thinking_response="tj", caption_response="cj").collect()
    assert [tuple(r[n] for n in names) for r in got] == [(1.0, 1.0, 3.0), (0.0, 0.0, 2.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    strict = score(df, names[:1], thinking_response="tj", params={names[0]: {"strict_reference": True}})
    assert [r[names[0]] for r in strict.collect()] == [0.0, 0.0, 1.0, 0.0]


def test_registry(spark):
    assert len(REWARDS) >= 20

    @register_reward("length_share")
    def length_share(f, limit=10):
        return F.least(F.length(f("completion")) / limit, F.lit(1.0))

    df = spark.createDataFrame([("abcde", "")], "completion string, solution string")
    try:
        assert score(df, ["length_share"], params={"length_share": {"limit": 20}}).first().length_share == 0.25
        with pytest.raises(KeyError):
            score(df, ["nothing"])
        with pytest.raises(KeyError):
            score(df, ["external_cap_verify"])
    finally:
        REWARDS.pop("length_share")


def test_filter_on_a_verdict_keeps_the_plan_small(spark):
    df = spark.createDataFrame([("1", "1.0", None, "q", "x")], "answer string, parsed_answer string, choices array<string>, question string, dataset string")
    plan = with_choice_match(df).filter("is_match")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000


def test_boxes_count_before_anything_else(spark):
    cases = [
        ("$\\boxed{5}$", "5", True), ("<answer>\\boxed{5}</answer>", "5", True), ("so \\boxed{5}", "5", True),
        ("\\boxed{4} no, \\boxed{5}", "5", True), ("\\boxed{5} and \\boxed{4", "5", True), ("\\boxed{\\frac{10}{2}}", "5", True),
        ("\\boxed{4}", "5", False), ("**5**", "5", True), ("$5", "5", True), ("5 cm", "5", True), ("1/2,3", "3,0.5", True),
        ("Tom, Bob", "Bob, Tom", False), ("0.0000001", "0.0000002", False), ("0.333333", "1/3", True), ("\\boxed{}", "", False),
        ("2^{1000}", "2^{1001}", False), ("\\frac{{{1}}}{2}", "\\frac{1}{2}", True),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, want boolean")
    from gradeframe.functions.equivalence import equivalent

    wrong = df.withColumn("got", equivalent("a", "b")).filter("got <> want").collect()
    assert not wrong, wrong


def test_tagged_box_is_rewarded(spark):
    from gradeframe import score

    df = spark.createDataFrame([("<answer>\\boxed{5}</answer>", "5"), ("so \\boxed{5}", "5")], "completion string, solution string")
    assert [r[0] for r in score(df, ["external_answer_tag_acc"]).select("external_answer_tag_acc").collect()] == [1.0, 1.0]


def test_answers_are_bound_without_an_array_per_row(spark):
    """Reading an answer binds its steps; whole numbers take one test, and white space of all kinds goes."""
    rows = [("17", "17", True), (" 17　", "$17$", True), ("007", "7", True), ("$ 17 $", "17", True), ("17", "18", False),
            ("12345678901234567", "12345678901234568", True), (" A\n", "(A)", True), ("** x+1 **", "1+x", True), (None, "1", False), ("", "", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", equivalent("a", "b"))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]
    plan = df.select(equivalent("a", "b"))._jdf.queryExecution().analyzed().toString()
    assert "transform(array(a#" not in plan and "aggregate(array(), a#" in plan


def test_equal_pairs_are_compared_once(spark, monkeypatch):
    """As row by row, with missing answers, broadcast or not; a dear comparison runs once a pair."""
    pairs = [("2x+1", "1+2x"), ("0.5", "1/2"), (None, "3"), (None, None), ("3", None), ("", ""), ("x", "y")]
    df = spark.createDataFrame([(i, *pairs[i % 7]) for i in range(700)], "id int, x string, y string").repartition(4)
    want = evaluate.with_equal(df, "z", "x", "y").sort("id").collect()
    compared = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(x, y):
        compared.add(1)
        return x == y

    assert evaluate.with_equal_by_pair(df, "z", "x", "y").sort("id").collect() == want
    evaluate.with_equal_by_pair(df, "z", "x", "y", counted).collect()
    assert compared.value <= len(pairs)
    apart = evaluate.compared_by_pair(df, "z", "x", "y", equivalent).where("z").select("x").distinct()
    assert {r.x for r in apart.collect()} == {"2x+1", "0.5"}  # the same empty text is no equal answer
    monkeypatch.setattr(evaluate, "BROADCAST_PAIRS", 3)
    by_merge = evaluate.with_equal_by_pair(df, "z", "x", "y")
    assert "BroadcastHashJoin" not in by_merge._jdf.queryExecution().executedPlan().toString()
    assert by_merge.sort("id").collect() == want
    null_safe = evaluate.with_equal_by_pair(df, "z", "x", "y", lambda x, y: x.eqNullSafe(y))
    assert null_safe.where("x IS NULL AND y IS NULL AND z").count() == 100


def test_responses_are_judged_once_for_each_pair(spark):
    """As row by row, with missing texts; verdicts are stored for each label and parsed answer."""
    texts = ["so \\boxed{\\frac{4}{2}}", "it is 2", None, "", "\\boxed{}", "\\boxed{$3$}", "no box: \\boxed{2"]
    rows = [(i, texts[i % 7], ("2", "3", None)[i % 3]) for i in range(630)]
    df = spark.createDataFrame(rows, "sid int, resp string, answer string").repartition(4)
    want = evaluate.evaluate_responses(df).sort("sid").collect()
    assert {r.verify for r in want} == {True, False}
    judged = evaluate.evaluate_responses_by_pair(df)
    assert judged.sort("sid").collect() == want
    # what the rows are joined with: texts that say the same are one
    assert spark.read.parquet(*judged.inputFiles()).count() <= 21


def test_rewards_read_each_answer_once(spark):
    """Rewards by distinct answers are those row by row; what is stored grows with the answers."""
    texts = ["so \\boxed{\\frac{4}{2}}", "<answer>2.5</answer>", None, "", "\\boxed{}", "<answer>3</answer> \\boxed{3.0}"]
    rows = [(i, texts[i % 6], ("2", "3", None, "x")[i // 6 % 4]) for i in range(480)]
    df = spark.createDataFrame(rows, "sid int, completion string, solution string").repartition(4)
    names = ["external_answer_tag_acc_gauss", "external_answer_tag_length_acc", "external_compare_acc", "external_math_acc"]
    want = score(df, names).sort("sid").collect()
    assert len({r.external_answer_tag_acc_gauss for r in want}) > 2
    scored = score(df, names, by_pair=True)
    assert scored.sort("sid").collect() == want
    assert spark.read.parquet(*scored.inputFiles()).count() <= 24
    # nothing is compared, nothing stored
    assert not score(df, ["external_tag_count"], by_pair=True).inputFiles()
