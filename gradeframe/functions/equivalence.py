"""When two answers are equal.

An answer is read into three values: a canonical text, an option letter and a number.
Two answers are equal when any of the three agree, when both are expressions for the same
function (``algebra``), or when both are the same set of numbers (``intervals``).  Of an answer with a closed ``\\boxed{...}`` the last one counts:

* canonical text: delimiters, spacing commands, units, degree signs, trailing
  zeros, a trailing period, bold marks and a leading dollar sign removed; sets, and
  plain lists of numbers, in sorted order;
* option letter: ``A`` to ``E``, also as ``(A)``;
* number: decimals, ``p/q``, ``\\frac{p}{q}``, mixed numbers, percentages, powers
  and multiples of a square root or of pi, also behind ``x =``; equal within 1e-6,
  small numbers within a thousandth.

Equality beyond that can be had by passing an ``equal`` function of your own to the callers.

``parse_answer`` and ``answers_equal`` are the two halves, so that an answer that is
compared several times is read once, as a struct column.

Every intermediate value is bound inside its expression rather than put in a column of
its own: Catalyst pushes a filter on a verdict below the projection by repeating the
verdict's expression, and a chain of columns would multiply at each step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import fixed as K
from .algebra import same_function_sql
from .intervals import same_set_sql
from .text import BOX_REGEX_DEPTH, ColumnOrName, _balanced as balanced, _c, boxed_final, boxed_last, null_if_empty, strip

TOLERANCE = 1e-6
EqualFn = Callable[[Column, Column], Column]

_NUM = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_SIMPLE = r"\A[+-]?[0-9A-Za-z]+(?:/[0-9]+)?\z"
_BRACED = r"(?:[^{}]++|\{" + balanced(BOX_REGEX_DEPTH) + r"\})++"


# The long chains below are SQL over one variable x, behind a lambda: the value they
# work on is computed once, the plan stays small, and only the quick tests in front of
# them are compiled into the row loop.  The lambda is the last step of a fold over no
# elements: unlike a transform of one, it builds no array per row.
def _let(value: Column, body: str) -> Column:
    """SQL `body` with x bound to `value`."""
    return F.call_function("aggregate", F.array(), value, F.expr("(x, e) -> x"), F.expr(f"x -> {body}"))


def _group(x: str, pattern: str, i: int) -> str:
    return f"regexp_extract({x}, r'{pattern}', {i})"


def _double(x: str) -> str:
    return f"try_cast({x} AS double)"


def _stripped(x: Column) -> Column:
    """A bound text without white space at its ends; most have none, which two characters tell."""
    seen = lambda c: F.ascii(c).between(33, 126)
    return F.when(seen(x) & seen(F.substring(x, -1, 1)), x).otherwise(strip(x))


# ---------------------------------------------------------------- canonical text
def _opened(x: Column) -> Column:
    """The last closed box of a text that has one."""
    return F.when(x.contains(K.BOX_OPEN), F.coalesce(boxed_final(x), x)).otherwise(x)


def _without_delimiters(x: Column) -> Column:
    """Drop one outer ``**..**``, ``$..$``, ``$$..$$``, ``\\(..\\)`` or ``\\[..\\]``, or the
    dollar sign before a number, then strip."""
    marked = x.startswith("$") | x.startswith("\\") | x.startswith("*")
    bold = x.startswith("**") & x.endswith("**") & (F.length(x) >= 4)
    inner = F.when(bold, strip(F.substring(x, F.lit(3), F.length(x) - 4))).otherwise(x)
    return F.when(marked, _bind(inner, _without_math_marks)).otherwise(_stripped(x))


def _without_math_marks(x: Column) -> Column:
    inner = (
        F.when(
            x.startswith("$$") & x.endswith("$$") & (F.length(x) >= 4),
            F.substring(x, F.lit(3), F.length(x) - 4),
        )
        .when(
            x.startswith("$") & x.endswith("$") & (F.length(x) >= 2),
            F.substring(x, F.lit(2), F.length(x) - 2),
        )
        .when(
            (x.startswith("\\(") & x.endswith("\\)"))
            | (x.startswith("\\[") & x.endswith("\\]")),
            F.substring(x, F.lit(3), F.length(x) - 4),
        )
        .when(x.rlike(r"\A\$[0-9.][^$]*\z"), F.substring(x, F.lit(2), F.length(x)))
        .otherwise(x)
    )
    return _bind(inner, _stripped)


def _step(text: str, when: str, rewrite: str) -> str:
    """SQL: y bound to `text`, rewritten where the cheap test says that it may apply."""
    return f"aggregate(array(), {text}, (y, e) -> y, y -> IF({when}, {rewrite}, y))"


def _sub(text: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({text}, r'{pattern}', r'{repl}')"


def _drop(text: str, *literals: tuple[str, str]) -> str:
    for old, new in literals:
        text = f"replace({text}, r'{old}', r'{new}')"
    return text


def _has(*literals: str) -> str:
    return " OR ".join(f"contains(y, r'{x}')" for x in literals)


# a character that some step below looks for
_REWRITABLE = r"[\\\s\xa0~°{.]"


def _rewrite_steps() -> str:
    """SQL over x: every rewrite of a canonical text, in order."""
    y = _step(
        "x",
        _has("\\"),
        _sub(
            _drop("y", (r"\dfrac", r"\frac"), (r"\tfrac", r"\frac"), (r"\%", "%"), (r"\$", "")),
            r"\\(?:left|right)(?![A-Za-z])|\\[!,;: ]",
            "",
        ),
    )
    # a unit after a number, then any other text command
    unit = r"([0-9}])[ ~]*\\(?:text|mathrm|mbox)\{[^{}]*\}(?:\^\{?[0-9]\}?)?[. ]*\z"
    words = r"\\(?:text|textbf|mathrm|mathbf|mbox)\{([^{}]*)\}"
    y = _step(y, _has(r"\text", r"\math", r"\mbox"), _sub(_sub("y", unit, "$1"), words, "$1"))
    plain_unit = r"([0-9])[ ~]+(?:" + K.PLAIN_UNITS + r")(?:\^?[23]|[²³])?\.?\z"
    y = _step(y, r"(contains(y, ' ') OR contains(y, '~')) AND y RLIKE r'[0-9][ ~]+[a-zµ][A-Za-z0-9^²³.]*\z'", _sub("y", plain_unit, "$1"))
    degrees = r"\^?\{?\\(?:circ|degree)(?![A-Za-z])\}?|°"
    y = _step(y, _has(r"\circ", r"\degree", "°"), _sub("y", degrees, ""))
    y = _drop(y, ("{,}", ","))
    # one blank per run, then none beside punctuation
    spaces = _sub(
        _sub("y", r"[\s\xa0]{2,}+|[\t-\r\xa0]", " "),
        r" (?![A-Za-z0-9 ])|(?<![A-Za-z0-9 ]) ",
        "",
    )
    y = _step(y, r"y RLIKE r'[\s\xa0]'", spaces)
    y = _step(y, "endswith(y, '.')", _sub("y", r"(?<!\.)\.++\z", ""))
    braces = _sub("y", r"\\frac([0-9])([0-9])", r"\\frac{$1}{$2}")
    braces = _sub(braces, r"\\sqrt([0-9])", r"\\sqrt{$1}")
    y = _step(y, _has(r"\frac", r"\sqrt"), braces)
    y = _step(y, _has("^{"), _sub("y", r"\^\{([A-Za-z0-9])\}", r"^$1"))
    zeros = _sub(
        _sub("y", r"([0-9])\.0++(?![0-9A-Za-z_])", "$1"),
        r"(\.[0-9]*[1-9])0++(?![0-9A-Za-z_])",
        "$1",
    )
    return _step(y, _has("."), zeros)


_GROUPED = r"\A[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?%?\z"
_SET = r"\A\\\{[^()\[\]{}]*,[^()\[\]{}]*\\\}\z"
_ELEMENT = r"[^()\[\]{},0-9]*+[0-9][^()\[\]{},]*+"  # something with a digit in it
_LIST = r"\A" + _ELEMENT + r"(?:," + _ELEMENT + r")++\z"


def _sorted_list(x: Column) -> Column:
    def element(e: Column) -> Column:
        ratio = F.try_divide(
            F.substring_index(e, "/", 1).try_cast("double"), F.substring_index(e, "/", -1).try_cast("double")
        )
        decimal = F.regexp_replace(ratio.cast("string"), r"\.0\z", "")
        return F.when(e.rlike(r"\A[+-]?[0-9]+/[0-9]+\z"), F.coalesce(decimal, e)).otherwise(e)

    return F.array_join(F.array_sort(F.transform(F.split(x, ","), element)), ",")


def _commas_resolved(x: Column) -> Column:
    """Grouped digits joined; sets and plain lists sorted."""
    return (
        F.when(~x.contains(","), x)
        .when(x.rlike(_GROUPED), F.replace(x, F.lit(","), F.lit("")))
        .when(
            x.rlike(_SET),
            F.concat(
                F.lit("\\{"),
                _sorted_list(F.substring(x, F.lit(3), F.length(x) - 4)),
                F.lit("\\}"),
            ),
        )
        .when(x.rlike(_LIST), _sorted_list(x))
        .otherwise(x)
    )


def canonical(answer: ColumnOrName) -> Column:
    """Canonical text of an answer; NULL stays NULL.

    Most answers are a bare word or integer, which no rewrite would change: the test
    for that comes first.
    """
    def unless_simple(x: Column, body: Callable[[Column], Column]) -> Column:
        return F.when(x.rlike(_SIMPLE), x).otherwise(body(x))

    def rewritten(x: Column) -> Column:
        steps = _bind(_let(x, _rewrite_steps()), lambda y: _bind(_stripped(y), _commas_resolved))
        return F.when(x.rlike(_REWRITABLE), steps).otherwise(_commas_resolved(x))

    def opened(x: Column) -> Column:
        bare = _bind(_bind(_stripped(x), _opened), _without_delimiters)
        return _bind(bare, lambda d: unless_simple(d, rewritten))

    return _bind(_c(answer), lambda s: unless_simple(s, opened))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Like `_let`, for a body built from columns."""
    return F.aggregate(F.array(), value, lambda x, _: x, body)


# ------------------------------------------------------------------------- letter
def choice_letter(canon: ColumnOrName) -> Column:
    """``A``..``E`` of ``A`` or ``(A)``; NULL for anything else."""
    c = _c(canon)
    return F.when(
        F.length(c) <= 3,
        null_if_empty(F.regexp_extract(c, r"\A\(?([A-E])\)?\z", 1)),
    )


# ------------------------------------------------------------------------- number
_WHOLE = r"\A[0-9]{1,15}\z"
_PLAIN = r"\A[+-]?" + _NUM + r"\z"
_TERM = (
    r"\A([+-]?)(" + _NUM + r")?(?:\\cdot|\\times|\*)?(?:\\sqrt\{(" + _NUM + r")\})?"
    r"(?:\\cdot|\\times|\*)?(\\pi|π)?\z"
)
_TERM_END = r"[0-9iπ]\}?\z"
_POWER = (
    r"\A([+-]?)(?:(" + _NUM + r")(?:\\cdot|\\times|\*))?([0-9]+)\^(?:\{([+-]?[0-9]+)\}|([0-9]))\z"
)
_FRAC = (
    r"\A([+-]?)([0-9]*)\\frac\{(" + _BRACED + r")\}\{(" + _BRACED + r")\}(\\pi|π)?\z"
)
_SLASH = r"\A([^/]+)/([^/]+)\z"
_ASSIGN = r"\A[A-Za-z](?:_(?:[A-Za-z0-9]|\{[A-Za-z0-9]+\}))?="


def _factor(x: str, pattern: str, i: int, default: str, of: str = "{}") -> str:
    value = of.format(_double(f"nullif({_group(x, pattern, i)}, '')"))
    return f"coalesce({value}, {default})"


def _sign(x: str, pattern: str) -> str:
    return f"if({_group(x, pattern, 1)} = '-', -1D, 1D)"


def _term_value(x: str) -> str:
    """Sign, coefficient, square root, pi: at least one of the last three."""
    pi = f"if({_group(x, _TERM, 4)} <> '', pi(), 1D)"
    product = " * ".join(
        (_sign(x, _TERM), _factor(x, _TERM, 2, "1D"), _factor(x, _TERM, 3, "1D", "sqrt({})"), pi)
    )
    return (
        f"CASE WHEN {x} RLIKE r'{_PLAIN}' THEN {_double(x)} "
        f"WHEN {x} RLIKE r'{_TERM_END}' AND {x} RLIKE r'{_TERM}' THEN {product} END"
    )


def _term_of(text: str) -> str:
    return f"aggregate(array(), {text}, (t, e) -> t, t -> {_term_value('t')})"


def _power_value(x: str) -> str:
    exponent = _double(f"coalesce(nullif({_group(x, _POWER, 4)}, ''), {_group(x, _POWER, 5)})")
    base = f"pow({_double(_group(x, _POWER, 3))}, {exponent})"
    return f"{_sign(x, _POWER)} * {_factor(x, _POWER, 2, '1D')} * {base}"


def _frac_value(x: str) -> str:
    """``\\frac{p}{q}`` with an optional sign, whole part and trailing pi."""
    ratio = f"try_divide({_term_of(_group(x, _FRAC, 3))}, {_term_of(_group(x, _FRAC, 4))})"
    pi = f"if({_group(x, _FRAC, 5)} <> '', pi(), 1D)"
    return f"{_sign(x, _FRAC)} * ({_factor(x, _FRAC, 2, '0D')} + {ratio}) * {pi}"


def _slow_number() -> str:
    body = r"regexp_replace(x, r'%\z', '')"
    ratio = f"try_divide({_term_of(_group('x', _SLASH, 1))}, {_term_of(_group('x', _SLASH, 2))})"
    return (
        f"CASE WHEN endswith(x, '%') AND {body} RLIKE r'{_PLAIN}' THEN {_double(body)} / 100 "
        f"WHEN contains(x, r'\\frac') AND x RLIKE r'{_FRAC}' THEN {_frac_value('x')} "
        f"WHEN contains(x, '/') AND x RLIKE r'{_SLASH}' THEN {ratio} "
        f"WHEN contains(x, '^') AND x RLIKE r'{_POWER}' THEN {_power_value('x')} "
        f"ELSE {_term_value('x')} END"
    )


# fixed alphabet of every other number form, with a digit or pi somewhere
_NUMERIC = r"\A(?=.*(?:[0-9π]|\\pi))[0-9A-Za-z.+*/^%{}\\π_=-]*\z"


def _number_of(canon: Column) -> Column:
    right_side = F.when(
        canon.contains("="), F.regexp_replace(canon, F.lit(_ASSIGN), F.lit(""))
    ).otherwise(canon)
    return (
        F.when(canon.rlike(_PLAIN), canon.try_cast("double"))
        .when(canon.rlike(_NUMERIC), _let(right_side, _slow_number()))
    )


def number(canon: ColumnOrName) -> Column:
    """Value of a canonical text as a double; NULL if it is not a number."""
    return _number_of(_c(canon))


# --------------------------------------------------------------------- comparison
def parse_answer(answer: ColumnOrName) -> Column:
    """struct<canon, letter, num>: everything that equality looks at.

    Whole numbers, the most frequent answers, take one test.
    """
    def read(c: Column, letter: Column, num: Column) -> Column:
        return F.struct(c.alias("canon"), letter.alias("letter"), num.alias("num"))

    def unless_whole(c: Column, body: Callable[[Column], Column]) -> Column:
        whole = read(c, F.lit(None).cast("string"), c.try_cast("double"))
        return F.when(c.rlike(_WHOLE), whole).otherwise(body(c))

    return _bind(
        _c(answer),
        lambda s: unless_whole(
            s, lambda s: _bind(canonical(s), lambda c: unless_whole(c, lambda c: read(c, choice_letter(c), number(c))))
        ),
    )


_NUMBERS = "x.a.num IS NOT NULL AND x.b.num IS NOT NULL"
_NEAR = f"abs(x.a.num - x.b.num) <= least({TOLERANCE}D, 1e-3D * greatest(abs(x.a.num), abs(x.b.num)))"
_SAME_FUNCTION = same_function_sql("x.a.canon", "x.b.canon")
_SAME_SET = same_set_sql("x.a.canon", "x.b.canon")


def answers_equal(a: Column, b: Column) -> Column:
    """Equality of two `parse_answer` structs; never NULL."""
    # two numbers have been compared; more is read only where nothing else decides
    equal = (
        "CASE WHEN x.a.canon = x.b.canon AND x.a.canon <> '' THEN true WHEN x.a.letter = x.b.letter THEN true "
        f"WHEN {_NUMBERS} THEN {_NEAR} ELSE {_SAME_FUNCTION} OR {_SAME_SET} END"
    )
    return _let(F.struct(a.alias("a"), b.alias("b")), equal)


def equivalent(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Are two answer texts equal?  NULL or empty on either side is not."""
    return answers_equal(parse_answer(a), parse_answer(b))


def equivalent_or_same(
    a: ColumnOrName, b: ColumnOrName, equal: EqualFn | None = None
) -> Column:
    """Equal as answers, or the same string; never NULL.

    The same string settles it without reading either answer.  With `equal=undecided`
    anything else is left open as NULL, for `evaluate.compared_by_pair`.
    """
    a, b = _c(a), _c(b)
    if equal is undecided:
        return F.when(same_text(a, b), True)
    return same_text(a, b) | F.coalesce((equal or equivalent)(a, b), F.lit(False))


def undecided(a: Column, b: Column) -> Column:
    """Leaves it open whether two answers are equal."""
    return F.lit(None).cast("boolean")


def same_text(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.coalesce(_c(a) == _c(b), F.lit(False))


# ------------------------------------------------------------- answers in free text
_MATH_SPAN = r"\$([^$]+)\$"
# the last line with a digit, to look there before the whole text
_LAST_DIGIT_LINE = r"(?s)\A(?:.*\n)?([^\n]*[0-9].*)\z"
_NUMBER_IN_TEXT = (
    r"(?<![0-9A-Za-z.)}])([+-]?(?:\\d?frac\{[0-9]+\}\{[0-9]+\}"
    r"|[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:/[0-9]+)?|\.[0-9]+)%?)"
)
_LETTER_IN_TEXT = r"(?<![\p{L}\p{N}_])([A-E])(?![\p{L}\p{N}_])"


def _last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1))


def final_answer(text: ColumnOrName, last_box: Column | None = None) -> Column:
    """The answer a whole text ends with.

    The first of: content of the last box if it closes, last ``$..$`` span, last
    number, last single letter A-E, the stripped text.  Pass `last_box` when that
    column is already there.
    """
    text = _c(text)
    return F.coalesce(
        boxed_last(text) if last_box is None else last_box,
        F.when(text.contains("$"), _last_match(text, _MATH_SPAN)),
        F.when(
            text.contains("\n"),
            _last_match(F.regexp_extract(text, _LAST_DIGIT_LINE, 1), _NUMBER_IN_TEXT),
        ),
        _last_match(text, _NUMBER_IN_TEXT),
        _last_match(text, _LETTER_IN_TEXT),
        strip(text),
    )


def label_is_readable(canon: ColumnOrName) -> Column:
    """A label that can be compared: a number, a letter, or text with math in it."""
    c = _c(canon)
    return F.coalesce(
        (c != "")
        & (c.rlike(r"[0-9\\+*/=<>^-]") | choice_letter(c).isNotNull()),
        F.lit(False),
    )
