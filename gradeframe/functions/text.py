"""Text extraction as Spark Column expressions.

Every function maps string columns to a column and stays on the JVM.  Regular
expressions are written so that they need neither backtracking over the whole
text nor recursion per repeated group (possessive loops): model output that
repeats itself for thousands of tokens must not stall or crash a task.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from . import fixed as K

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --------------------------------------------------------------- whitespace
def strip(text: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace (all Unicode whitespace)."""
    return F.btrim(_c(text), F.lit(K.PY_WHITESPACE))


def squeeze(text: ColumnOrName) -> Column:
    """Strip, then turn every whitespace run into one blank."""
    return F.regexp_replace(strip(text), F.lit(K.WS + "++"), F.lit(" "))


def clean_option(text: ColumnOrName) -> Column:
    """Option text on one line: strip, newline to blank, no CR, squeezed."""
    one_line = F.replace(
        F.replace(strip(text), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")
    )
    return F.regexp_replace(one_line, F.lit(K.WS + "++"), F.lit(" "))


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# -------------------------------------------------------------- boxed answer
# Depth up to which the last box is matched by one regular expression; deeper
# boxes take the fold in `_close_box_by_fold`.
BOX_REGEX_DEPTH = 8


@lru_cache(maxsize=None)
def _balanced(depth: int) -> str:
    """Text whose braces are balanced, nested at most `depth` levels."""
    plain = r"[^{}]*+"
    return plain if depth == 0 else (
        plain + r"(?:\{" + _balanced(depth - 1) + r"\}" + plain + r")*+"
    )


def _close_box_by_fold(rest: Column) -> Column:
    """Content up to the brace that closes the box, at any nesting depth.

    `rest` is the text after the opening brace.  Cut at each closing brace, the
    box ends with the first piece whose running depth (opening braces so far
    minus closing braces so far) returns to zero.
    """
    pieces = F.split(rest, r"\}")

    def opens(piece: Column) -> Column:
        return F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))

    start = F.struct(
        F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end")
    )

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + opens(piece) - 1
        seen = acc["seen"] + 1
        closes = (acc["end"] == 0) & (depth == 0) & (seen < F.size(pieces))
        return F.struct(
            depth.alias("depth"),
            seen.alias("seen"),
            F.when(closes, seen).otherwise(acc["end"]).alias("end"),
        )

    end = F.aggregate(pieces, start, step, lambda acc: acc["end"])
    return F.when(end > 0, F.array_join(F.slice(pieces, 1, end), "}"))


def boxed_last(text: ColumnOrName) -> Column:
    """Content of the last ``\\boxed{...}``; NULL if there is none or it never closes.

    A last box that is left open gives NULL even when an earlier box is closed.
    """
    text = _c(text)
    rest = F.substring_index(text, K.BOX_OPEN, -1)
    shallow = F.get(
        F.regexp_extract_all(
            rest, F.lit(r"(?s)\A(" + _balanced(BOX_REGEX_DEPTH) + r")\}"), 1
        ),
        F.lit(0),
    )
    n_open = F.length(rest) - F.length(F.replace(rest, F.lit("{"), F.lit("")))
    deep = F.when(n_open > BOX_REGEX_DEPTH, _close_box_by_fold(rest))
    return F.when(F.contains(text, F.lit(K.BOX_OPEN)), F.coalesce(shallow, deep))


def _box_pattern() -> str:
    """A box whose third inner level may hold anything up to some closing brace.

    Levels one to three are read literally; below that, text is skipped to the
    earliest closing brace from which the rest of the box can still close.  The
    look-ahead states that condition, which makes every choice final, so that
    all loops can be possessive.
    """
    plain, flat2, flat1 = _balanced(0), _balanced(1), _balanced(2)
    # from level three to the end of the box without going below level three
    finish = plain + r"\}" + flat2 + r"\}" + flat1 + r"\}"
    # from level three to another group below level three
    deeper = (
        r"(?:" + plain + r"\{"
        r"|" + plain + r"\}" + flat2 + r"\{" + plain + r"\{"
        r"|" + plain + r"\}" + flat2 + r"\}" + flat1 + r"\{" + flat2 + r"\{" + plain + r"\{)"
    )
    can_close = r"(?=" + finish + r"|" + deeper + r".*\}" + finish + r")"
    level4 = r"\{(?>.*?\}" + can_close + r")"
    level3 = plain + r"(?:" + level4 + plain + r")*+"
    level2 = plain + r"(?:\{" + level3 + r"\}" + plain + r")*+"
    level1 = plain + r"(?:\{" + level2 + r"\}" + plain + r")*+"
    return r"\\boxed\{(" + level1 + r")\}"


BOX_PATTERN = _box_pattern()


def _final_box_pattern() -> str:
    """Some text, a blank line, and a box that closes at the very end."""
    plain, flat2, flat1 = _balanced(0), _balanced(1), _balanced(2)
    shallow = flat1 + r"\}"
    # the first group below level three, anything, and the way back out
    deep = (
        flat1 + r"\{" + flat2 + r"\{" + plain + r"\{"
        r".*\}" + plain + r"\}" + flat2 + r"\}" + flat1 + r"\}"
    )
    return r"(?s)\A.+\n\n\\boxed\{(?:" + shallow + "|" + deep + r")\z"


FINAL_BOX_PATTERN = _final_box_pattern()


def ends_with_box(text: ColumnOrName) -> Column:
    """The text is something, a blank line, and one box up to its very end."""
    text = _c(text)
    return text.endswith("}") & text.rlike(FINAL_BOX_PATTERN)


def boxed_all(text: ColumnOrName) -> Column:
    """Contents of all closed boxes, left to right, not overlapping.

    Nothing behind the last closing brace can be closed, so it is cut off first.
    """
    text = _c(text)
    closable = F.left(text, F.length(text) - F.instr(F.reverse(text), "}") + 1)
    boxes = F.regexp_extract_all(closable, F.lit(r"(?s)" + BOX_PATTERN), 1)
    none = F.array().cast("array<string>")
    return F.when(text.contains("}") & text.contains(K.BOX_OPEN), boxes).when(text.isNotNull(), none)


def boxed_count(text: ColumnOrName) -> Column:
    return F.size(boxed_all(text))


def boxed_final(text: ColumnOrName) -> Column:
    """The last closed box, stripped; NULL if there is none."""
    return strip(F.try_element_at(boxed_all(text), F.lit(-1)))


# ------------------------------------------------------------------ tag bodies
def _after(text: Column, mark: str) -> Column:
    """What follows the first `mark`; NULL without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def tag_body(text: ColumnOrName, tag: str, multiline: bool = False) -> Column:
    """Body of the first ``<tag>...</tag>``, stripped; NULL without a match.

    With ``multiline=False`` the body may not contain a newline: the match is in the
    first line whose opening tag is followed by a closing one.  The text is cut at marks,
    never searched from every opening tag, so it takes time in proportion to its length.
    """
    text, close = _c(text), F.lit(f"</{tag}>")

    def first(part: Column) -> Column:
        rest = _after(part, f"<{tag}>")
        return F.when(F.contains(rest, close), F.substring_index(rest, f"</{tag}>", 1))

    if multiline:
        body = first(text)
    else:
        lines = F.transform(F.split(text, F.lit("\n"), -1), first)
        body = F.get(F.filter(lines, lambda b: b.isNotNull()), F.lit(0))
    return F.when(F.contains(text, close), strip(body))


def answer_tag(text: ColumnOrName) -> Column:
    return tag_body(text, "answer")


def answer_tag_multiline(text: ColumnOrName) -> Column:
    return tag_body(text, "answer", multiline=True)


def tag_bodies(text: ColumnOrName, tag: str) -> Column:
    """Bodies of all ``<tag>...</tag>``, left to right, not overlapping.

    Cut at the closing tags, a body is what follows a piece's first opening tag.
    """
    pieces = F.split(_c(text), F.lit(f"</{tag}>"), -1)
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    bodies = F.transform(closed, lambda p: _after(p, f"<{tag}>"))
    return F.filter(bodies, lambda b: b.isNotNull())


def single_tag_body(text: ColumnOrName, tag: str) -> Column:
    """Body of ``<tag>`` when it occurs exactly once, else NULL (not stripped)."""
    bodies = tag_bodies(text, tag)
    return F.when(F.size(bodies) == 1, F.get(bodies, F.lit(0)))


def think_body(text: ColumnOrName) -> Column:
    return single_tag_body(text, "think")


def desc_body(text: ColumnOrName) -> Column:
    return single_tag_body(text, "desc")


def occurrences(text: ColumnOrName, needle: str) -> Column:
    """How often `needle` occurs, not overlapping."""
    text = _c(text)
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / len(needle)).cast("int")


def occurs_once(text: ColumnOrName, needle: str) -> Column:
    text = _c(text)
    return F.length(F.replace(text, F.lit(needle), F.lit(""))) == (
        F.length(text) - len(needle)
    )


# fixed values: block orders of the two whole-text formats
_THINK_ANSWER_FORMAT = (
    r"(?s)\A<think>\n\n(?>.*?\n\n</think>\n\n<answer>).*</answer>\z"
)
_DESC_THINK_ANSWER_FORMAT = (
    r"(?s)\A<desc>(?>.*?</desc>" + K.WS_BLOCK + r"*+<think>)"
    r"(?>.*?</think>" + K.WS_BLOCK + r"*+<answer>).*</answer>\z"
)


def has_think_answer_format(text: ColumnOrName) -> Column:
    """The whole text is a think block, a blank line and an answer block."""
    text = _c(text)
    return text.startswith(K.THINK_OPEN) & text.rlike(_THINK_ANSWER_FORMAT)


def has_desc_think_answer_format(text: ColumnOrName) -> Column:
    """The whole text is a desc, a think and an answer block, in that order."""
    text = _c(text)
    return text.startswith(K.DESC_OPEN) & text.rlike(_DESC_THINK_ANSWER_FORMAT)


# ------------------------------------------------------------ answer selection
def wrap_math(answer: ColumnOrName) -> Column:
    """Put ``$`` around a nonempty answer unless it both starts and ends with one."""
    a = _c(answer)
    wrapped = a.startswith("$") & a.endswith("$")
    return F.when((a == "") | wrapped, a).otherwise(F.concat(F.lit("$"), a, F.lit("$")))


def wrap_math_unless_dollar(answer: ColumnOrName) -> Column:
    """Put ``$`` around an answer that neither starts nor ends with one."""
    a = _c(answer)
    return F.when(
        ~a.startswith("$") & ~a.endswith("$"), F.concat(F.lit("$"), a, F.lit("$"))
    ).otherwise(a)


def select_answer(resp: ColumnOrName, system_prompt: str) -> Column:
    """The answer a response commits to.

    A prompt that asks for ``<answer>`` tags reads the tag, any other prompt the
    last box.  A found, nonempty answer is wrapped in ``$``; otherwise the whole
    stripped response is the answer.
    """
    resp = _c(resp)
    if K.ANSWER_OPEN in system_prompt:
        found = answer_tag(resp)
    else:
        found = boxed_last(resp)
    # bound (see `equivalence`), as wrapping asks for it several times
    return F.aggregate(
        F.array(), found, lambda x, _: x, lambda x: F.coalesce(wrap_math(null_if_empty(x)), strip(resp))
    )


# ---------------------------------------------------------------- option lists
def _option_marks(kind: str) -> tuple[str, str]:
    # fixed values: how an option starts, for each notation
    return {
        "colon": (r"([A-E]):", r"[A-E]:"),
        "dot": (r"([A-E])\.", r"[A-E]\."),
        "paren": (r"\(([A-E])\)", r"\([A-E]\)"),
    }[kind]


def _option_pairs(text: Column, kind: str, clean) -> Column:
    """array<struct<letter,text>> of every option written in one notation.

    An option ends at the next mark of the same notation or at the line end.
    """
    mark, stop = _option_marks(kind)
    pattern = F.lit(
        r"(?sdm)" + mark + K.WS + r"*+(.*?)(?=" + stop + r"|$)"
    )
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, pattern, 1).alias("letter"),
            F.regexp_extract_all(text, pattern, 2).alias("text"),
        ),
        lambda p: F.struct(p["letter"].alias("letter"), clean(p["text"]).alias("text")),
    )


# found in every question with an option of any notation, and in few others
OPTION_MARK = r"[A-E][:.)]"
OPTIONS_TYPE = "array<struct<letter:string,text:string>>"


def options_from_question(question: ColumnOrName, dataset: ColumnOrName) -> Column:
    """Options found in a question text, in order of appearance.

    The notation depends on the data set; for other data sets the first notation
    that gives at least two options is used.  A letter may occur more than once;
    `option_text` and `option_list` let the last one win.
    """
    q, d = _c(question), _c(dataset)
    colon, dot, paren = (_option_pairs(q, k, strip) for k in ("colon", "dot", "paren"))
    none = F.array().cast(OPTIONS_TYPE)
    return (
        F.when(~q.rlike(OPTION_MARK), none)
        .when(d == K.WE_MATH, _option_pairs(q, "dot", clean_option))
        .when(d == K.MATHVERSE, _option_pairs(q, "colon", clean_option))
        .when(F.size(colon) >= 2, colon)
        .when(F.size(dot) >= 2, dot)
        .when(F.size(paren) >= 2, paren)
        .otherwise(none)
    )


def options_until_semicolon(text: ColumnOrName, dataset: str) -> Column:
    """Options that end at ``;`` or at the end of the text, on one line.

    Defined for the two data sets that use this notation; an option whose text
    runs into a newline is not an option.
    """
    kinds = {K.WE_MATH: "dot", K.MATHVERSE: "colon"}
    if dataset not in kinds:
        raise ValueError(f"no option notation for data set {dataset!r}")
    mark, _ = _option_marks(kinds[dataset])
    # `$` without MULTILINE: the very end, or before a newline at the very end
    pattern = F.lit(r"(?d)" + mark + K.WS + r"*(.*?)(?=;|\n?\z)")
    text = _c(text)
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, pattern, 1).alias("letter"),
            F.regexp_extract_all(text, pattern, 2).alias("text"),
        ),
        lambda p: F.struct(p["letter"].alias("letter"), strip(p["text"]).alias("text")),
    )


def option_text(options: ColumnOrName, letter: Column | str) -> Column:
    """Text of one option; the last one wins if the letter is repeated."""
    letter = letter if isinstance(letter, Column) else F.lit(letter)
    hits = F.filter(_c(options), lambda o: o["letter"] == letter)
    return F.try_element_at(hits, F.lit(-1))["text"]


def option_list(options: ColumnOrName) -> Column:
    """Option texts in letter order, one per letter that occurs.

    A missing letter leaves no gap, so later options move up by one place.
    """
    options = _c(options)
    letters = F.array_sort(F.array_distinct(F.transform(options, lambda o: o["letter"])))
    return F.transform(letters, lambda l: option_text(options, l))


def letter_at(index: Column) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.char(index + 65)


# ------------------------------------------------------------------ image keys
def base_name(path: ColumnOrName) -> Column:
    return F.substring_index(_c(path), "/", -1)


def image_number(path: ColumnOrName) -> Column:
    """N of a file called ``image<N>.<extension>``; NULL for any other name."""
    digits = F.regexp_extract(base_name(path), r"\Aimage([0-9]+)\.[^.]*\z", 1)
    return null_if_empty(digits).try_cast("bigint")


def image_folder_key(path: ColumnOrName) -> Column:
    """The last two path segments, or the path itself if it has fewer."""
    return F.substring_index(_c(path), "/", -2)


def file_stem(path: ColumnOrName) -> Column:
    """File name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def file_extension(path: ColumnOrName) -> Column:
    return F.substring_index(_c(path), ".", -1)


# --------------------------------------------------------------- data set names
def dataset_from_file(file_name: ColumnOrName) -> Column:
    """Data set a result file belongs to, by its name (case-insensitive)."""
    f = F.lower(_c(file_name))
    # fixed values: name parts in the order in which they are looked for
    return (
        F.when(f.contains("mathverse"), K.MATHVERSE)
        .when(f.contains("we-math") | f.contains("wemath"), K.WE_MATH)
        .when(f.contains("mathvista"), K.MATHVISTA)
        .when(f.contains("dynamath"), K.DYNAMATH)
        .otherwise(K.UNKNOWN)
    )


def is_trial_file(file_name: ColumnOrName) -> Column:
    """Files judged by repeated trials; case-sensitive, unlike `dataset_from_file`."""
    return _c(file_name).contains(K.DYNAMATH)


def is_skipped_file(file_name: ColumnOrName) -> Column:
    f = _c(file_name)
    first, second = K.SKIPPED_FILE_MARKS
    return f.contains(first) | f.contains(second)


def result_file_name(file_name: ColumnOrName, matched: bool) -> Column:
    prefix = "filtered_match_" if matched else "filtered_mismatch_"
    return F.concat(F.lit(prefix), _c(file_name))


def model_folder(path: ColumnOrName) -> Column:
    """The last three segments of a model path, or the path if it has fewer."""
    parts = F.split(_c(path), "/")
    return F.when(
        F.size(parts) >= 3, F.array_join(F.slice(parts, -3, 3), "/")
    ).otherwise(_c(path))


# ------------------------------------------------------------ prompts and misc
def salvage_text(partial: ColumnOrName) -> Column:
    """A cut-off thought, closed and followed by the request for the answer."""
    return F.concat(_c(partial), F.lit(K.THINK_CLOSE + K.SALVAGE_CUE))


def salvage_prompt(prompt: ColumnOrName, partial: ColumnOrName) -> Column:
    return F.concat(_c(prompt), salvage_text(partial))


def is_truncated_thought(resp: ColumnOrName, finish_reason: ColumnOrName) -> Column:
    """Generation stopped by the length limit inside an open ``<think>``."""
    resp = _c(resp)
    return (
        (_c(finish_reason) == "length")
        & resp.contains(K.THINK_OPEN)
        & ~resp.contains(K.THINK_CLOSE)
    )


def without_image_token(question: ColumnOrName) -> Column:
    return F.replace(_c(question), F.lit(K.IMAGE_TOKEN), F.lit(""))


def caption_judge_prompt(caption: ColumnOrName, question: ColumnOrName) -> Column:
    return F.concat(
        F.lit(K.CAPTION_JUDGE_HEAD),
        _c(caption),
        F.lit(K.CAPTION_JUDGE_QUESTION),
        _c(question),
        F.lit(K.CAPTION_JUDGE_TAIL),
    )


def thinking_judge_prompt(question: ColumnOrName, reasoning: ColumnOrName) -> Column:
    return F.concat(
        F.lit(K.THINKING_JUDGE_QUESTION),
        without_image_token(question),
        F.lit(K.THINKING_JUDGE_REASONING),
        _c(reasoning),
    )


def token_count(text: ColumnOrName) -> Column:
    """Words and single punctuation marks; callers may pass model token counts instead."""
    return F.regexp_count(_c(text), F.lit(r"\w+|[^\w\s]"))


def _power_of_two(n: Column) -> Column:
    # by way of bigint: a double turns into a decimal by its shortest printed form
    return F.pow(F.lit(2.0), n).cast("bigint").cast("decimal(19,0)")


def fixed_decimals(x: ColumnOrName, digits: int) -> Column:
    """A double with up to eight decimals, rounded as C and Python round it.

    The exact binary value is rounded, ties to even; Java's formatter rounds the
    printed value half up instead (15.625 -> 15.63, 2.675 -> 2.68).  The value is an
    integer over a power of two, so the rounding is done in whole decimals.
    """
    if not 0 <= digits <= 8:
        raise ValueError("0 to 8 decimals")
    x = _c(x).cast("double")
    size = F.abs(x)
    # size = mantissa / 2**shift, exactly; below 2**-30 the decimals are zero anyway
    shift = F.lit(53) - F.greatest(F.floor(F.log2(size)), F.lit(-30)).cast("int")
    mantissa = F.floor(size * F.pow(F.lit(2.0), shift))
    whole = "decimal(38,0)"
    scaled = (mantissa.cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(10,0)")).cast(whole)
    high = F.greatest(shift - 31, F.lit(0))
    unit = (_power_of_two(high) * _power_of_two(shift - high)).cast(whole)
    rest = F.pmod(scaled, unit)
    down = ((scaled - rest) / unit).cast("decimal(28,0)")
    twice = rest * F.lit(2).cast("decimal(1,0)")
    odd = F.pmod(down, F.lit(2).cast("decimal(1,0)")) == 1
    rounded = down + F.when((twice > unit) | ((twice == unit) & odd), 1).otherwise(0).cast("decimal(1,0)")
    exact = (rounded / F.lit(10**digits).cast("decimal(10,0)")).cast(f"decimal(28,{digits})")
    text = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), exact.cast("string"))
    # from 2**53 on all doubles are whole numbers; zero has no logarithm
    zeros = "." + "0" * digits if digits else ""
    whole_text = F.concat(x.cast("bigint").cast("string"), F.lit(zeros))
    return (
        F.when((size > 0) & (size < 2.0**53), text)
        .when((size >= 2.0**53) & (size < 2.0**63), whole_text)
        .otherwise(F.format_string(f"%.{digits}f", x))
    )


def percent_text(x: ColumnOrName, digits: int = 2) -> Column:
    return F.concat(fixed_decimals(_c(x) * 100, digits), F.lit("%"))
