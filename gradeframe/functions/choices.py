"""Multiple-choice answers: letters, positions and option texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed as K
from .equivalence import EqualFn, _bind, equivalent_or_same, undecided
from .text import (
    OPTION_MARK,
    OPTIONS_TYPE,
    ColumnOrName,
    _c,
    letter_at,
    option_list,
    option_text,
    options_from_question,
    strip,
)


def bare_letter(value: ColumnOrName) -> Column:
    """Upper-case letter A-F of a value that is one letter, else NULL."""
    v = F.upper(_c(value))
    return F.when(v.isin(*K.CHOICE_LETTERS), v)


def named_letter(value: ColumnOrName) -> Column:
    """Like `bare_letter`, also for ``$X$``."""
    v = _c(value)
    inner = F.when(
        (F.length(v) == 3) & v.startswith("$") & v.endswith("$"), F.substring(v, 2, 1)
    ).otherwise(v)
    return bare_letter(inner)


def choice_info(value: ColumnOrName, choices: ColumnOrName, options: ColumnOrName) -> Column:
    """struct<letter,index,text> of a stripped value among the options.

    A letter names the option at its place; a text that equals an option takes that
    option's place; anything else has index -1 and stands for itself.
    """
    v, choices = _c(value), _c(choices)

    def info(x: Column) -> Column:
        letter, place = x["letter"], x["place"]
        index = F.ascii(letter) - 65
        by_letter = F.struct(
            letter.alias("letter"),
            index.alias("index"),
            F.when(index < F.size(choices), F.get(choices, index))
            .otherwise(F.coalesce(option_text(options, letter), letter))
            .alias("text"),
        )
        by_text = F.struct(
            F.when(place < len(K.CHOICE_LETTERS), letter_at(place))
            .otherwise(place.cast("string"))
            .alias("letter"),
            place.alias("index"),
            v.alias("text"),
        )
        other = F.struct(v.alias("letter"), F.lit(-1).alias("index"), v.alias("text"))
        return F.when(letter.isNotNull(), by_letter).when(place >= 0, by_text).otherwise(other)

    place = (F.array_position(choices, v) - 1).cast("int")
    return _bind(F.struct(named_letter(v).alias("letter"), place.alias("place")), info)


def choice_match(
    answer: ColumnOrName,
    model_answer: ColumnOrName,
    choices: ColumnOrName | None = None,
    question: ColumnOrName | None = None,
    dataset: ColumnOrName = "dataset",
    equal: EqualFn | None = None,
) -> Column:
    """struct<normalized_answer, normalized_parsed_answer, is_match>.

    Options come from `choices` or, where it is empty, from the question text.  Two
    single letters are compared as letters, two known options by place, everything else
    as text or by `equal` (default: answer equivalence).
    """
    no_choices = F.array().cast("array<string>")
    no_options = F.array().cast(OPTIONS_TYPE)
    given = F.coalesce(_c(choices), no_choices) if choices is not None else no_choices
    if question is not None:
        found = options_from_question(F.coalesce(_c(question), F.lit("")), dataset)
        options = F.when(F.size(given) == 0, found).otherwise(no_options)
    else:
        options = no_options

    def place(x: Column) -> Column:
        listed = F.when(F.size(x["options"]) > 0, option_list(x["options"])).otherwise(x["given"])
        return _bind(
            F.struct(
                x["a"].alias("a"), x["m"].alias("m"), x["options"].alias("options"),
                listed.alias("choices"),
            ),
            lambda y: _bind(
                F.struct(
                    y["a"].alias("a"),
                    y["m"].alias("m"),
                    choice_info(y["a"], y["choices"], y["options"]).alias("ai"),
                    choice_info(y["m"], y["choices"], y["options"]).alias("mi"),
                ),
                compare,
            ),
        )

    def compare(x: Column) -> Column:
        ai, mi = x["ai"], x["mi"]
        letters = bare_letter(x["a"]).isNotNull() & bare_letter(x["m"]).isNotNull()
        places = (ai["index"] >= 0) & (mi["index"] >= 0)
        by_option = letters | places
        return F.struct(
            F.when(by_option, ai["letter"]).otherwise(ai["text"]).alias("normalized_answer"),
            F.when(by_option, mi["letter"]).otherwise(mi["text"]).alias("normalized_parsed_answer"),
            F.when(letters, F.upper(x["a"]) == F.upper(x["m"]))
            .when(places, ai["index"] == mi["index"])
            .otherwise(equivalent_or_same(ai["text"], mi["text"], equal))
            .alias("is_match"),
        )

    a, m = strip(answer), strip(model_answer)
    match = _bind(
        F.struct(a.alias("a"), m.alias("m"), given.alias("given"), options.alias("options")),
        place,
    )
    if equal is not undecided:
        return match
    # without options and letters both answers stand for themselves, which is soon told
    unmarked = F.lit(True) if question is None else ~F.coalesce(_c(question), F.lit("")).rlike(OPTION_MARK)
    plain = unmarked & (F.size(given) == 0) & named_letter(a).isNull() & named_letter(m).isNull()
    return F.when(
        plain,
        F.struct(
            a.alias("normalized_answer"),
            m.alias("normalized_parsed_answer"),
            equivalent_or_same(a, m, equal).alias("is_match"),
        ),
    ).otherwise(match)


def with_choice_match(
    df: DataFrame,
    answer: str = "answer",
    model_answer: str = "parsed_answer",
    choices: str | None = "choices",
    question: str | None = "question",
    dataset: ColumnOrName = "dataset",
    equal: EqualFn | None = None,
) -> DataFrame:
    """Add the three fields of `choice_match` as columns."""
    fields = ("normalized_answer", "normalized_parsed_answer", "is_match")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in fields]
    match = choice_match(answer, model_answer, choices, question, dataset, equal)
    return df.withColumn("__match", match).select(*keep, *(f"__match.{f}" for f in fields))
