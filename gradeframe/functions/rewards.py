"""Per-row reward columns, by name.

A reward is a function from `Features` to a double column.  `Features` names the
values extracted from a completion and its label; `score` works out which of them
the chosen rewards need, adds each once, and scores everything in one projection:
no shuffle, no Python, and the same code on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed as K, text as T
from .equivalence import (
    EqualFn,
    answers_equal,
    final_answer,
    label_is_readable,
    parse_answer,
    same_text,
)
from .pairs import joined_by_distinct

_P = "__rw_"

# Features by stage.  Each entry: names it reads, builder from a column lookup.
_EXTRACTED = {
    "boxes": ((), lambda f: T.boxed_all(f("completion"))),
    "last_box": ((), lambda f: T.boxed_last(f("completion"))),
    "tag": ((), lambda f: T.answer_tag(f("completion"))),
    "tag_any_line": ((), lambda f: T.answer_tag_multiline(f("completion"))),
    "desc": ((), lambda f: T.desc_body(f("completion"))),
    "think": ((), lambda f: T.think_body(f("completion"))),
    "judged_thinking": ((), lambda f: T.boxed_all(f("thinking_response"))),
    "judged_caption": ((), lambda f: T.boxed_all(f("caption_response"))),
    "label": ((), lambda f: f("solution")),
    "label_tag": (
        (),
        lambda f: F.coalesce(T.answer_tag(f("solution")), T.strip(f("solution"))),
    ),
}
_SELECTED = {
    "whole": (("last_box",), lambda f: final_answer(f("completion"), f("last_box"))),
    "final_box": (("boxes",), lambda f: T.strip(F.try_element_at(f("boxes"), F.lit(-1)))),
    "box_or_text": (
        ("last_box",),
        lambda f: T.strip(F.coalesce(T.null_if_empty(f("last_box")), f("completion"))),
    ),
    "tag_or_text": (
        ("tag",),
        lambda f: F.coalesce(f("tag"), T.strip(f("completion"))),
    ),
    "caption": (("desc",), lambda f: final_answer(f("desc"))),
    "verdict": (
        ("judged_thinking",),
        lambda f: F.try_element_at(f("judged_thinking"), F.lit(-1)),
    ),
    "caption_answer": (
        ("judged_caption",),
        lambda f: F.try_element_at(f("judged_caption"), F.lit(-1)),
    ),
}


@dataclass
class Features:
    """What a reward may read; records what it asked for."""

    inputs: dict[str, Column]
    equal_fn: EqualFn | None = None
    count_tokens: Callable[[Column], Column] = T.token_count
    asked: set[str] = field(default_factory=set)
    compared: set[str] = field(default_factory=set)
    pairs: set[tuple[str, str]] = field(default_factory=set)

    def __call__(self, name: str) -> Column:
        """An input column, or a feature by name."""
        if name in self.inputs:
            return self.inputs[name]
        if name not in _EXTRACTED and name not in _SELECTED:
            raise KeyError(f"unknown feature or missing input column: {name}")
        self.asked.add(name)
        return F.col(_P + name)

    def equal(self, a: str, b: str = "label") -> Column:
        """Do two features give the same answer?  Never NULL."""
        if self.equal_fn is not None:
            return F.coalesce(self.equal_fn(self(a), self(b)), F.lit(False))
        self.parsed(a), self.parsed(b)
        self.pairs.add((a, b))
        return F.col(f"{_P}{a}_is_{b}")

    def _verdicts(self, df: DataFrame, given: bool) -> DataFrame:
        """A column for each pair compared, however many rewards ask for it."""
        pairs = sorted(p for p in self.pairs if bool(set(p) & set(self.inputs)) == given)
        verdict = lambda a, b: answers_equal(F.col(f"{_P}{a}_parsed"), F.col(f"{_P}{b}_parsed"))
        return df.withColumns({f"{_P}{a}_is_{b}": verdict(a, b) for a, b in pairs}) if pairs else df

    def parsed(self, name: str) -> Column:
        """A feature as read for comparison: struct<canon, letter, num>."""
        if name not in self.inputs:
            self.asked.add(name)
        self.compared.add(name)
        return F.col(f"{_P}{name}_parsed")

    def readable_label(self) -> Column:
        return label_is_readable(self.parsed("label")["canon"])

    def tokens(self) -> Column:
        """Token count of the completion: the given column, or a word count."""
        if "tokens" in self.inputs:
            return self.inputs["tokens"]
        return self.count_tokens(self("completion"))

    def add_to(self, df: DataFrame, by_pair: bool = False) -> DataFrame:
        """Add every feature that was asked for."""
        needed = set(self.asked)
        for name in self.asked & set(_SELECTED):
            needed |= set(_SELECTED[name][0])
        for stage in (_EXTRACTED, _SELECTED):
            cols = {_P + n: stage[n][1](self) for n in stage if n in needed}
            df = df.withColumns(cols) if cols else df
        own = sorted(self.compared - set(self.inputs))
        if not own:
            return self._verdicts(df, given=False)

        def read(texts: DataFrame) -> DataFrame:
            return self._verdicts(texts.withColumns({f"{_P}{n}_parsed": parse_answer(_P + n) for n in own}), given=False)

        return joined_by_distinct(df, [_P + n for n in own], read) if by_pair else read(df)

    def add_joined(self, df: DataFrame) -> DataFrame:
        """Read the answers that came with the judges' columns."""
        given = sorted(self.compared & set(self.inputs))
        df = df.withColumns({f"{_P}{n}_parsed": parse_answer(self.inputs[n]) for n in given}) if given else df
        return self._verdicts(df, given=True)


Reward = Callable[..., Column]
REWARDS: dict[str, Reward] = {}


def register_reward(name: str, reward: Reward | None = None):
    """Add a reward under a name; also usable as a decorator."""
    if reward is None:
        return lambda fn: register_reward(name, fn)
    REWARDS[name] = reward
    return reward


def _points(condition: Column, points: float = 1.0) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ answer rewards
@register_reward("external_math_acc")
def math_accuracy(f: Features) -> Column:
    """1 if the completion's final answer equals the label, or the label is unreadable."""
    return _points(~f.readable_label() | f.equal("whole"))


@register_reward("external_r1v_acc")
def tagged_or_exact(f: Features) -> Column:
    """1 if equal as answers, or if the tagged (else whole, stripped) texts are the same."""
    return _points(
        f.equal("whole", "label_tag") | same_text(f("tag_or_text"), f("label_tag"))
    )


@register_reward("external_compare_acc")
def boxed_accuracy(f: Features) -> Column:
    """1 if the last closed box equals the label."""
    return _points(f.equal("final_box"))


@register_reward("external_answer_tag_acc")
def answer_tag_accuracy(f: Features) -> Column:
    """1 if the answer tag, or without one the whole text, equals the label."""
    return _points(f.equal("tag_or_text"))


@register_reward("external_answer_tag_acc_gauss")
def boxed_gauss(f: Features, sigma: float = 1.0, strict_reference: bool = False) -> Column:
    """1 if equal, else a Gaussian of the numeric distance, else 0."""
    exact = f.equal("box_or_text")
    if strict_reference:
        return _points(exact)
    gap = f.parsed("box_or_text")["num"] - f.parsed("label")["num"]
    near = F.exp(-(gap * gap) / F.lit(2 * sigma**2 + 1e-9))
    return F.when(exact, F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0)))


@register_reward("external_answer_tag_length_acc")
def answer_tag_length(f: Features, max_length: int = K.LENGTH_REWARD_TOKENS) -> Column:
    """Answer-tag accuracy, scaled down for completions below `max_length` tokens."""
    share = F.least(F.lit(1.0), f.tokens().cast("double") / max_length)
    return F.when(f.equal("tag_or_text"), share).otherwise(F.lit(0.0))


@register_reward("external_boxed_verify")
def boxed_verify(f: Features) -> Column:
    """Half a point each for the whole text and for the last closed box."""
    whole = f.equal("whole") | same_text(f("completion"), f("solution"))
    boxed = f.equal("final_box") | same_text(f("final_box"), f("solution"))
    return _points(whole, 0.5) + _points(boxed, 0.5)


@register_reward("external_acc_format")
def accuracy_or_format(f: Features) -> Column:
    """1 if equal; else 0 if the text ends with a box after a blank line; else -1."""
    return (
        F.when(f.equal("whole"), 1.0)
        .when(T.ends_with_box(f("completion")), 0.0)
        .otherwise(-1.0)
    )


# ------------------------------------------------------------------ format rewards
def _tag_points(f: Features, points: float) -> Column:
    tags = (K.THINK_OPEN, K.THINK_CLOSE, K.ANSWER_OPEN, K.ANSWER_CLOSE)
    text = f("completion")
    return sum((_points(T.occurs_once(text, t), points) for t in tags[1:]),
               _points(T.occurs_once(text, tags[0]), points))


@register_reward("external_math_format")
def think_answer_format(f: Features) -> Column:
    """An eighth per tag seen exactly once, and half for the whole format."""
    return _tag_points(f, 0.125) + _points(T.has_think_answer_format(f("completion")), 0.5)


@register_reward("external_tag_count")
def tag_count(f: Features) -> Column:
    """A quarter per tag seen exactly once."""
    return _tag_points(f, 0.25)


@register_reward("external_answer_format")
def desc_think_answer_format(f: Features) -> Column:
    return _points(T.has_desc_think_answer_format(f("completion")))


@register_reward("external_boxed_format")
def any_box(f: Features) -> Column:
    return _points(F.size(f("boxes")) > 0)


@register_reward("external_boxed_count")
def one_box(f: Features) -> Column:
    return _points(F.size(f("boxes")) == 1)


@register_reward("external_boxed_pos")
def box_position(f: Features) -> Column:
    """How far into the text the first box mark ends, as a share of its length."""
    text = f("completion")
    size, start = F.length(text), F.instr(text, K.BOX_WORD)
    after = (size - start + 1 - len(K.BOX_WORD)).cast("double")
    return F.when(start > 0, 1 - after / size).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ length rewards
@register_reward("soft_overlong")
def soft_overlong(f: Features, soft_max_length: int, soft_cache_length: int) -> Column:
    """0 up to the expected length, then linearly down to -1 at the maximum and below."""
    if not soft_cache_length < soft_max_length:
        raise ValueError("soft_cache_length must be smaller than soft_max_length")
    over = f.tokens().cast("double") - (soft_max_length - soft_cache_length)
    return F.least(-over / soft_cache_length, F.lit(0.0))


@register_reward("external_cap_length")
def thinks_longer_than_describes(f: Features) -> Column:
    """1 if there is one desc and one think block and the thinking has more tokens."""
    longer = f.count_tokens(f("think")) > f.count_tokens(f("desc"))
    return _points(F.coalesce(longer, F.lit(False)))


# ----------------------------------------------------------------- caption and judge
@register_reward("external_cap_check")
def caption_does_not_leak(f: Features) -> Column:
    """1 if the only desc block does not give the answer away; 0 without one."""
    return _points(f("desc").isNotNull() & ~f.equal("caption"))


@register_reward("external_cap_verify")
def caption_verified(f: Features) -> Column:
    """1 if the judge, reading the completion only, boxed the label."""
    return _points(f.equal("caption_answer"))


@register_reward("external_thinking_verify")
def thinking_verified(f: Features, strict_reference: bool = False) -> Column:
    """1 if the judge's boxed verdict on the only think block is 1.

    With ``strict_reference`` the verdict is compared with the label instead.
    """
    if strict_reference:
        good = f.equal("verdict")
    else:
        good = F.coalesce(T.strip(f("verdict")) == "1", F.lit(False))
    return _points(f("think").isNotNull() & good)


@register_reward("external_mm")
def multimodal(f: Features) -> Column:
    """Tagged accuracy; if right, plus the two caption rewards."""
    right = f.equal("tag_any_line")
    bonus = caption_does_not_leak(f) + caption_verified(f)
    return F.when(right, 1.0 + bonus).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------- scoring
def score(
    df: DataFrame,
    names: Iterable[str],
    completion: str = "completion",
    solution: str = "solution",
    tokens: str | None = None,
    thinking_response: str | None = None,
    caption_response: str | None = None,
    thinking_verdict: str | None = None,
    caption_answer: str | None = None,
    join: Callable[[DataFrame], DataFrame] | None = None,
    equal: EqualFn | None = None,
    count_tokens: Callable[[Column], Column] | None = None,
    params: dict[str, dict] | None = None,
    by_pair: bool = False,
) -> DataFrame:
    """Add one double column per reward name.

    `tokens` names an integer column with the completion's token count;
    `thinking_response` and `caption_response` name judge texts joined beforehand,
    `thinking_verdict` and `caption_answer` what these had in their last boxes; the latter
    may be columns that `join` adds, which runs when the features of df are in place;
    `equal` replaces answer equivalence; `params` gives keyword arguments per reward;
    `by_pair` reads and compares every distinct combination of answers once, for tables that
    hold the same answers many times: not on a stream, as it reads df twice.
    """
    names = list(names)
    unknown = [n for n in names if n not in REWARDS]
    if unknown:
        raise KeyError(f"no reward named {unknown}; known: {sorted(REWARDS)}")
    given = {
        "completion": completion,
        "solution": solution,
        "tokens": tokens,
        "thinking_response": thinking_response,
        "caption_response": caption_response,
        "verdict": thinking_verdict,
        "caption_answer": caption_answer,
    }
    features = Features({k: F.col(v) for k, v in given.items() if v}, equal)
    if count_tokens is not None:
        features.count_tokens = count_tokens
    params = params or {}
    columns = {n: REWARDS[n](features, **params.get(n, {})) for n in names}
    out = features.add_to(df, by_pair)
    out = features.add_joined(join(out) if join else out)
    return out.select(
        *(F.col(f"`{c}`") for c in df.columns if c not in columns),
        *(columns[n].cast("double").alias(n) for n in names),
    )
