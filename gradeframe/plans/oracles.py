"""DuckDB SQL for the registered queries.

Written on its own terms: boxes are found by splitting and counting braces, options by
putting each mark on a line of its own, row numbers by a window.
"""

from __future__ import annotations

import math

from ..functions import fixed as K
from .derived import DATASETS

BS, NL = "chr(92)", "chr(10)"


def q(text: str) -> str:
    """A text as an SQL expression."""
    parts = []
    for i, line in enumerate(text.split("\n")):
        if i:
            parts.append(NL)
        if line:
            parts.append("'" + line.replace("'", "''") + "'")
    return "(" + " || ".join(parts or ["''"]) + ")"


BOX = q(K.BOX_OPEN)
SPACES = " || ".join(f"chr({ord(c)})" for c in K.PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


# ------------------------------------------------------------------ derived tables
_DS = "case {x} % 6 " + " ".join(
    f"when {i} then '{d}'" for i, d in enumerate(DATASETS)
) + " end"

RESPONSES = f"""b as (
  select o_orderkey as image_key, t.trial as trial, o_orderkey*10 + t.trial as sid,
         cast(floor(o_totalprice) as bigint) % 50 + 1 as a,
         case when o_orderkey % 4 = 0 then 4 else (o_orderkey*10 + t.trial) % 9 end as k
  from orders, (select unnest(range(10)) as trial) t
  where (o_orderkey*10 + t.trial) % 37 <> 0),
v as (select *, cast(a as varchar) as s, cast(a+1 as varchar) as w, {BS} as bs, {NL} as nl from b),
r as (
select cast(sid as bigint) as sid, cast(image_key as bigint) as image_key, cast(trial as int) as trial,
  cast(row_number() over (order by sid) - 1 as bigint) as ord,
  'samples/image/image' || cast(image_key as varchar) || '.png' as image,
  s as answer, case when k = 3 then 'length' else 'stop' end as finish_reason,
  case k
   when 0 then '<think>r</think><answer>' || s || '</answer>'
   when 1 then '<think>r</think>' || nl || nl || bs || 'boxed{{' || s || '}}'
   when 2 then 'so ' || bs || 'boxed{{' || bs || 'frac{{' || cast(a*2 as varchar) || '}}{{2}}}}'
   when 3 then '<think>first ' || s || ' then'
   when 4 then bs || 'boxed{{' || w || '}} no, ' || bs || 'boxed{{' || s || '}}'
   when 5 then bs || 'boxed{{' || s || '}} and ' || bs || 'boxed{{' || bs || 'frac{{1}}{{2}}'
   when 6 then '<think>' || nl || nl || 'r' || nl || nl || '</think>' || nl || nl || '<answer>' || w || '</answer>'
   when 7 then s
   else '<desc>d' || nl || '</desc><think>long r</think><answer> ' || s || '.0 </answer>' end as resp,
  {_DS.format(x="image_key")} as dataset,
  '<image>What is value ' || cast(image_key as varchar) || '?' as question
from v)"""

# judge texts beside the responses, so that nothing joins the responses with themselves
def _said(shift: int) -> str:
    return f"""case when sid % 7 <> 0 then case (sid + {shift}) % 5
   when 0 then 'I cannot tell.'
   when 1 then 'Fine. ' || {BOX} || answer || '}}'
   when 2 then 'Sound, ' || {BOX} || '1}}'
   when 3 then 'No ' || {BOX} || '1}}, rather ' || {BOX} || '0}}'
   else 'It is ' || {BOX} || {BS} || 'text{{' || answer || '}}}}' end end"""


FILES = f"""f as (
select sid, case when image_key % 3 = 0 then 'DynaMath.jsonl' else
   case image_key % 5 + 1 when 1 then 'MathVista_x.jsonl' when 2 then 'mathverse-7.jsonl'
    when 3 then 'We-Math.jsonl' when 4 then 'filtered_match_a.jsonl' else 'other.jsonl' end end as file,
  image, image_key, case when sid % 13 <> 0 then question end as question, answer,
  case when sid % 11 = 5 then null
   when image_key % 6 = 0 then '$' || answer || '$'
   when sid % 3 = 0 then answer || '.0'
   when sid % 3 = 1 then {BOX} || answer || '}}'
   else answer end as parsed_answer,
  case when sid % 17 = 3 then null else (image_key % 4 = 0) or (sid % 2 = 0) end as verify
from r)"""

ITEMS = f"""i as (
select p_partkey as item_id, {_DS.format(x="p_partkey")} as dataset,
  'Which fits item ' || cast(p_partkey as varchar) || '?' as question,
  'Eval: which fits item ' || cast(p_partkey as varchar) || '?' as question_for_eval,
  case p_partkey % 4 when 0 then cast([] as varchar[]) when 1 then ['A','B','C','D','E']
   else [p_name, p_brand, p_type, cast(p_size as varchar), cast(p_size + 100 as varchar)] end as options,
  case p_partkey % 5 when 0 then null when 1 then [p_name, p_type]
   else [p_name, p_brand, p_type, cast(p_size as varchar)] end as choices,
  'A. ' || p_name || '; B. ' || p_type || '; C. size  ' || cast(p_size as varchar) as option,
  'images/p' || cast(p_partkey as varchar) || '.jpg' as image,
  'dir/p' || cast(p_partkey as varchar) || '.png' as image_path,
  'logic_' || cast(p_partkey as varchar) || '.png' as imagename
from part)"""

COMPETITION = """o as (
select p_partkey as item_id,
  case when p_partkey % 2 = 0 then 'OE_TO_maths_en' else 'OE_MM_maths_en' end as tag,
  case when p_partkey % 3 = 0 then 'Given ' || p_name || '.' end as context,
  case p_partkey % 4 when 1 then 'See <img_' || cast(p_partkey as varchar) || '> and <img_7>.'
   when 3 then '<img_' || cast(p_partkey as varchar) || '>'
   else 'How big is ' || p_type || '?' end as question
from part)"""

CHOICES = f"""c as (
select p_partkey as item_id,
  case p_partkey % 5 when 0 then 'We-Math' when 1 then 'MathVerse' else 'Unknown' end as dataset,
  case p_partkey % 5
   when 0 then 'Pick one.' || {NL} || 'A. ' || p_name || {NL} || 'B. ' || p_type || '  x ' || {NL} || 'C. ' || p_size
   when 1 then 'Choices:' || {NL} || 'A:' || p_name || {NL} || 'B:' || p_type || {NL} || 'C: ' || p_size
   when 2 then 'Pick (A) ' || p_name || ' (C) ' || p_type || ' (D) ' || p_size
   when 3 then 'How many? A: ' || p_name || ' B: ' || p_type || ' A: ' || p_size
   else 'How many of ' || p_name || '?' end as question,
  case when p_partkey % 7 = 0 then [cast(p_size as varchar), p_name, p_type] end as choices,
  case p_partkey % 4 when 0 then 'A' when 1 then p_name when 2 then ' b ' else cast(p_size as varchar) end as answer,
  case p_partkey % 6 when 0 then 'a' when 1 then '$A$' when 2 then p_type when 3 then p_size || '.0'
   when 4 then {BS} || 'text{{' || p_name || '}}' else 'B' end as parsed_answer
from part)"""

_PAIR_FORMS = [
    ("s || '.0'", "s"),
    (f"'$' || {BS} || 'frac{{' || (n*2) || '}}{{2}}$'", "s"),
    (f"{BS} || 'dfrac{{' || s || '}}{{4}}'", "s || '/4'"),
    (f"s || {BS} || '%'", "cast(n / 100.0::double as varchar)"),
    (f"'2' || {BS} || 'sqrt{{' || s || '}}'", f"{BS} || 'sqrt{{' || (n*4) || '}}'"),
    ("'x = ' || s", "s"),
    ("'(' || s || ', 2.0)'", f"{BS} || 'left( ' || s || ',2 ' || {BS} || 'right)'"),
    (f"{BS} || '{{2,' || s || {BS} || '}}'", f"{BS} || '{{' || s || ', 2' || {BS} || '}}'"),
    ("'1,0' || lpad(s, 2, '0')", "'10' || lpad(s, 2, '0')"),
    (f"s || {BS} || 'text{{ cm}}'", "s"),
    (f"s || '^' || {BS} || 'circ'", "s || '.'"),
    ("l_returnflag", "'(' || l_returnflag || ')'"),
    (f"{BS} || 'text{{red ' || s || '}}'", "'red  ' || s"),
    ("'2^{{' || (n % 11) || '}}'", "cast(cast(pow(2, n % 11) as bigint) as varchar)"),
    (f"{BS} || 'frac{{' || s || {BS} || 'pi}}{{2}}'", f"s || {BS} || 'pi/2'"),
    (f"'1' || {BS} || 'frac{{' || s || '}}{{100}}'", "(n + 100) || '/100'"),
    ("s", "cast(n + 1 as varchar)"),
    ("'x + ' || s", "'x+' || s"),
    ("'-' || s", "s"),
    ("''", "''"),
    (f"'$' || {BOX} || s || '}}$'", "s"),
    (f"{BOX} || (n + 1) || '}} no, ' || {BOX} || s || '}}'", "s"),
    ("'**' || s || '**'", "s"),
    ("'$' || s", "s"),
    ("s || ' cm'", "s"),
    ("'1/2,' || s", "'0.5,' || s"),
    ("'Tom, Bob'", "'Bob, Tom'"),
    ("'0.0000001' || s", "'0.0000002' || s"),
]
_EXPRESSION_FORMS = [
    ("'x+' || s", "s || '+x'"),
    ("'(x+' || s || ')^2'", "'x^2+' || (n*2) || 'x+' || (n*n)"),
    (f"{BS} || 'frac{{x}}{{2}}+' || s", "'0.5x+' || s"),
    ("'(x+' || s || ')(x-' || s || ')'", "'x^2-' || (n*n)"),
    ("'x^2+' || s", "'x^2+' || (n+1)"),
    (f"{BS} || 'frac{{1}}{{x+' || s || '}}'", "'(' || s || '+x)^{{-1}}'"),
    ("'2x+' || s", "'2x-' || s"),
    ("'y=' || s || 'x'", f"'x ' || {BS} || 'cdot ' || s"),
    (f"{BS} || 'sin(x)+' || {BS} || 'sqrt{{' || s || 'x}}'", f"{BS} || 'sqrt{{x}}' || {BS} || 'sqrt{{' || s || '}}+' || {BS} || 'sin x'"),
    (f"{BS} || 'frac{{x^2-' || (n*n) || '}}{{x-' || s || '}}'", "'x+' || s"),
    ("'listen ' || s", "'silent ' || s"),
    ("'x>' || s", f"'(' || s || ',' || {BS} || 'infty)'"),
    (f"'[0,' || s || ']' || {BS} || 'cup[' || s || ',' || (n+1) || ']'", "'[0,' || (n+1) || ']'"),
    ("'(0,' || s || ')'", "'[0,' || s || ']'"),
    (f"'x' || {BS} || 'geq ' || s", "'x>' || s"),
    (f"'0<x' || {BS} || 'le ' || s", f"'x ' || {BS} || 'in (0, ' || s || ']'"),
]
# whether the two answers of a form are equal, stated and not computed
_TRUTH = "case when form = 11 then l_returnflag = 'A' else form not in (16, 18, 19, 26, 27) end"
_EXPRESSION_TRUTH = "form not in (4, 6, 10, 13, 14)"


def _pairs(forms: list[tuple[str, str]]) -> str:
    left, right = (" ".join(f"when {i} then {f[side].replace('{{', '{').replace('}}', '}')}" for i, f in enumerate(forms)) for side in (0, 1))
    return (
        "p0 as (select *, cast(cast(l_quantity as int) as varchar) as s, cast(l_quantity as int) as n,"
        f" cast((l_orderkey + l_linenumber) % {len(forms)} as int) as form from lineitem),\n"
        f"p as (select l_orderkey, l_linenumber, form, l_returnflag, case form {left} end as answer, case form {right} end as model_answer from p0)"
    )


PAIRS = _pairs(_PAIR_FORMS)


# ------------------------------------------------------------------- text functions
def _close(part: str) -> str:
    """List of closing pieces: content of a box from the text after its brace."""
    segs = f"string_split({part}, '}}')"
    opens = (
        f"(len(array_to_string({segs}[1:i], '')) - "
        f"len(replace(array_to_string({segs}[1:i], ''), '{{', '')))"
    )
    hit = f"list_filter(range(1, len({segs})), lambda i: {opens} + 1 = i)[1]"
    return f"case when {hit} is not null then array_to_string({segs}[1:{hit}], '}}') end"


def boxed_last(x: str) -> str:
    return f"case when contains({x}, {BOX}) then {_close(f'string_split({x}, {BOX})[-1]')} end"


def boxed_all(x: str) -> str:
    """Closed boxes, for texts in which no box contains another."""
    return (
        f"list_filter(list_transform(string_split({x}, {BOX})[2:], lambda p: {_close('p')}),"
        " lambda y: y is not null)"
    )


def tag(x: str, name: str, flags: str = "(?-s)") -> str:
    pattern = f"'{flags}<{name}>(.*?)</{name}>'"
    return (
        f"case when regexp_matches({x}, {pattern}) then "
        f"{strip(f'regexp_extract({x}, {pattern}, 1)')} end"
    )


def single(x: str, name: str) -> str:
    bodies = f"regexp_extract_all({x}, '(?s)<{name}>(.*?)</{name}>', 1)"
    return f"case when len({bodies}) = 1 then {bodies}[1] end"


def count(x: str, needle: str) -> str:
    return f"(len({x}) - len(replace({x}, '{needle}', ''))) // {len(needle)}"


def wrap(x: str) -> str:
    return (
        f"case when {x} = '' or (starts_with({x}, '$') and ends_with({x}, '$')) "
        f"then {x} else '$' || {x} || '$' end"
    )


def base(x: str) -> str:
    return f"string_split({x}, '/')[-1]"


def truncated(resp: str = "resp") -> str:
    return (
        f"(finish_reason = 'length' and contains({resp}, '<think>')"
        f" and not contains({resp}, '</think>'))"
    )


def final_answer(x: str, box: str | None = None) -> str:
    number = (
        r"'(?:^|[^0-9A-Za-z.)}])([+-]?(?:\\d?frac\{[0-9]+\}\{[0-9]+\}"
        r"|[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:/[0-9]+)?|\.[0-9]+)%?)'"
    )
    return (
        f"coalesce({box or boxed_last(x)}, regexp_extract_all({x}, '\\$([^$]+)\\$', 1)[-1], "
        f"regexp_extract_all({x}, {number}, 1)[-1], "
        f"regexp_extract_all({x}, '\\b([A-E])\\b', 1)[-1], {strip(x)})"
    )


def select_answer(found: str, resp: str = "resp") -> str:
    return f"coalesce(case when {found} <> '' then {wrap(found)} end, {strip(resp)})"


def final_answer_of_text(x: str) -> str:
    """`final_answer` where words may hold any letters."""
    letter = r"'(?:^|[^\p{L}\p{N}_])([A-E])(?:[^\p{L}\p{N}_]|$)'"
    return final_answer(x).replace("'\\b([A-E])\\b'", letter)


# ------------------------------------------------------------------ answer equality
_RULES = [
    (r"\\[dt]frac", r"\\frac"),
    (r"\\(?:left|right)\b|\\[!,;: ]", ""),
    (r"([0-9}])[ ~]*\\(?:text|mathrm|mbox)\{[^{}]*\}(?:\^\{?[0-9]\}?)?[. ]*$", r"\1"),
    (r"\\(?:text|textbf|mathrm|mathbf|mbox)\{([^{}]*)\}", r"\1"),
    (r"\\%", "%"),
    (r"\\\$", ""),
    (r"\^?\{?\\(?:circ|degree)\b\}?|°", ""),
    (r"\{,\}", ","),
    (r"\s+", " "),
    (r" ?([^A-Za-z0-9 ]) ?", r"\1"),
    (r"\.+$", ""),
    (r"\\frac([0-9])([0-9])", r"\\frac{\1}{\2}"),
    (r"\\sqrt([0-9])", r"\\sqrt{\1}"),
    (r"\^\{([A-Za-z0-9])\}", r"^\1"),
    (r"([0-9])\.0+\b", r"\1"),
    (r"(\.[0-9]*[1-9])0+\b", r"\1"),
]
_NUM = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_PLAIN = rf"^[+-]?{_NUM}$"
_TERM = (
    rf"^([+-]?)({_NUM})?(?:\\cdot|\\times|\*)?(?:\\sqrt\{{({_NUM})\}})?"
    r"(?:\\cdot|\\times|\*)?(\\pi|π)?$"
)
_POWER = rf"^([+-]?)(?:({_NUM})(?:\\cdot|\\times|\*))?([0-9]+)\^(?:\{{([+-]?[0-9]{{1,3}})\}}|([0-9]))$"
_ARG = r"(?:[^{}]|\{[^{}]*\})+"
_FRAC = rf"^([+-]?)([0-9]*)\\frac\{{({_ARG})\}}\{{({_ARG})\}}(\\pi|π)?$"


def _g(x: str, pattern: str, i: int) -> str:
    return f"regexp_extract({x}, '{pattern}', {i})"


def _factor(x: str, pattern: str, i: int, default: str, fn: str = "{}") -> str:
    v = fn.format(f"try_cast(nullif({_g(x, pattern, i)}, '') as double)")
    return f"coalesce({v}, {default})"


def _term(x: str) -> str:
    return (
        f"(case when regexp_matches({x}, '{_PLAIN}') then try_cast({x} as double) "
        f"when {x} <> '' and regexp_matches({x}, '[0-9iπ]\\}}?$') and regexp_matches({x}, '{_TERM}') then "
        f"(case when {_g(x, _TERM, 1)} = '-' then -1.0 else 1.0 end) * {_factor(x, _TERM, 2, '1.0')} * "
        f"{_factor(x, _TERM, 3, '1.0', 'sqrt({})')} * "
        f"(case when {_g(x, _TERM, 4)} <> '' then {math.pi} else 1.0 end) end)"
    )


def _num(x: str) -> str:
    n, d = f"string_split({x}, '/')[1]", f"string_split({x}, '/')[2]"
    return (
        f"case when regexp_matches({x}, '{_PLAIN}') then try_cast({x} as double) "
        f"when not regexp_matches({x}, '[0-9π]|\\\\pi') then null "
        f"when regexp_matches({x}, '^[+-]?{_NUM}%$') then try_cast(left({x}, len({x})-1) as double) / 100 "
        f"when regexp_matches({x}, '{_FRAC}') then (case when {_g(x, _FRAC, 1)} = '-' then -1.0 else 1.0 end) * "
        f"({_factor(x, _FRAC, 2, '0.0')} + {_term(_g(x, _FRAC, 3))} / nullif({_term(_g(x, _FRAC, 4))}, 0.0)) * "
        f"(case when {_g(x, _FRAC, 5)} <> '' then {math.pi} else 1.0 end) "
        f"when regexp_matches({x}, '^[^/]+/[^/]+$') then {_term(n)} / nullif({_term(d)}, 0.0) "
        f"when regexp_matches({x}, '{_POWER}') then (case when {_g(x, _POWER, 1)} = '-' then -1.0 else 1.0 end) * "
        f"{_factor(x, _POWER, 2, '1.0')} * pow(try_cast({_g(x, _POWER, 3)} as double), "
        f"try_cast(coalesce(nullif({_g(x, _POWER, 4)}, ''), {_g(x, _POWER, 5)}) as double)) "
        f"else {_term(x)} end"
    )


def parsed(source: str, answers: dict[str, str], out: str) -> str:
    """CTEs that add ``<name>_canon/_letter/_num`` to `source`, the last one called `out`."""
    def cte(i: int, src: str, cols: dict[str, str]) -> str:
        name = out if i == 5 else f"{out}_{i}"
        return f"{name} as (select *, " + ", ".join(f"{e} as {n}" for n, e in cols.items()) + f" from {src})"

    def inner(s: str) -> str:
        box = f"regexp_extract_all({s}, '\\\\boxed\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 1)[-1]"
        x = strip(f"case when contains({s}, {BOX}) then coalesce({box}, {s}) else {s} end")
        return strip(
            f"case when starts_with({x}, '$$') and ends_with({x}, '$$') and len({x}) >= 4 then {x}[3:-3] "
            f"when starts_with({x}, '$') and ends_with({x}, '$') and len({x}) >= 2 then {x}[2:-2] else {x} end"
        )

    def rules(x: str) -> str:
        y = x
        for pattern, repl in _RULES:
            y = f"regexp_replace({y}, '{pattern}', '{repl}', 'g')"
        return strip(y)

    def commas(x: str) -> str:
        body = f"{x}[3:-3]"
        return (
            f"case when regexp_matches({x}, '^[+-]?[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?%?$') then replace({x}, ',', '') "
            f"when regexp_matches({x}, '^\\\\\\{{[^()\\[\\]{{}}]*,[^()\\[\\]{{}}]*\\\\\\}}$') then "
            f"{BS} || '{{' || array_to_string(list_sort(string_split({body}, ',')), ',') || {BS} || '}}' "
            f"when regexp_matches({x}, '^[^()\\[\\]{{}}]*,[^()\\[\\]{{}}]*$') then "
            f"array_to_string(list_sort(string_split({x}, ',')), ',') else {x} end"
        )

    steps = [
        {f"{n}_1": inner(e) for n, e in answers.items()},
        {f"{n}_2": rules(f"{n}_1") for n in answers},
        {f"{n}_canon": commas(f"{n}_2") for n in answers},
        {
            f"{n}_3": f"regexp_replace({n}_canon, '^[A-Za-z](?:_(?:[A-Za-z0-9]|\\{{[A-Za-z0-9]+\\}}))?=', '')"
            for n in answers
        },
        {
            k: v
            for n in answers
            for k, v in (
                (f"{n}_letter", f"nullif(regexp_extract({n}_canon, '^\\(?([A-E])\\)?$', 1), '')"),
                (f"{n}_num", _num(f"{n}_3")),
            )
        },
    ]
    return ",\n".join(
        cte(i, source if i == 1 else f"{out}_{i-1}", s) for i, s in enumerate(steps, 1)
    )


def equal(a: str, b: str) -> str:
    return (
        f"(coalesce({a}_canon = {b}_canon and {a}_canon <> '', false) or "
        f"coalesce({a}_letter = {b}_letter, false) or "
        f"coalesce(abs({a}_num - {b}_num) <= 1e-6, false))"
    )


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


R = _with(RESPONSES)
O: dict[str, str] = {}

# ------------------------------------------------------------ text over responses
for _key, _expr in {
    "d01_boxed_last": boxed_last("resp"),
    "d03_answer_tag": tag("resp", "answer"),
    "d04_answer_tag_multiline": tag("resp", "answer", "(?s)"),
    "d05_think_body": single("resp", "think"),
    "d06_desc_body": single("resp", "desc"),
    "d11_image_number": "image_key",
    "d12_image_folder_key": "'image/image' || image_key || '.png'",
    "d14_without_image_token": "question[8:]",
    "d18_salvage_text": f"question || resp || '</think>' || {q(K.SALVAGE_CUE)}",
    "e01b_final_answer": final_answer("resp"),
}.items():
    O[_key] = f"{R}select sid, {_expr} as value from r"

O["d02_boxed_all"] = (
    f"{R}, x as (select sid, {boxed_all('resp')} as l from r) "
    f"select sid, cast(len(l) as int) as n_boxed, {strip('l[-1]')} as last_boxed from x"
)
O["d07_wrap_math"] = (
    f"{R}select sid, '$' || answer || '$' as wrapped, '$' || answer || '$' as twice, "
    "'$' || answer as unless_dollar from r"
)
O["d10_select_answer"] = (
    f"{R}, x as (select *, {boxed_last('resp')} as bx, {tag('resp', 'answer')} as tg from r) "
    f"select sid, {select_answer('bx')} as boxed_prompt, {select_answer('tg')} as tag_prompt from x"
)
O["d16_tag_counts"] = (
    f"{R}select sid, cast({count('resp', '<think>')} as int) as n_think, "
    f"{count('resp', '<answer>')} = 1 as one_answer from r"
)
O["d19_judge_prompts"] = (
    f"{R}select sid, {q(K.CAPTION_JUDGE_HEAD)} || resp || {q(K.CAPTION_JUDGE_QUESTION)} || question || "
    f"{q(K.CAPTION_JUDGE_TAIL)} as caption, 'Question: ' || replace(question, '<image>', '') || "
    f"{q(K.THINKING_JUDGE_REASONING)} || {strip(single('resp', 'think'))} as thinking from r"
)


_LONG = (
    "d1 as (select doc_id, '<desc>' || coalesce(text, '') || '</desc>' || chr(10) || '<think>' || coalesce(text, '') || '</think>' "
    "|| chr(10) || '<answer>' || doc_id || '</answer>' as graded from documents),\n"
    f"d2 as (select *, graded || chr(10) || chr(10) || {BOX} || doc_id || '}}' as resp from d1)"
)
O["d20_marks_in_long_texts"] = (
    f"{_with(_LONG)}select doc_id, len({single('resp', 'think')}) as think_length, len({single('resp', 'desc')}) as desc_length, "
    f"{tag('resp', 'answer')} as tag, {tag('resp', 'answer', '(?s)')} as tag_any_line, {boxed_last('resp')} as last_box, "
    f"cast(len({boxed_all('resp')}) as int) as n_boxes, "
    "regexp_matches(graded, '(?s)^<desc>.*?</desc>\\s*<think>.*?</think>\\s*<answer>.*?</answer>$') as in_format from d2"
)


# --------------------------------------------------------------------- option lists
def _options(x: str, mark: str) -> str:
    """[letter, text] pairs of options in one notation, by line."""
    broken = f"regexp_replace({x}, '({mark})', chr(10) || '\\1', 'g')"
    letter = mark.replace("[A-E]", "([A-E])")
    pattern = f"'{letter}\\s*([^\\n]*)'"
    letters = f"regexp_extract_all({broken}, {pattern}, 1)"
    texts = f"regexp_extract_all({broken}, {pattern}, 2)"
    return (
        f"list_transform(range(1, len({letters}) + 1), lambda i: "
        f"[{letters}[i], regexp_replace(trim({texts}[i]), '\\s+', ' ', 'g')])"
    )


OPTIONS = (
    "co as (select *, case when dataset = 'We-Math' then " + _options("question", r"[A-E]\.")
    + " when dataset = 'MathVerse' then " + _options("question", "[A-E]:")
    + " when len(" + _options("question", "[A-E]:") + ") >= 2 then " + _options("question", "[A-E]:")
    + r" when len(" + _options("question", r"[A-E]\.") + ") >= 2 then " + _options("question", r"[A-E]\.")
    + r" when len(" + _options("question", r"\([A-E]\)") + ") >= 2 then " + _options("question", r"\([A-E]\)")
    + " else cast([] as varchar[][]) end as opts from c),\n"
    "cl as (select *, list_transform(list_sort(list_distinct(list_transform(opts, lambda o: o[1]))), "
    "lambda l: list_filter(opts, lambda o: o[1] = l)[-1][2]) as found from co)"
)
O["d08_options_from_question"] = (
    _with(CHOICES, OPTIONS)
    + "select item_id, array_to_string(list_transform(opts, lambda o: o[1] || '=' || o[2]), '|') as options, "
    "array_to_string(found, '|') as by_letter from cl"
)
O["d09_options_until_semicolon"] = (
    "select p_partkey as item_id, 'A=' || p_name || '|B=' || p_type || '|C=size  ' || p_size as options from part"
)


def _choice(v: str, p: str) -> str:
    """CTE columns: letter, index and text of a value among the options."""
    named = f"case when len({v}) = 3 and {v}[1] = '$' and {v}[3] = '$' then upper({v}[2]) else upper({v}) end"
    return (
        f"case when len({named}) = 1 and {named} between 'A' and 'F' then {named} end as {p}_l, "
        f"list_position(ch, {v}) as {p}_pos"
    )


def _choice_text(p: str, v: str) -> str:
    return (
        f"case when {p}_l is null then coalesce({p}_pos, 0) - 1 else ascii({p}_l) - 65 end as {p}_i, "
        f"case when {p}_l is null then {v} else coalesce(ch[ascii({p}_l) - 64], "
        f"list_filter(opts, lambda o: o[1] = {p}_l)[-1][2], {p}_l) end as {p}_t, "
        f"coalesce({p}_l, case when {p}_pos > 0 then chr(64 + {p}_pos) else {v} end) as {p}_n"
    )


_CH = (
    "c1 as (select *, trim(answer) as a, trim(parsed_answer) as m, "
    "coalesce(choices, found) as ch, from cl),\n"
    f"c2 as (select *, {_choice('a', 'a')}, {_choice('m', 'm')} from c1),\n"
    f"c3 as (select *, {_choice_text('a', 'a')}, {_choice_text('m', 'm')} from c2),\n"
    + parsed("c3", {"at": "a_t", "mt": "m_t"}, "c4")
)
_LETTERS = (
    "(len(a) = 1 and upper(a) between 'A' and 'F' and len(m) = 1 and upper(m) between 'A' and 'F')"
)
O["e02_choice_match"] = (
    _with(CHOICES, OPTIONS, _CH)
    + f"select item_id, case when {_LETTERS} or (a_i >= 0 and m_i >= 0) then a_n else a_t end as normalized_answer, "
    f"case when {_LETTERS} or (a_i >= 0 and m_i >= 0) then m_n else m_t end as normalized_parsed_answer, "
    f"case when {_LETTERS} then upper(a) = upper(m) when a_i >= 0 and m_i >= 0 then a_i = m_i "
    f"else a_t = m_t or {equal('at', 'mt')} end as is_match from c4"
)
O["x05_custom_equality"] = (
    _with(CHOICES)
    + "select item_id, answer = parsed_answer or lower(trim(answer)) = lower(trim(parsed_answer)) as is_equal from c"
)

# ------------------------------------------------------------------- supplied texts
_WSCLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in K.PY_WHITESPACE) + "]"
O["d13_squeeze_documents"] = (
    f"select doc_id, regexp_replace({strip('text')}, '{_WSCLASS}+', ' ', 'g') as squeezed, "
    f"{strip('text')} as stripped from documents"
)
O["d15_formatted_numbers"] = (
    "select l_orderkey, l_linenumber, printf('%.4f', l_quantity) as four, printf('%.2f', l_quantity) as two, "
    "printf('%.2f', l_quantity / 64 * 100) || '%' as percent from lineitem"
)
O["d17_option_letters"] = "select p_partkey, chr(cast(65 + p_partkey % 6 as int)) as letter from part"
O["l12_token_counts"] = (
    "select doc_id, cast(len(regexp_extract_all(text, '\\w+|[^\\w\\s\\x0b]')) as int) as tokens from documents"
)
O["l09_base64_round_trip"] = "select doc_id, base64(encode(text)) as encoded from documents"
O["l06_json_fields"] = (
    "select event_id, cast(json_extract(props, '$.k') as bigint) as k, array_to_string(json_keys(props), ',') as keys from events"
)

O["e01b_final_answer_of_texts"] = (
    f"select doc_id, {final_answer_of_text('text')} as value from documents"
)
O["e02a_choice_info"] = (
    _with(CHOICES, OPTIONS, "c1 as (select *, trim(answer) as a, coalesce(choices, found) as ch from cl)",
          f"c2 as (select *, {_choice('a', 'a')} from c1)", f"c3 as (select *, {_choice_text('a', 'a')} from c2)")
    + "select item_id, a_n as letter, cast(a_i as int) as index, a_t as text from c3"
)
O["h06_lookup_by_name"] = (
    _with(ITEMS) + "select item_id, dataset, case dataset "
    + " ".join(f"when '{d}' then '{p}'" for d, p in K.IMAGE_DIRS.items()) + " end as folder from i"
)

# ------------------------------------------------------------------- equivalence
_PP = _with(PAIRS)
O["e01_equivalent"] = f"{_PP}select l_orderkey, l_linenumber, form, {_TRUTH} as is_equal from p"
O["e01_expressions"] = f"{_with(_pairs(_EXPRESSION_FORMS))}select l_orderkey, l_linenumber, form, {_EXPRESSION_TRUTH} as is_equal from p"
O["e03_equal_or_same_text"] = (
    f"{_PP}select l_orderkey, l_linenumber, form, answer = model_answer or {_TRUTH} as is_equal, "
    "answer = model_answer as is_same from p"
)

# ------------------------------------------------------------------------ rewards
_FEATURES = (
    f"r1 as (select *, {boxed_last('resp')} as bx, {boxed_all('resp')} as boxes, {tag('resp', 'answer')} as tg, "
    f"{tag('resp', 'answer', '(?s)')} as tgm, {single('resp', 'desc')} as ds, {single('resp', 'think')} as th from r),\n"
    f"r2 as (select *, {final_answer('resp', 'bx')} as whole, {strip('boxes[-1]')} as fbox, "
    f"{strip('coalesce(nullif(bx, chr(0)), resp)')} as bort, coalesce(tg, {strip('resp')}) as tort, "
    f"{final_answer('ds')} as cap from r1),\n"
    + parsed(
        "r2",
        {"l": "answer", "w": "whole", "f": "fbox", "b": "bort", "t": "tort", "tm": "tgm", "c": "cap"},
        "x",
    )
)
X = _with(RESPONSES, _FEATURES)


def _reward(expr: str) -> str:
    return f"{X}select sid, round(cast({expr} as double), 6) as reward from x"


def _if(cond: str, points: str = "1.0") -> str:
    return f"(case when {cond} then {points} else 0.0 end)"


_TOKENS = "len(regexp_extract_all(resp, '\\w+|[^\\w\\s]'))"
_FOUR = ("<think>", "</think>", "<answer>", "</answer>")


def _tags(points: str) -> str:
    return " + ".join(_if(f"{count('resp', t)} = 1", points) for t in _FOUR)


_GAUSS = "case when {eq} then 1.0 else coalesce(exp(-pow(b_num - l_num, 2) / {d}), 0.0) end"
_ENDS = (
    f"(ends_with(resp, '}}') and regexp_matches(resp, '(?s)^.+\\n\\n\\\\boxed\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*\\}}$'))"
)
_REWARD_SQL = {
    "f01_math_acc": _if(f"not (l_canon <> '') or {equal('w', 'l')}"),
    "f02_math_format": _tags("0.125")
    + " + " + _if("regexp_matches(resp, '(?s)^<think>\\n\\n.*?\\n\\n</think>\\n\\n<answer>.*?</answer>$')", "0.5"),
    "f03_r1v_acc": _if(f"{equal('w', 'l')} or tort = answer"),
    "f04_compare_acc": _if(equal("f", "l")),
    "f05_answer_format": _if(
        "regexp_matches(resp, '(?s)^<desc>.*?</desc>\\s*<think>.*?</think>\\s*<answer>.*?</answer>$')"
    ),
    "f06_answer_tag_acc": _if(equal("t", "l")),
    "f07_answer_tag_acc_gauss": _GAUSS.format(eq=equal("b", "l"), d="(2 + 1e-9)"),
    "f08_soft_overlong": f"least(-(cast({_TOKENS} as double) - 10) / 20, 0.0)",
    "f09_boxed_verify": _if(f"{equal('w', 'l')} or resp = answer", "0.5") + " + "
    + _if(f"{equal('f', 'l')} or coalesce(fbox = answer, false)", "0.5"),
    "f10_boxed_format": _if("len(boxes) > 0"),
    "f11_tag_count": _tags("0.25"),
    "f12_boxed_count": _if("len(boxes) = 1"),
    "f13_boxed_pos": f"case when contains(resp, {q(K.BOX_WORD)}) then "
    f"1 - cast(len(resp) - strpos(resp, {q(K.BOX_WORD)}) + 1 - 6 as double) / len(resp) else 0.0 end",
    "f14_acc_format": f"case when {equal('w', 'l')} then 1.0 when {_ENDS} then 0.0 else -1.0 end",
    "f15_answer_tag_length_acc": f"case when {equal('t', 'l')} then least(1.0, {_TOKENS} / 512.0::double) else 0.0 end",
    "f18_cap_length": _if(
        "coalesce(len(regexp_extract_all(th, '\\w+|[^\\w\\s]')) > len(regexp_extract_all(ds, '\\w+|[^\\w\\s]')), false)"
    ),
    "f19_cap_check": _if(f"ds is not null and not {equal('c', 'l')}"),
}
for _key, _expr in _REWARD_SQL.items():
    O[_key] = _reward(_expr)
O["x02_gauss_with_sigma"] = _reward(_GAUSS.format(eq=equal("b", "l"), d="(8 + 1e-9)"))

_MANY = {
    "external_answer_tag_acc": "f06_answer_tag_acc",
    "external_boxed_verify": "f09_boxed_verify",
    "external_acc_format": "f14_acc_format",
    "external_tag_count": "f11_tag_count",
    "external_boxed_count": "f12_boxed_count",
    "external_math_format": "f02_math_format",
}
O["x01_score_many_rewards"] = (
    f"{X}select dataset, count(*) as n, "
    + ", ".join(f"round(avg(cast({_REWARD_SQL[v]} as double)), 6) as {k}" for k, v in _MANY.items())
    + " from x group by dataset"
)

_JUDGED = (
    f"jt as (select *, {_said(0)} as said_t, {_said(1)} as said_c from x),\n"
    f"jr as (select *, {strip(boxed_all('coalesce(said_t, chr(32))') + '[-1]')} as vb, "
    f"{strip(boxed_all('coalesce(said_c, chr(32))') + '[-1]')} as cb from jt),\n"
    + parsed("jr", {"jv": "vb", "jc": "cb"}, "y")
)
Y = _with(RESPONSES, _FEATURES, _JUDGED)
_CAP = _if(equal("jc", "l"))
_LEAK = _REWARD_SQL["f19_cap_check"]
for _key, _expr in {
    "f16_thinking_verify": _if("th is not null and coalesce(vb = '1', false)"),
    "f17_cap_verify": _CAP,
    "f20_mm": f"case when {equal('tm', 'l')} then 1.0 + {_LEAK} + {_CAP} else 0.0 end",
}.items():
    O[_key] = f"{Y}select sid, round(cast({_expr} as double), 6) as reward from y"
O["j02_judge_scores"] = (
    f"{Y}select sid, cast({_CAP} as double) as caption, "
    f"cast({_if('th is not null and ' + equal('jv', 'l'))} as double) as thinking from y"
)

# --------------------------------------------------------- judge and generation
O["j01_thinking_requests"] = (
    f"{R}select sid as id, 'Question: ' || replace(question, '<image>', '') || {q(K.THINKING_JUDGE_REASONING)} || "
    f"{strip(single('resp', 'think'))} as user, image, 'png' as image_format, "
    f"{len(K.JUDGE_SYSTEM_PROMPT)} as system_length from r where ({single('resp', 'think')}) is not null"
)
O["j01_caption_requests"] = (
    f"{R}select sid as id, {q(K.CAPTION_JUDGE_HEAD)} || resp || {q(K.CAPTION_JUDGE_QUESTION)} || question || "
    f"{q(K.CAPTION_JUDGE_TAIL)} as user from r"
)
O["j03_generate"] = (
    f"{R}select sid, case when len(resp) % 3 = 0 then '<think>it is ' || len(resp) "
    f"else 'so ' || {BOX} || len(resp) || '}}' end as resp, "
    "case when len(resp) % 3 = 0 then 'length' else 'stop' end as finish_reason from r"
)
_CLOSED = f"resp || '</think>' || {q(K.SALVAGE_CUE)}"
O["j04_salvage"] = (
    f"{R}select sid, case when {truncated()} then {_CLOSED} || ' ' || {BOX} || "
    f"len(question || {_CLOSED}) || '}}' else resp end as resp from r"
)

# ------------------------------------------------------------------------ prompts
_I = _with(ITEMS)
_LINES = (
    "array_to_string(list_transform(range(1, len({x}) + 1), lambda n: "
    "'(' || chr(cast(64 + n as int)) || ') ' || {x}[n]), chr(10))"
)
_QUESTION = {
    K.MATH_V: f"case when len(options) > 0 and array_to_string(options, '') <> 'ABCDE' then question || {NL} || "
    + _LINES.format(x="options") + f" || {NL} else question end",
    K.WE_MATH: f"question || {NL} || option",
    K.MATHVERSE: "question_for_eval",
    K.MATHVISTA: f"case when len(choices) > 0 then question || {q(K.MATHVISTA_OPTION_CUE)} || {NL} || "
    + _LINES.format(x="choices") + " else question end",
    K.LOGICVISTA: "question",
    K.DYNAMATH: "question",
}
_FILE = {d: "image" for d in DATASETS} | {K.WE_MATH: "image_path", K.LOGICVISTA: "imagename"}


def _per_dataset(root: str) -> tuple[str, str]:
    question = "case dataset " + " ".join(f"when '{d}' then {_QUESTION[d]}" for d in DATASETS) + " end"
    image = "case dataset " + " ".join(
        f"when '{d}' then '{root}/{K.IMAGE_DIRS[d]}/' || {_FILE[d]}" for d in DATASETS
    ) + " end"
    return question, image


_PQ, _PI = _per_dataset("bench")
for _i, _d in enumerate(DATASETS, 1):
    O[f"c0{_i}_prompt_{_d.lower().replace('-', '_')}"] = (
        f"{_I}select item_id, {_PQ} as prompt_question, {_PI} as image_file from i where dataset = '{_d}'"
    )
O["c07_prompt_competition"] = (
    _with(COMPETITION)
    + f"select item_id, case when contains(tag, '_TO_') and context is not null then context || {NL} || {NL} || question "
    "else question end as prompt_question, "
    "case when contains(tag, '_TO_') then '' else array_to_string(list_transform("
    "regexp_extract_all(question, '<(img_[0-9]+)>', 1), "
    f"lambda n: '{K.OLYMPIAD_IMAGE_DIR}/' || n || '.jpg'), ',') end as image_file, "
    "case when contains(tag, '_TO_') then 2 else 1 end as n_messages from o"
)
O["c08_messages"] = (
    f"{_I}select item_id, 'system' as first_role, 'user' as second_role, {_PI} as image_file, "
    f"256*28*28 as min_pixels, 1280*28*28 as max_pixels, {_PQ} as question_text from i"
)
O["c11_flat_prompt"] = (
    f"{_I}select item_id, 'system: ' || {q(K.SYSTEM_PROMPT_THINK_ANSWER)} || {NL} || 'user: <image>' || {_PQ} || "
    f"{NL} || 'assistant: ' as prompt from i"
)

# ---------------------------------------------------------------- rows and files
F_ = _with(RESPONSES, FILES)
_HAS = "(answer is not null and parsed_answer is not null and question is not null)"
# Trials compare wrapped texts; the other files hold no options, so choices reduce to
# letters (which do not occur) and answer equality.
_JF = (
    "f1 as (select *, contains(file, 'DynaMath') as is_trial, "
    f"contains(file, 'DynaMath') or {_HAS} as is_scored, "
    "case when contains(file, 'DynaMath') then image_key end as ik, "
    "case when contains(file, 'DynaMath') then coalesce(parsed_answer, '') else parsed_answer end as pa from f),\n"
    + parsed("f1", {"la": "answer", "pb": "pa"}, "f2")
    + f",\nf3 as (select *, case when is_scored then trim(answer) = trim(pa) or {equal('la', 'pb')} end as is_match from f2)"
)
FJ = _with(RESPONSES, FILES, _JF)
O["b01_required_fields"] = f"{F_}select sid, file from f where {_HAS}"
O["b02_verified_rows"] = f"{F_}select file, count(*) as n_verified from f where verify group by file"
O["b03_trial_records"] = (
    f"{FJ}select coalesce(question, '') as question, answer, coalesce(parsed_answer, '') as parsed_answer, "
    f"{wrap('answer')} as normalized_answer, {wrap('pa')} as normalized_parsed_answer, 'DynaMath' as dataset_type, "
    "is_match, image, image_key from f3 where is_trial"
)
O["b04_standard_records"] = (
    f"{FJ}select answer, parsed_answer, is_match from f3 where not is_trial and is_scored"
)
_EV = (
    f"r1 as (select *, {boxed_last('resp')} as bx from r),\n"
    f"r2 as (select *, {select_answer('bx')} as parsed_answer from r1),\n"
    "r3 as (select *, case when starts_with(parsed_answer, '$') and ends_with(parsed_answer, '$') "
    f"and len(parsed_answer) >= 2 then parsed_answer else {final_answer('parsed_answer')} end as cand from r2),\n"
    + parsed("r3", {"m": "cand", "l": "answer"}, "r4")
    + f",\ne as (select *, parsed_answer = '$' || answer || '$' or {equal('m', 'l')} as verify from r4)"
)
E = _with(RESPONSES, _EV)
O["b05_evaluated_rows"] = f"{E}select sid, parsed_answer, verify from e"
O["b06_first_rows"] = f"{R}select ord, sid, resp from r order by sid limit 200"
O["b07_truncated_thoughts"] = f"{R}select sid, resp from r where {truncated()}"
_NAME = (
    "case when lower(file) like '%mathverse%' then 'MathVerse' when lower(file) like '%we-math%' "
    "or lower(file) like '%wemath%' then 'We-Math' when lower(file) like '%mathvista%' then 'MathVista' "
    "when lower(file) like '%dynamath%' then 'DynaMath' else 'Unknown' end"
)
O["b08_dataset_from_file"] = f"{F_}select file, {_NAME} as dataset, count(*) as n from f group by all"
O["b09_file_routes"] = (
    f"{F_}select case when contains(file, 'DynaMath') then 'trials' else 'standard' end as route, "
    "contains(file, 'filtered_') or contains(file, 'We-Math') as is_skipped, count(*) as n from f group by all"
)
O["b10_kept_files"] = (
    f"{F_}select sid, file from f where not (contains(file, 'filtered_') or contains(file, 'We-Math'))"
)
O["b11_rows_with_image_number"] = (
    "select p_partkey as item_id, p_partkey as image_key from part where p_partkey % 2 = 1"
)
O["a05_parquet_scan"] = (
    "select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as n_chars from documents group by lang, source"
)
O["a09_split_rows"] = (
    f"{FJ}select file, case when is_match then 'filtered_match' else 'filtered_mismatch' end as split, "
    "count(*) as n, count(*) filter (where is_match) as n_match from f3 where is_scored group by all"
)
O["a13_union_of_train_tables"] = (
    "select text as query, lang, cast(null as varchar) as role from documents union all "
    "select text, null, role from conversations"
)
O["a14_output_names"] = (
    f"select page_id, 'filtered_match_' || {base('url')} as match_file, 'filtered_mismatch_' || {base('url')} as mismatch_file, "
    "case when len(string_split(url, '/')) >= 3 then array_to_string(string_split(url, '/')[-3:], '/') else url end as folder, "
    f"string_split({base('url')}, '.')[1] as stem from pages"
)
O["a01_jsonl_scan"] = f"{R}select sid, image, answer, resp, finish_reason from r"
O["a02_tolerant_jsonl_scan"] = f"{R}select sid, answer from r where sid % 10 <> 3"
O["a04_json_list_scan"] = f"{R}select sid, answer from r"
O["a04_json_keyed_scan"] = O["a04_json_list_scan"]
O["a03_benchmark_scan"] = (
    _with(ITEMS) + "select question_for_eval, image, cast(item_id as varchar) as answer, 'MathVerse' as dataset from i"
)
O["a12_images"] = (
    f"select page_id || '.png' as name, base64(encode(coalesce(html, '') || {NL})) as image_base64 from pages"
)
O["a08_appended_batches"] = f"{R}select sid, answer from r"

# -------------------------------------------------------------------------- metrics
_ACC = "round(coalesce(avg(cast(verify as int)) * 100, 0.0), 6)"
_IMG = "im as (select dataset, image_key, min(cast(verify as int)) as ok, count(*) filter (where verify) as nv from e group by all)"
O["g01_accuracy"] = (
    f"{E}select dataset, count(*) as n, count(*) filter (where verify) as n_correct, {_ACC} as acc from e group by dataset"
)
O["g02_worst_case_accuracy"] = (
    f"{E}, {_IMG} select dataset, count(*) as n_images, round(avg(ok) * 100, 6) as acc from im group by dataset"
)
O["g03_strict_trials"] = (
    f"{E}, {_IMG} select dataset, count(*) filter (where nv = 10) as qualified_count, "
    "round(count(*) filter (where nv = 10) / 501.0::double, 6) as acc from im group by dataset"
)
O["g12_accuracy_per_benchmark"] = (
    f"{E}, {_IMG}, pa as (select dataset, count(*) as n, avg(cast(verify as int)) * 100 as acc from e group by dataset), "
    "pw as (select dataset, avg(ok) * 100 as worst from im group by dataset) "
    "select dataset, n, round(case when dataset = 'DynaMath' then worst else acc end, 6) as acc from pa join pw using (dataset)"
)
O["a06_evaluated_file"] = (
    f"{E}, {_IMG} select 'DynaMath' as dataset, round(avg(ok) * 100, 6) as acc, "
    "printf('%.4f', avg(ok) * 100) as acc_text from im"
)


def _trials(kept: str) -> str:
    return (
        f"{FJ}, t as (select image_key, count(*) as n, count(*) filter (where {kept}) as k, "
        f"count(*) filter (where {kept} and is_match) as m, count(*) filter (where verify) as v from f3 where is_trial group by image_key), "
        "s as (select cast(sum(n) as bigint) as total_file_records, cast(sum(k) as bigint) as total_records, "
        "cast(sum(v) as bigint) as verify_true_records, cast(sum(m) as bigint) as match_count, "
        "count(*) filter (where k = 10) as qualified_count, count(*) filter (where k = 10 and m = 10) as match_qualified_images, "
        "count(*) filter (where v = 10) as verify_qualified_images from t), "
        "z as (select *, total_records - match_count as mismatch_count, "
        "case when qualified_count > 0 then match_qualified_images / qualified_count::double else 0.0 end as match_ratio, "
        "verify_qualified_images / 501.0::double as verify_true_ratio from s) "
    )


_TRIAL_ROUNDED = (
    "select * replace (round(match_ratio, 6) as match_ratio, round(verify_true_ratio, 6) as verify_true_ratio) from z"
)
O["g04_qualified_trials"] = _trials("true") + _TRIAL_ROUNDED
O["g04_qualified_verified_trials"] = _trials("verify") + _TRIAL_ROUNDED
O["g10_verified_beside_match"] = (
    _trials("true") + "select printf('%.2f', match_ratio * 100) as match_ratio_text, "
    "printf('%.2f', verify_true_ratio * 100) as verify_true_ratio_text, verify_true_records from z"
)
O["g05_match_ratio"] = (
    f"{FJ}select file, count(*) as total_records, count(*) filter (where is_scored) as n_scored, "
    "count(*) filter (where is_match) as match_count, count(*) filter (where is_scored and not is_match) as mismatch_count, "
    "round(count(*) filter (where is_match) / count(*)::double, 6) as match_ratio from f3 where not is_trial group by file"
)


def _files(where: str) -> str:
    return (
        f"{FJ}, g as (select file, is_trial, ik, count(*) as n, count(*) filter (where is_scored) as k, "
        "count(*) filter (where is_scored and is_match) as m, count(*) filter (where verify) as v "
        f"from f3 where {where} group by all), "
        "h as (select file, is_trial, cast(sum(n) as bigint) as total_records, cast(sum(k) as bigint) as n_scored, "
        "cast(sum(v) as bigint) as verify_true_count, cast(sum(m) as bigint) as match_count, "
        "count(*) filter (where is_trial and k = 10) as qualified_count, "
        "count(*) filter (where is_trial and k = 10 and m = 10) as match_qualified_images, "
        "count(*) filter (where is_trial and v = 10) as strict from g group by file, is_trial), "
        "w as (select *, case when is_trial then case when qualified_count > 0 then match_qualified_images / qualified_count::double else 0.0 end "
        "else match_count / total_records::double end as ratio from h) "
        "select file, total_records, n_scored, verify_true_count, match_count, qualified_count, match_qualified_images, "
        "n_scored - match_count as mismatch_count, round(ratio, 6) as match_ratio, round(1 - ratio, 6) as mismatch_ratio, "
        "round(case when is_trial then strict / 501.0::double else verify_true_count / total_records::double end, 6) as verify_true_ratio, "
        "case when is_trial then 'DynaMath' else 'Standard' end as type, printf('%.2f', ratio * 100) as match_ratio_text from w"
    )


O["g06_file_summary"] = _files("true")
O["a07_folder_of_result_files"] = _files("not (contains(file, 'filtered_') or contains(file, 'We-Math'))")


def _shards(worst: bool) -> str:
    ok = "cast(verify as int)"
    head = (
        f"{E}, s0 as (select *, ord // 1000 as bt, ord % 1000 as pos from e), "
        "s1 as (select *, count(*) over (partition by bt) as len from s0), "
        f"s2 as (select *, pos // cast(ceil(len / 7.0) as bigint) as sh, {ok} as ok from s1), "
    )
    if worst:
        head += "s3 as (select bt, sh, image, min(ok) as ok, count(*) as n from s2 group by all), "
    else:
        head += "s3 as (select bt, sh, ok, 1 as n from s2), "
    return head + (
        "s4 as (select bt, sh, avg(ok) as acc, sum(n) as n from s3 group by all), "
        "s5 as (select bt, avg(acc) as acc, sum(n) as n from s4 group by bt) "
        "select cast(sum(n) as bigint) as n, count(*) as n_batches, round(sum(acc * n) / sum(n) * 100, 6) as acc from s5"
    )


O["g07_sharded_accuracy"] = _shards(False)
O["g07_sharded_worst_case"] = _shards(True)
O["g07_sharded_per_dataset"] = (
    f"{E}, s as (select dataset, verify, row_number() over (partition by dataset order by ord) - 1 as no from e), "
    "s0 as (select *, no // 1000 as bt, no % 1000 as pos from s), "
    "s1 as (select *, count(*) over (partition by dataset, bt) as len from s0), "
    "s2 as (select dataset, bt, pos // cast(ceil(len / 7.0) as bigint) as sh, cast(verify as int) as ok from s1), "
    "s4 as (select dataset, bt, sh, avg(ok) as acc, count(*) as n from s2 group by all), "
    "s5 as (select dataset, bt, avg(acc) as acc, sum(n) as n from s4 group by all) "
    "select dataset, cast(sum(n) as bigint) as n, count(*) as n_batches, round(sum(acc * n) / sum(n) * 100, 6) as acc from s5 group by dataset"
)
_PER = "per as (select dataset, avg(cast(verify as int)) * 100 as acc, count(*) as n, count(*) filter (where verify) as c from e group by dataset)"
O["g08_mean_accuracy"] = (
    f"{E}, {_PER} select count(*) as n_datasets, round(avg(acc), 6) as macro_acc, "
    "round(sum(c) / sum(n) * 100, 6) as micro_acc from per"
)
O["a11_accuracy_table"] = (
    f"{E}, {_PER}, tb as (select dataset, acc from per union all select 'Mean', avg(acc) from per) "
    "select dataset, round(acc, 6) as acc, printf('%.4f', acc) as acc_text from tb"
)
O["g09_cross_file_summary"] = (
    f"{FJ}select file, count(*) as total_records, count(*) filter (where is_match) as match_count, "
    "count(*) filter (where verify) as verify_true_count from f3 group by grouping sets ((file), ())"
)
O["g11_first_groups"] = (
    f"{R}select image_key, count(*) as n from r group by image_key order by image_key limit 10"
)
O["h05_counts_per_image"] = (
    f"{E}select image_key, count(*) as n, count(*) filter (where verify) as n_match from e group by image_key"
)

# ---------------------------------------------------------------- joins, sets, sorts
O["h01_pairs_by_id"] = (
    "select lang, count(*) as n, round(avg(quality) * 100, 6) as acc, cast(sum(n_chars) as bigint) as n_chars "
    "from documents join labels using (doc_id) group by lang"
)
O["h04_responses_by_id"] = f"{R}select sid, coalesce({_said(1)}, '') as judge_resp from r"
O["u02_split_is_complete"] = (
    f"{FJ}select file, case when is_match then 'match' else 'mismatch' end as part, count(*) as n from f3 group by all"
)
O["t01_running_accuracy"] = (
    f"{E}select dataset, count(*) as n, count(*) filter (where verify) as n_correct, {_ACC} as acc from e group by dataset"
)

_TRIALS = (
    "im as (select dataset, image_key, count(*) as nt, count(*) filter (where verify) as nv from e group by all)"
)
O["t02_running_worst_case"] = (
    f"{E}, {_TRIALS} select dataset, count(*) as n_images, round(avg(case when nv = nt then 100.0 else 0.0 end), 6) as acc, "
    "count(*) filter (where nt = 10) as qualified_count, round(coalesce(cast(count(*) filter (where nt = 10 and nv = 10) as double) "
    "/ nullif(count(*) filter (where nt = 10), 0), 0), 6) as match_ratio, count(*) filter (where nv = 10) as strict_count "
    "from im group by dataset"
)

ORACLES = O
