"""Sets of real numbers written as intervals, unions or inequalities.

``x>2`` and ``(2,\\infty)`` are one set, and so are ``[0,1]\\cup[1,2]`` and ``[0,2]``.  Every
part of a union is read into two ends with a flag each for whether the end belongs to it;
then a sweep over the parts in the order of their lower ends joins what overlaps or touches.
Two sets are equal if the joined parts are.

Read are ``(a,b)`` with either kind of bracket, ``x<a``, ``a<x``, ``a<x<b``, the same with
``<=`` or ``>`` and ``>=``, ``x\\neq a``, the reals, parts joined by ``\\cup`` or "or", and any of
that behind ``x\\in`` or in ``\\{x|...\\}``.  Ends are infinite or expressions without names
(``algebra``); a part that holds nothing is no set but a pair, and has no normal form.
"""

from __future__ import annotations

from .algebra import _let, _q, value_sql

_PART = "struct<lo:double,lc:boolean,hi:double,hc:boolean>"
# a text that may be a set, before anything else is tried
_MAYBE = r"\A(?:[(\[].*,.*[)\]]|.*(?:[<>≤≥≠∪∞ℝ]|\\[lg]eq?|\\cup|\\in|\\neq?|\\mathbb).*)\z"
_SIGNS = (
    (r"\\(?:geqslant|geq|ge)(?![A-Za-z])|>=", "≥"), (r"\\(?:leqslant|leq|le)(?![A-Za-z])|<=", "≤"), (r"\\neq?(?![A-Za-z])|\\not=", "≠"),
    (r"\\infty(?![A-Za-z])", "∞"), (r"\\gt(?![A-Za-z])", ">"), (r"\\lt(?![A-Za-z])", "<"), (r"\\cup(?![A-Za-z])|(?<![A-Za-z])or(?![A-Za-z])|\\(?:lor|vee)(?![A-Za-z])", "∪"),
    (r"\\mathbb\{R\}|ℝ", "(-∞,∞)"),
)
_END = r"([^,<>≤≥≠()\[\]]+|[^,<>≤≥≠\[\]]*\([^,<>≤≥≠\[\]]*\)[^,<>≤≥≠\[\]]*)"
_SHAPES = {
    # pattern: lower end, whether it is closed, upper end, whether it is closed
    rf"\A([(\[]){_END},{_END}([)\]])\z": ("g2", "g1 = '['", "g3", "g4 = ']'"),
    rf"\A{_END}([<≤])[A-Za-z]([<≤]){_END}\z": ("g1", "g2 = '≤'", "g4", "g3 = '≤'"),
    rf"\A{_END}([>≥])[A-Za-z]([>≥]){_END}\z": ("g4", "g3 = '≥'", "g1", "g2 = '≥'"),
    rf"\A[A-Za-z]([>≥]){_END}\z": ("g2", "g1 = '≥'", "'∞'", "false"),
    rf"\A[A-Za-z]([<≤]){_END}\z": ("'-∞'", "false", "g2", "g1 = '≤'"),
    rf"\A{_END}([<≤])[A-Za-z]\z": ("g1", "g2 = '≤'", "'∞'", "false"),
    rf"\A{_END}([>≥])[A-Za-z]\z": ("'-∞'", "false", "g1", "g2 = '≥'"),
}


def _groups(text: str, pattern: str) -> str:
    for i in range(1, 5):
        text = text.replace(f"g{i}", f"regexp_extract(w, {_q(pattern)}, {i})")
    return text


def _plain(x: str) -> str:
    """One sign for each way of writing it; what only wraps the set is dropped."""
    for pattern, sign in _SIGNS:
        x = f"regexp_replace({x}, {_q(pattern)}, '{sign}')"
    x = f"replace({x}, ' ', '')"
    x = rf"regexp_replace({x}, r'\A\\\{{[A-Za-z](?:\||:|\\mid)(.*)\\\}}\z', '$1')"
    return rf"regexp_replace({x}, r'\A[A-Za-z](?:\\in|∈)(?=[(\[])', '')"


def set_sql(x: str) -> str:
    """SQL over a canonical text: its joined parts in order, or null if it is no set."""
    twice = "IF(w RLIKE r'\\A[A-Za-z]≠.+\\z', array(replace(w, '≠', '<'), replace(w, '≠', '>')), array(w))"
    parts = f"flatten(transform(split({_plain(x)}, '∪'), w -> {twice}))"
    ends = " ".join(f"WHEN w RLIKE {_q(p)} THEN array({_groups(lo, p)}, {_groups(hi, p)}, CAST({_groups(lc, p)} AS string), CAST({_groups(hc, p)} AS string))" for p, (lo, lc, hi, hc) in _SHAPES.items())
    read = f"transform({parts}, w -> CASE {ends} END)"
    # an end without names has the same value at all points
    fixed = _let(value_sql("m"), "o", "IF(array_min(o.x) = array_max(o.x) AND size(filter(o.x, u -> u IS NULL)) = 0, round(o.x[0], 9), NULL)")
    value = f"CASE WHEN m IN ('∞', '+∞') THEN double('Infinity') WHEN m = '-∞' THEN double('-Infinity') WHEN m RLIKE r'\\A-?[0-9]+\\z' THEN try_cast(m AS double) ELSE {fixed} END"
    numbers = f"transform({read}, g -> named_struct('e', transform(slice(g, 1, 2), m -> {value}), 'g', g))"
    part = "named_struct('lo', h.e[0], 'lc', h.g[2] = 'true' AND h.e[0] > double('-Infinity'), 'hi', h.e[1], 'hc', h.g[3] = 'true' AND h.e[1] < double('Infinity'))"
    valid = "coalesce(j.lo < j.hi OR j.lo = j.hi AND j.lc AND j.hc, false)"
    # closed lower ends come first among equal ones
    order = "array_sort(j, (a, b) -> CASE WHEN a.lo < b.lo THEN -1 WHEN a.lo > b.lo THEN 1 WHEN a.lc AND NOT b.lc THEN -1 WHEN b.lc AND NOT a.lc THEN 1 ELSE 0 END)"
    last = "element_at(s, -1)"
    touches = f"size(s) > 0 AND (t.lo < {last}.hi OR t.lo = {last}.hi AND (t.lc OR {last}.hc))"
    wider = f"named_struct('lo', {last}.lo, 'lc', {last}.lc, 'hi', greatest({last}.hi, t.hi), 'hc', CASE WHEN {last}.hi > t.hi THEN {last}.hc WHEN {last}.hi < t.hi THEN t.hc ELSE {last}.hc OR t.hc END)"
    swept = f"aggregate({order}, CAST(array() AS array<{_PART}>), (s, t) -> IF({touches}, concat(slice(s, 1, size(s) - 1), array({wider})), concat(s, array(t))))"
    sets = f"transform({numbers}, h -> {part})"
    return _let(sets, "j", f"IF(forall(j, j -> {valid}), {swept}, NULL)")


def same_set_sql(a: str, b: str) -> str:
    """SQL: whether two canonical texts are one set of numbers."""
    worth = f"length({a}) + length({b}) <= 400 AND {a} RLIKE {_q(_MAYBE)} AND {b} RLIKE {_q(_MAYBE)}"
    sets = f"transform(array({a}, {b}), c -> {set_sql('c')})"
    return f"coalesce(IF({worth}, {_let(sets, 'p', 'p[0] = p[1]')}, false), false)"
