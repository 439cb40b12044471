"""Values of algebraic expressions, to tell whether two of them are the same function.

An expression is read in three steps, each a fold over arrays inside one SQL expression:

1. Tokens: numbers, names, LaTeX commands, operators and brackets.
2. Postfix order, by an operator stack: precedence decides what leaves the stack, brackets
   and the two groups of a fraction wait on it, and operands side by side are multiplied.
3. A stack machine computes values at fixed points.  With ``+ - * /`` and whole powers a
   value is a fraction modulo each of two primes, so nothing is rounded: two functions that
   differ agree there only by a chance of about one in 2^60 for each degree.  Roots,
   logarithms, trigonometry and other powers have values as doubles at three points, where
   names are positive, which decide when either side has no fraction.

Read are sums, products, quotients, powers, ``\\frac``, ``\\sqrt`` also with an index,
named functions, pi, e and names of one letter with or without an index.  ``y = ...`` and
``f(x) = ...`` count as their right side.  Anything else, words above all, has no value:
comparing them is left to their text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PRIMES = (2147483647, 2147483629)
POINTS = 3
MOST_TOKENS = 200  # longer texts are no short answers and are compared as text
MOST_POWER = 4096  # whole powers above it have doubles only
CLOSE = 1e-9

_FUNCTIONS = {
    "sqrt": "sqrt(u)", "sin": "sin(u)", "cos": "cos(u)", "tan": "tan(u)", "cot": "cot(u)", "sec": "sec(u)", "csc": "csc(u)",
    "arcsin": "asin(u)", "arccos": "acos(u)", "arctan": "atan(u)", "sinh": "sinh(u)", "cosh": "cosh(u)", "tanh": "tanh(u)",
    "ln": "ln(u)", "log": "log10(u)", "lg": "log10(u)", "exp": "exp(u)",
}
_NAME = r"[A-Za-zα-ωΑ-Ω](?:_(?:[A-Za-z0-9]|\{[A-Za-z0-9]{1,8}\}))?"
_GREEK = "alpha|beta|gamma|delta|epsilon|theta|lambda|mu|rho|sigma|phi|omega|varphi|tau|xi|eta|zeta|kappa|nu|psi|chi"
_TOKEN = r"[0-9]+(?:\.[0-9]+)?|\.[0-9]+|\\(?:[A-Za-z]+)|" + _NAME + r"|[-+*/^()\[\]{}·×÷−]"
_ASSIGNED = r"\A(?:[A-Za-z]|[A-Za-z]\([A-Za-z]\)|[A-Za-z]_(?:[A-Za-z0-9]|\{[A-Za-z0-9]+\}))="
# a text worth reading: no word, some operator, command or bracketed group
_WORTH = r"\A(?!.*(?<![\\A-Za-z])[A-Za-z]{4})(?=.*[-+*/^0-9(\\·×])[^,;:=<>!?%&|~#\x22\x27]*\z"
_WORD = r"(?<![\\A-Za-z])[A-Za-z]{2,3}(?![A-Za-z])"
_STRONG = r"[+*/^0-9\\]"
_LETTER = r"\A[A-Za-z]\z"
_STRONG_OR_SIGN = r"[-+*/^\\·×_]|[0-9)][A-Za-z(]"
_FOREIGN = r"\A\z|[,;:<>!?%&|~#\x22\x27]|[A-Za-z]{9}"


def _in(x: str, *values: str) -> str:
    return f"{x} IN ({', '.join(_q(v) for v in values)})"


def _q(text: str) -> str:
    return f"r'{text}'"


# One name for each way of writing an operator; commands lose their backslash.
_SAME = {r"\cdot": "*", r"\times": "*", "·": "*", "×": "*", r"\div": "/", "÷": "/", "−": "-", "π": r"\pi", r"\lbrack": "[", r"\rbrack": "]"}


# Kinds of tokens: o opens, c closes, s sum, m product, p power, q fraction; n number, v name, f function, x unknown.
_KINDS = {"(": "o", "[": "o", "{": "o", ")": "c", "]": "c", "}": "c", "+": "s", "-": "s", "*": "m", "/": "m", "^": "p", r"\frac": "q"}


def _tokens(x: str) -> str:
    """SQL: tokens of x with their kinds, or null if some of x is no token."""
    plain = f"replace({x}, ' ', '')"
    found = f"transform(array(regexp_extract_all({x}, {_q(_TOKEN)}, 0)), w -> IF(array_join(w, '') = {plain} AND size(w) BETWEEN 1 AND {MOST_TOKENS}, w, NULL))[0]"
    cases = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in _SAME.items())
    kind = (
        rf"CASE WHEN t RLIKE '^[0-9.]' THEN 'n' WHEN left(t, 1) <> r'\' AND NOT {_in('t', *_KINDS)} THEN 'v' "
        + " ".join(f"WHEN t = {_q(t)} THEN '{k}'" for t, k in _KINDS.items())
        + rf" WHEN {_in('t', *[chr(92) + f for f in _FUNCTIONS])} THEN 'f' WHEN t RLIKE r'\A\\(?:pi|{_GREEK})\z' THEN 'v' ELSE 'x' END"
    )
    return f"transform(transform({found}, t -> CASE t {cases} ELSE t END), t -> named_struct('k', {kind}, 't', t))"


# ------------------------------------------------------------------ postfix order
# An entry of the operator stack is its precedence and its name.  0 waits for a bracket
# or a group: (, [, {, and F2, F1 for a fraction that lacks two or one of its groups.
# 1 sums, 2 products and minus signs, 3 functions, 4 products inside a function's operand,
# 5 powers.  Operators in the output are marked with !.
_STATE = "struct<out:array<string>,ops:array<string>,full:boolean,ok:boolean>"
_OPEN = {")": "0(", "]": "0[", "}": "0{"}


def _postfix(tokens: str) -> str:
    """SQL: operands and operators in postfix order, or null.

    A step moves operators down to some level to the output, then adds to both.  ``full``:
    an operand has just ended, so that another one that begins is multiplied with it.
    """
    function, operand, closes, signs, times = "(y.k = 'f')", "(y.k = 'v' OR y.k = 'n')", "(y.k = 'c')", "(y.k = 's')", "(y.k = 'm')"
    beside = "(s.full AND y.k IN ('v', 'n', 'f', 'o', 'q'))"
    top = "coalesce(try_element_at(s.ops, -1), '')"
    inner = f"IF(left({top}, 1) IN ('3', '4') AND NOT {function}, '4', '2')"
    level = f"CASE WHEN {beside} THEN {inner} WHEN {signs} AND s.full OR {closes} THEN '1' WHEN {times} THEN '2' ELSE '9' END"
    keep = f"transform(array({level}), l -> array_max(concat(array(0), transform(s.ops, (o, i) -> IF(left(o, 1) < l OR l = '9', i + 1, 0)))))[0]"
    pushed = (
        f"concat(slice(s.ops, 1, k), IF({beside}, array(concat({inner}, '*')), array()), "
        f"CASE WHEN {signs} THEN IF(s.full, array(concat('1', y.t)), IF(y.t = '-', array('2~'), array())) WHEN {times} THEN array(concat('2', y.t)) "
        f"WHEN y.k = 'p' THEN array('5^') WHEN y.k = 'o' THEN array(concat('0', y.t)) "
        f"WHEN y.k = 'q' THEN array('0F2') WHEN {function} THEN array(concat('3', substr(y.t, 2))) ELSE array() END)"
    )
    # below: what waits for the bracket that closes
    turn = "(below = '3sqrt' AND y.t = ']')"
    left = f"concat(slice(s.ops, 1, greatest(k - 2, 0)), CASE WHEN below = '0F2' THEN array('0F1') WHEN {turn} THEN array('3root') WHEN below = '' OR below = '0F1' OR left(below, 1) = '3' THEN array() ELSE array(below) END)"
    done = f"CASE WHEN below = '0F1' THEN array('!/') WHEN left(below, 1) = '3' AND NOT {turn} THEN array(concat('!', substr(below, 2))) ELSE array() END"
    opener = "CASE y.t " + " ".join(f"WHEN {_q(c)} THEN {_q(o)}" for c, o in _OPEN.items()) + " END"
    moved = "transform(reverse(slice(s.ops, k + 1, 1000)), o -> concat('!', substr(o, 2)))"
    # a number behind an operand is no product, nor one before a fraction, which may be mixed
    number = "y.k = 'n'"
    bad = (
        f"y.k = 'x' OR s.full AND {number} OR NOT s.full AND ({closes} OR {times} OR y.k = 'p') OR {closes} AND NOT coalesce(try_element_at(s.ops, k) = {opener}, false) "
        "OR y.k = 'q' AND s.full AND coalesce(try_element_at(s.out, -1), '') RLIKE '^[0-9]'"
    )
    step = (
        f"named_struct('out', concat(s.out, {moved}, CASE WHEN {operand} THEN array(y.t) WHEN {closes} THEN {done} ELSE array() END), "
        f"'ops', IF({closes}, {left}, {pushed}), 'full', {operand} OR {closes} AND NOT (below = '0F2' OR {turn}), 'ok', NOT ({bad}))"
    )
    step = _let(keep, "k", _let("IF(k > 1, coalesce(try_element_at(s.ops, k - 1), ''), '')", "below", step))
    start = f"CAST(named_struct('out', array(), 'ops', array(), 'full', false, 'ok', true) AS {_STATE})"
    rest = "transform(reverse(s.ops), o -> concat('!', substr(o, 2)))"
    end = f"IF(s.ok AND s.full AND NOT exists(s.ops, o -> left(o, 1) = '0'), concat(s.out, {rest}), NULL)"
    return f"aggregate({tokens}, {start}, (s, y) -> IF(s.ok, {step}, s), s -> {end})"


# ------------------------------------------------------------------ stack machine
# A value: a fraction modulo each prime p (null parts: none), and doubles.
_VALUE = "struct<r:array<struct<n:bigint,d:bigint,p:bigint>>,x:array<double>>"


def _doubles() -> str:
    """Doubles of two values, or of one (v); what is no number is null."""
    binary = {"+": "u + v", "-": "u - v", "*": "u * v", "/": "try_divide(u, v)", "^": "pow(u, v)", "root": "pow(v, try_divide(1D, u))", "~": "-v"}
    cases = " ".join(f"WHEN {_q('!' + o)} THEN {body}" for o, body in (binary | {f: b.replace("u", "v") if b != "u" else b for f, b in _FUNCTIONS.items()}).items())
    return f"zip_with(coalesce(a.x, b.x), b.x, (u, v) -> {_let(f'CASE t {cases} END', 'w', 'IF(isnan(w) OR abs(w) > 1e300D, NULL, w)')})"


def _residues() -> str:
    """Fractions of two values, or of one (g), modulo g.p."""
    # whole powers bit by bit; e is null for any other
    bits = MOST_POWER.bit_length()
    one, part = "CAST(1 AS bigint)", "IF(shiftright(abs(e), i) % 2 = 1, z.{0} * z.{1} % g.p, z.{0})"
    step = f"named_struct('n', {part.format('n', 'b')}, 'd', {part.format('d', 'c')}, 'b', z.b * z.b % g.p, 'c', z.c * z.c % g.p)"
    power = f"aggregate(sequence(0, {bits - 1}), named_struct('n', {one}, 'd', {one}, 'b', IF(e < 0, f.d, f.n), 'c', IF(e < 0, f.n, f.d)), (z, i) -> {step})"
    n = "CASE t WHEN '!+' THEN (f.n * g.d % g.p + g.n * f.d % g.p) % g.p WHEN '!-' THEN pmod(f.n * g.d % g.p - g.n * f.d % g.p, g.p) WHEN '!*' THEN f.n * g.n % g.p WHEN '!/' THEN f.n * g.d % g.p WHEN '!~' THEN pmod(-g.n, g.p) WHEN '!^' THEN h.n END"
    d = "CASE WHEN t IN ('!+', '!-', '!*') THEN f.d * g.d % g.p WHEN t = '!/' THEN f.d * g.n % g.p WHEN t = '!~' THEN g.d WHEN t = '!^' THEN h.d END"
    raised = _let(f"IF(t = '!^' AND e IS NOT NULL, {power}, NULL)", "h", f"named_struct('n', {n}, 'd', {d}, 'p', g.p)")
    whole = f"IF(array_min(b.x) = array_max(b.x) AND b.r[0].n IS NOT NULL AND b.x[0] = round(b.x[0]) AND abs(b.x[0]) <= {MOST_POWER}, CAST(b.x[0] AS int), NULL)"
    return _let(whole, "e", f"zip_with(coalesce(a.r, b.r), b.r, (f, g) -> {raised})")


def _operand(t: str) -> str:
    """A number as a fraction over a power of ten; a name as fixed random values."""
    digits, places = f"replace({t}, '.', '')", f"IF(contains({t}, '.'), length(substring_index({t}, '.', -1)), 0)"
    primes = f"array({', '.join(map(str, PRIMES))})"
    fraction = f"named_struct('n', CAST(try_cast({digits} AS decimal(38,0)) % p AS bigint), 'd', CAST(try_cast(rpad('1', {places} + 1, '0') AS decimal(38,0)) % p AS bigint), 'p', CAST(p AS bigint))"
    number = f"named_struct('r', transform({primes}, p -> {fraction}), 'x', array_repeat(try_cast({t} AS double), {POINTS}))"
    drawn = f"transform(sequence(1, {POINTS}), k -> 0.5D + pmod(xxhash64({t}, k), 1000003) / 500001.5D)"
    constants = "".join(f"WHEN {_q(c)} THEN array_repeat({v}, {POINTS}) " for c, v in ((r"\pi", "pi()"), ("e", "e()")))
    residue = f"named_struct('n', pmod(xxhash64({t}, 'residue', p), p), 'd', CAST(1 AS bigint), 'p', CAST(p AS bigint))"
    name = f"named_struct('r', transform({primes}, p -> {residue}), 'x', CASE {t} {constants} ELSE {drawn} END)"
    return f"IF({t} RLIKE '^[0-9.]', {number}, {name})"


def _computed(postfix: str) -> str:
    """SQL: value of a postfix array, or null; division by zero has none."""
    binary = _in("t", *[f"!{o}" for o in ("+", "-", "*", "/", "^", "root")])
    value = _let(f"IF({binary}, element_at(s, -2), NULL)", "a", _let("element_at(s, -1)", "b", f"named_struct('r', {_residues()}, 'x', {_doubles()})"))
    step = (
        f"CASE WHEN s IS NULL OR {binary} AND size(s) < 2 THEN NULL WHEN left(t, 1) <> '!' THEN concat(s, array({_operand('t')})) "
        f"ELSE concat(slice(s, 1, size(s) - IF({binary}, 2, 1)), array({value})) END"
    )
    return f"aggregate({postfix}, CAST(array() AS array<{_VALUE}>), (s, t) -> {step}, s -> IF(size(s) = 1, s[0], NULL))"


def _let(value: str, name: str, body: str) -> str:
    return f"aggregate(array(), {value}, ({name}, unused) -> {name}, {name} -> {body})"


def value_sql(x: str) -> str:
    """SQL over a canonical text: its value, or null if it is no expression."""
    right = f"regexp_replace({x}, {_q(_ASSIGNED)}, '')"
    # letters in pairs or threes are a product only beside an operator that words lack
    worth = f"length(y) <= 400 AND (y RLIKE {_q(_WORTH)} AND (NOT y RLIKE {_q(_WORD)} OR y RLIKE {_q(_STRONG)}) OR y RLIKE {_q(_LETTER)})"
    value = _let(_tokens("y"), "k", _let(_postfix("k"), "k", _computed("k")))
    return _let(right, "y", f"IF({worth}, {value}, NULL)")


def expression_value(canonical: Column) -> Column:
    """struct<r, x> of a canonical answer text, null if it is no expression."""
    return F.get(F.call_function("transform", F.array(canonical), F.expr(f"c -> {value_sql('c')}")), F.lit(0))


def same_sql(a: str, b: str) -> str:
    """SQL: whether two values are those of one function; null values are not."""
    exact = f"zip_with({a}.r, {b}.r, (f, g) -> IF(f.d <> 0 AND g.d <> 0, f.n * g.d % f.p = g.n * f.d % f.p, NULL))"
    near = f"zip_with({a}.x, {b}.x, (u, v) -> abs(u - v) <= {CLOSE}D * greatest(abs(u), abs(v)) + 1e-12D)"
    # residues decide if both sides have them; else two doubles at least
    doubles = _let(near, "z", "NOT array_contains(z, false) AND size(filter(z, w -> w IS NOT NULL)) >= 2")
    return f"coalesce({_let(exact, 'z', f'IF(exists(z, w -> w IS NULL), {doubles}, forall(z, w -> w))')}, false)"


def same_function_sql(a: str, b: str) -> str:
    """SQL: whether two canonical texts are one function; read only if one has an operator."""
    worth = f"length({a}) + length({b}) <= 800 AND ({a} RLIKE {_q(_STRONG_OR_SIGN)} OR {b} RLIKE {_q(_STRONG_OR_SIGN)}) AND NOT {a} RLIKE {_q(_FOREIGN)} AND NOT {b} RLIKE {_q(_FOREIGN)}"
    values = f"transform(array({a}, {b}), c -> {value_sql('c')})"
    return f"coalesce(IF({worth}, {_let(values, 'p', same_sql('p[0]', 'p[1]'))}, false), false)"
