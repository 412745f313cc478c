"""The formats of ``formats`` as column expressions, which stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal digits of a limb of a large number. A limb times a factor, with what is carried, fits a long.
LIMB = 9
BASE = 10**LIMB
#: The largest powers of five and of two below ``BASE``.
FIVES, TWOS = 12, 29
#: From this on, and below that, a double's first 18 digits are one quotient of decimals.
NEAR, FAR = 1e-4, 1e15


def _let(name: str, value: str, body: str) -> str:
    """``body`` with a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _times(limbs: str, factor: str) -> str:
    """A number, as limbs from the lowest on, times a factor below ``BASE``."""
    step = _let("t", f"l * {factor} + s.carry", f"named_struct('out', array_append(s.out, t % {BASE}L), 'carry', t div {BASE}L)")
    return f"aggregate({limbs}, named_struct('out', cast(array() as array<bigint>), 'carry', 0L), (s, l) -> {step}, s -> if(s.carry > 0, array_append(s.out, s.carry), s.out))"


def _powers(base: int, most: int, exponent: str) -> str:
    """Factors whose product is ``base`` to the exponent, none above ``base ** most``."""
    return f"array_append(array_repeat({base**most}L, cast(({exponent}) div {most} as int)), cast(pow({base}D, ({exponent}) % {most}) as bigint))"


def _exact(x: str) -> str:
    """(digits, point) of a positive double: all its decimal digits, of which ``point`` are behind the point.

    A double is m / 2**k with integers, and for a positive k that is m * 5**k / 10**k. ``k`` is larger than it need be,
    so that a logarithm that is off by one does no harm; scaling by powers of two is exact."""
    m = f"cast({x} * pow(2D, least(k, 1000)) * pow(2D, k - least(k, 1000)) as bigint)"
    factors = f"if(k > 0, {_powers(5, FIVES, 'k')}, {_powers(2, TWOS, '-k')})"
    limbs = _let("m", m, f"aggregate({factors}, array(m % {BASE}L, m div {BASE}L), (n, f) -> {_times('n', 'f')})")
    text = f"array_join(reverse(transform({limbs}, d -> lpad(cast(d as string), {LIMB}, '0'))), '')"
    return _let("k", f"54 - cast(floor(log2({x})) as int)", f"named_struct('digits', trim(leading '0' from {text}), 'point', greatest(k, 0))")


def _rounded(e: str, digits: int) -> str:
    """(text, power): the leading ``digits`` digits without trailing zeros, ties to even, and the power of ten of the first."""
    head, rest = f"substring({e}.digits, 1, {digits})", f"substring({e}.digits, {digits + 1})"
    up = f"case when {rest} = '' then 0 when {rest} > h then 1 when {rest} = h and cast({head} as bigint) % 2 = 1 then 1 else 0 end"
    grown = _let("h", f"rpad('5', length({rest}), '0')", f"cast(cast({head} as bigint) + {up} as string)")
    return _let("w", grown, f"named_struct('text', trim(trailing '0' from w), 'power', length({e}.digits) - 1 - {e}.point + length(w) - length({head}))")


def _written(text: str, power: str, digits: int) -> str:
    fraction = f"if(length({text}) > 1, concat('.', substring({text}, 2)), '')"
    raised = f"concat(substring({text}, 1, 1), {fraction}, if({power} < 0, 'e-', 'e+'), if(abs({power}) < 10, '0', ''), cast(abs({power}) as string))"
    below = f"concat('0.', repeat('0', -{power} - 1), {text})"
    mixed = f"concat(substring({text}, 1, {power} + 1), '.', substring({text}, {power} + 2))"
    return f"case when {power} < -4 or {power} >= {digits} then {raised} when {power} < 0 then {below} when length({text}) <= {power} + 1 then rpad({text}, {power} + 1, '0') else {mixed} end"


def _g(x: str, digits: int) -> str:
    size = _let("a", "abs(v)", _let("e", _exact("a"), _let("r", _rounded("e", digits), _written("r.text", "r.power", digits))))
    plain = f"case when v = 0 then '0' when abs(v) = double('inf') then 'inf' else {size} end"
    return _let("v", f"cast({x} as double)", f"case when v is null then null when isnan(v) then 'nan' else concat(if(cast(v as string) like '-%', '-', ''), {plain}) end")


def g_name(column: str, digits: int) -> str:
    return f"_g{digits} {column}"


def with_g(df: DataFrame, numbers: Iterable[tuple[str, int]]) -> DataFrame:
    """Adds each column's text with so many digits, as C's ``%.*g`` writes it from the exact value, under the name
    ``g_name(column, digits)``; null stays null.

    Doubles from ``NEAR`` to ``FAR`` are m / 2**k with m * 10**p below 10**38, so that their first 18 or 19 digits are a
    quotient of decimals; the steps are projections, which Spark compiles. Large numbers in limbs have the rest."""
    asked = list(dict.fromkeys(numbers))
    names = {n for n, _ in asked}

    def add(df: DataFrame, step: str, sql: str) -> DataFrame:
        """A column for each number, in whose expression ``{a}`` stands for its column of step a."""
        return df.withColumns({f"_{step} {n}": F.expr(sql.format(x=f"`{n}`", **{s: f"`_{s} {n}`" for s in "akpmdq"})) for n in names})

    out = add(df, "a", "abs(cast({x} as double))")
    out = add(out, "k", f"case when {{a}} >= {NEAR!r}D and {{a}} < {FAR!r}D then 54 - cast(floor(log2({{a}})) as int) end")
    out = add(out, "p", "case when {k} is not null then 17 - cast(floor(log10({a})) as int) end")
    out = add(out, "m", "cast(cast({a} * pow(2D, {k}) as bigint) as decimal(17,0)) * cast(rpad('1', {p} + 1, '0') as decimal(22,0))")
    two = "cast(cast(pow(2D, {}) as bigint) as decimal(11,0))"
    out = add(out, "d", f"{two.format('{k} div 2')} * {two.format('{k} - {k} div 2')}")
    out = add(out, "q", "{m} div {d}")
    for i, (name, digits) in enumerate(asked):
        shown, q, c, r, t, w = max(1, digits), f"`_q {name}`", f"_c{i}", f"_r{i}", f"_t{i}", f"_w{i}"
        out = out.withColumn(c, F.expr(f"if({q} >= {10**18}, {10 ** (19 - shown)}L, {10 ** (18 - shown)}L)"))
        rest, head = f"({q} % {c})", f"{q} div {c}"
        more = f"(`_m {name}` % `_d {name}` > 0 or ({head}) % 2 = 1)"
        out = out.withColumn(r, F.expr(f"case when {q} >= {10**17} then cast({head} + if({rest} > {c} - {rest} or ({rest} = {c} - {rest} and {more}), 1, 0) as string) end"))
        out = out.withColumns({t: F.expr(f"trim(trailing '0' from {r})"), w: F.expr(f"if({q} >= {10**18}, 19, 18) - 1 - `_p {name}` + length({r}) - {shown}")})
        near = f"concat(if(`{name}` < 0, '-', ''), {_written(t, w, shown)})"
        out = out.withColumn(g_name(name, digits), F.expr(f"case when {r} is not null then {near} else {_g(f'`{name}`', shown)} end")).drop(c, r, t, w)
    return out.drop(*(f"_{step} {n}" for n in names for step in "akpmdq"))


def _replaced(text: Column, pairs: dict[str, str]) -> Column:
    """Each key replaced by its value, one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def _quoted(text: Column, controls: dict[str, str]) -> Column:
    plain = _replaced(text, {"\\": "\\\\", '"': '\\"'})
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), _replaced(plain, controls)).otherwise(plain), F.lit('"'))


def json_string(text: Column) -> Column:
    named = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    return _quoted(text, {c: named.get(c, f"\\u{ord(c):04x}") for c in map(chr, range(32))})


def script_string(text: Column) -> Column:
    return F.replace(json_string(text), F.lit("<"), F.lit("\\u003c"))


def dot_string(text: Column) -> Column:
    named = {"\t": "\\t", "\n": "\\n", "\r": "\\r"}
    return _quoted(text, {c: named.get(c, f"\\x{ord(c):02x}") for c in map(chr, range(32))})


def markdown(text: Column) -> Column:
    return _replaced(text, {"\\": "\\\\", "|": "\\|", "\r": " ", "\n": " "})


def html(text: Column) -> Column:
    return _replaced(text, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})


def tex(text: Column) -> Column:
    """Special characters get a backslash, and those that need a name get it after that."""
    marked = F.regexp_replace(text, r"([\\{}$&#_%~^])", r"\\$1")
    return _replaced(marked, {"\\\\": r"\textbackslash{}", r"\~": r"\textasciitilde{}", r"\^": r"\textasciicircum{}", "\r": " ", "\n": " "})
