"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``filter_quality`` estimates each rule's cost (seconds over a sample of about
``SAMPLE_ROWS`` rows, drawn with a share of their number and dealt to ``SAMPLE_TASKS`` tasks) and selectivity (the share it rejects), orders the rules by rejection per
cost, and evaluates them in one ``CASE`` that stops at the first rule that rejects. The order decides how much is
computed, never the verdict.

Everything is computed inside a row: words, their 3-word windows as 64-bit
hashes, and, only where two hashes of a text are equal, the sorted windows whose
equal neighbours give the repeated ones. Nothing is shuffled.

Defined results: a null or empty text has no word and fails the base rules;
texts of any length are read whole; equal rows get equal results; further
columns are kept, but for those with the name of a result, which the result replaces. Two different windows of one text count as equal if their 64-bit
hashes are, with a chance under 1e-11 for a text of 20,000 words.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import table, text_column

#: Rows of the sample on which costs and selectivities are estimated (expected: each row is drawn on its
#: own), the tasks that share it, and how often a rule is evaluated on each row in the job that is timed: so
#: often that what the job itself costs is small beside it.
SAMPLE_ROWS, SAMPLE_TASKS, REPEATS = 512, 8, 64
SEED = 7

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# White space, and the characters that count as symbols.
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"


def rules() -> dict[str, str]:
    """What rejects a text that passed the base rules: SQL conditions on the text
    ``t`` and its base measures ``m``."""
    return {
        "symbols": "m.n_symbols * 100 > 3 * m.word_chars",
        "duplicate_lines": r"m.n_dup_lines * 100 > 40 * (regexp_count(t, '\n') + 1)",
        "word_length": "m.word_chars < 2 * m.n_words or m.word_chars > 14 * m.n_words",
        "exclamations": "regexp_count(t, '!') * 2 > m.n_words",
        "capitals": r"regexp_count(t, '\\p{Lu}') * 10 > 4 * m.word_chars",
        "digits": "regexp_count(t, '[0-9]') * 10 > 4 * length(t)",
    }


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once wherever
    the optimiser moves the expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def measures(body: str = "m") -> str:
    """SQL for ``body`` with the base measures ``m`` of the text ``t``."""
    word, symbol = (x.replace("\\", "\\\\") for x in (WORD, SYMBOL))
    struct = f"""named_struct(
        'n_words', cast(size(w) as long),
        'word_chars', cast(length(array_join(w, '')) as long),
        'n_symbols', cast(if(t rlike '{symbol}', regexp_count(t, '{symbol}'), 0) as long),
        'n_dup_lines', {let("l", f"filter(split(t, '\\n'), x -> x rlike '{word}')", "cast(size(l) - size(array_distinct(l)) as long)")},
        'n_repeat_words', cast(aggregate(p, named_struct('n', 0L, 'last', -3),
            (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n) as long))"""
    # a repeated window covers three words, or as many as lie after the one before it
    windows = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))"
    placed = "if(size(array_distinct(g)) < size(g), sort_array(transform(g, (h, i) -> named_struct('h', h, 'i', i))), cast(array() as array<struct<h: bigint, i: int>>))"
    repeated = "sort_array(transform(filter(s, (x, k) -> coalesce(x.h = get(s, k - 1).h, false) or coalesce(x.h = get(s, k + 1).h, false)), x -> x.i))"
    found = let("m", struct, body)
    for name, value in (("p", repeated), ("s", placed), ("g", windows), ("w", f"regexp_extract_all(t, '{word}', 0)")):
        found = let(name, value, found)
    return found


def base_failed() -> str:
    return f"(m.n_words < {MIN_WORDS} or 100 * m.n_repeat_words > {MAX_REPEAT_PERCENT} * m.n_words)"


def with_verdict(df: DataFrame, order: Iterable[str], named: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with the base measures (long), ``base_failed`` and ``kept``: false if
    the base rules or any rule rejects, tried in order."""
    named = named or rules()
    tried = "".join(f" when coalesce({named[x]}, false) then false" for x in order)
    verdict = f"case when {base_failed()} then false{tried} else true end"
    whole = let("t", "_q_text", measures(f"named_struct('m', m, 'base_failed', {base_failed()}, 'kept', {verdict})"))
    text, found = (_unused(df, name) for name in ("_q_text", "_q"))
    out = df.withColumn(text, text_column(text_col)).withColumn(found, F.expr(whole.replace("_q_text", f"`{text}`")))
    results = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in results]
    return out.select(*rest, f"{found}.m.*", f"{found}.base_failed", f"{found}.kept")


def _unused(df: DataFrame, name: str) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def estimate(sample: DataFrame, named: dict[str, str]) -> dict[str, tuple[float, float]]:
    """(seconds, share rejected) of each rule over the rows (t, m) of a sample."""
    n = max(1, sample.count())
    again = sample.select("t", "m", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("again"))

    def timed(rejects: str) -> tuple[float, float]:
        began = time.perf_counter()
        rejected = again.select(F.expr(f"coalesce(sum(cast({rejects} as int)), 0)").alias("n")).first()["n"]
        return time.perf_counter() - began, rejected / REPEATS

    timed("again < 0")  # compiles what all have in common
    idle = timed("again < 0")[0]
    return {name: (max(1e-4, seconds - idle), rejected / n) for name, rule in named.items() for seconds, rejected in [timed(rule)]}


def by_rejection(costs: dict[str, tuple[float, float]]) -> list[str]:
    """Names by rejection per cost, highest first."""
    return sorted(costs, key=lambda x: (-costs[x][1] / costs[x][0], costs[x][0], x))


def sampled(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(t, m) of about ``SAMPLE_ROWS`` rows, whatever their ids; only these leave their partitions."""
    share = min(1.0, SAMPLE_ROWS / max(1, df.count()))
    return df.select(text_column(text_col).alias("t")).sample(share, SEED).withColumn("m", F.expr(measures())).repartition(SAMPLE_TASKS)


def filter_quality(df: DataFrame, text_col: str = "text", named: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the base measures, ``base_failed`` and ``kept``; the order of the
    rules is learned on those of a sample that pass the base rules."""
    named = named or rules()
    sample = sampled(df, text_col).cache()
    order = by_rejection(estimate(sample.filter(f"not {base_failed()}"), named))
    sample.unpersist()
    return with_verdict(df, order, named, text_col)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), m as (
  select doc_id, t, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as g
  from d
), x as (
  select doc_id, unnest(g) as g, unnest(range(1, len(g) + 1)) as i from m
), r as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from x) where c > 1
), c as (
  select doc_id, count(distinct i + o) as n from r cross join (select unnest([0, 1, 2]) as o) group by doc_id
), a as (
  select m.*, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from m left join c using (doc_id)
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not (base_failed or n_symbols * 100 > 3 * word_chars
            or n_dup_lines * 100 > 40 * (len(regexp_extract_all(t, '\n')) + 1)
            or word_chars < 2 * n_words or word_chars > 14 * n_words
            or len(regexp_extract_all(t, '!')) * 2 > n_words
            or len(regexp_extract_all(t, '\p{Lu}')) * 10 > 4 * word_chars
            or len(regexp_extract_all(t, '[0-9]')) * 10 > 4 * length(t)) as kept
from b
"""
