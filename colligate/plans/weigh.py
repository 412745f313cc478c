"""From pairs to weighted edges: global and local statistics, scores and Z scores.

df, idf and gdf are global; with a key, ctf, cdf and fq are local to the units with a
pair that has a pattern matching it. Counts are distinct units, whatever the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligate.errors import OptionError
from colligate.functions.ere import to_java
from colligate.functions.tokens import DEFAULT_FIELDS, fields as fields_of, project, projected
from colligate.operators.pairs import behind, counted, let, run_counts
from colligate.sinks.store import numbered, stored

METHODS = (1, 7, 12, 16)
KEYED = (7, 12)
#: Patterns, at most, whose pairs are counted before they are shuffled: those with more than this share of all units' patterns.
OFTEN = 10_000
NO_FREQUENCIES = "the key's patterns have no frequencies"
EDGE_COLUMNS = ["token1", "token2", "ctf", "cdf", "df1", "idf1", "fq1", "df2", "idf2", "fq2", "cw", "z"]


@dataclass(frozen=True)
class Corpus:
    """What a corpus' pairs say: rows (unit_id, pattern, token, ord, cnt) of tokens, rows
    (unit_id, pattern1, pattern2, ord) of pairs, both once per unit, and the number of units.

    Of units, ``patterns`` has rows (ord, unit_id, p, tokens) with their different patterns, so that a key's
    units are known, and combined, before any pair is made. Where each unit is one row, these are a table in the shared
    folder, whose tokens are counted and have their patterns; a token's ``first`` says whether it is the first one of its
    pattern in its unit, and a key is looked for in each row, so that nothing is joined."""

    tokens: DataFrame
    pairs: DataFrame
    units: DataFrame  # one row: n
    patterns: DataFrame | None = None
    one_row: bool = False
    fields: Sequence[int] = DEFAULT_FIELDS


def corpus(pairs: DataFrame, fields: Sequence[int] = DEFAULT_FIELDS) -> Corpus:
    """Of pair rows (ord, unit_id, token1, token2, fq1, fq2)."""
    ends = pairs.select("ord", "unit_id", F.explode(F.array(F.struct(F.col("token1").alias("t"), F.col("fq1").alias("c")), F.struct(F.col("token2").alias("t"), F.col("fq2").alias("c")))).alias("e"))
    seen = ends.groupBy("unit_id", F.col("e.t").alias("token")).agg(F.min("ord").alias("ord"), F.min_by("e.c", "ord").alias("cnt"))
    tokens = seen.withColumn("pattern", project(F.col("token"), fields))
    sides = pairs.select("ord", "unit_id", project(F.col("token1"), fields).alias("p"), project(F.col("token2"), fields).alias("q"))
    both = sides.filter("p <> q").groupBy("unit_id", F.least("p", "q").alias("pattern1"), F.greatest("p", "q").alias("pattern2")).agg(F.min("ord").alias("ord"))
    return Corpus(tokens, both, pairs.agg(F.countDistinct("unit_id").alias("n")))


def corpus_of_units(units: DataFrame, fields: Sequence[int] = DEFAULT_FIELDS, one_row: bool = False) -> Corpus:
    """The same of units (ord, unit_id, tokens), for pairs of different tokens in any order, without
    making raw pairs: patterns are combined once per row. With ``one_row`` a unit id has one row
    only (as ``units_from_table`` makes them), so that nothing need be told apart by unit ids."""
    rows = units.filter(F.size(F.array_distinct("tokens")) > 1)
    if one_row:
        # statistics, pairs and the number of units all read it, so that units are put together and their tokens sorted once
        listed = rows.select("ord", "unit_id", _by_pattern(F.col("tokens"), fields).alias("tokens"))
        patterns = stored(listed.select("ord", "unit_id", F.array_distinct("tokens.pattern").alias("p"), "tokens"), "units")
        return Corpus(_token_rows(patterns), combined(patterns, True), patterns.agg(F.count("*").alias("n")), patterns, True, fields)
    patterns = rows.select("ord", "unit_id", F.array_sort(F.array_distinct(F.transform("tokens", lambda t: project(t, fields)))).alias("p"), "tokens")
    seen = rows.select("ord", "unit_id", F.explode(counted(F.col("tokens"))).alias("e")).select("ord", "unit_id", F.col("e.t").alias("token"), F.col("e.c").alias("cnt"))
    seen = seen.groupBy("unit_id", "token").agg(F.min("ord").alias("ord"), F.min_by("cnt", "ord").alias("cnt")).withColumn("pattern", project(F.col("token"), fields))
    return Corpus(seen, combined(patterns, False), rows.agg(F.countDistinct("unit_id").alias("n")), patterns, False, fields)


def _by_pattern(tokens: Column, fields: Sequence[int]) -> Column:
    """The different tokens (pattern, token, cnt) sorted by pattern, so that each pattern has a first one."""
    pattern = lambda t: let(fields_of(t), lambda parts: projected(parts, t, fields))
    return F.array_sort(F.transform(counted(tokens), lambda x: F.struct(pattern(x["t"]).alias("pattern"), x["t"].alias("token"), x["c"].alias("cnt"))))


def _token_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """(ord, unit_id, pattern, token, cnt, first) and the columns ``keep`` of units whose tokens are sorted by pattern."""
    each = rows.select("ord", "unit_id", *keep, "tokens", F.posexplode("tokens").alias("_i", "e"))
    first = (F.col("_i") == 0) | (F.get("tokens", F.col("_i") - 1)["pattern"] != F.col("e.pattern"))
    return each.select("ord", "unit_id", *keep, "e.*", first.alias("first"))


def combined(patterns: DataFrame, one_row: bool, *keep: str) -> DataFrame:
    """(unit_id, pattern1, pattern2, ord) of rows (ord, unit_id, p), once per unit, and the columns
    ``keep`` where each unit is one row."""
    both = behind(patterns, "p", ["ord", "unit_id", *keep]).select("ord", "unit_id", *keep, F.col("a").alias("pattern1"), F.col("b").alias("pattern2"))
    return both if one_row else both.groupBy("unit_id", "pattern1", "pattern2").agg(F.min("ord").alias("ord"))


def _marked(c: Corpus, key: str) -> DataFrame:
    """The rows of ``patterns`` with ``_sel``: whether they have a pattern that matches and another one."""
    return c.patterns.withColumn("_sel", (F.size("p") > 1) & F.exists("p", lambda x: x.rlike(to_java(key))))


def token_stats(c: Corpus, selected: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """(pattern, token, df, idf, fq, fq_local, in_local, n): a row per pattern with its representative
    token (most units, then the smallest), null fq where a count is missing, the number of its
    tokens in local units, and the number of all units.
    ``selected`` (unit_id) are the local units, or those of ``key`` where it is given and each unit
    is one row; without both, local is global."""
    if key is not None and c.one_row:
        tokens = _token_rows(_marked(c, key), "_sel")
    else:
        tokens = c.tokens.withColumn("_sel", F.lit(True)) if selected is None else c.tokens.join(selected.withColumn("_sel", F.lit(True)), "unit_id", "left").fillna(False, ["_sel"])
    firsts = F.count_if("first") if c.one_row else F.lit(0)
    variants = tokens.groupBy("pattern", "token").agg(F.count("*").alias("vdf"), F.sum("cnt").alias("fq"), F.sum(F.when(F.col("_sel"), F.col("cnt")).otherwise(0)).alias("local"), F.bool_and(F.col("cnt").isNotNull()).alias("known"), firsts.alias("df"), F.count_if("_sel").alias("in_local"))
    merged = variants.groupBy("pattern").agg(F.min_by("token", F.struct(-F.col("vdf"), "token")).alias("token"), F.sum("fq").alias("fq"), F.sum("local").alias("local"), F.bool_and("known").alias("known"), F.sum("df").alias("df"), F.sum("in_local").alias("in_local"))
    if not c.one_row:
        units = c.tokens.select("pattern", "unit_id").distinct().groupBy("pattern").agg(F.count("*").alias("df"))
        merged = merged.drop("df").join(units, "pattern")
    n = c.units.select(F.col("n").alias("_n"))
    return merged.crossJoin(F.broadcast(n)).select("pattern", "token", "df", F.log(F.col("_n") / F.col("df")).alias("idf"), F.when(F.col("known"), F.col("fq")).alias("fq"), F.when(F.col("known"), F.col("local")).alias("fq_local"), "in_local", F.col("_n").alias("n"))


def matching_patterns(c: Corpus, key: str) -> DataFrame:
    """(pattern): each pattern once, where the extended regular expression is found."""
    return c.tokens.select("pattern").distinct().filter(F.col("pattern").rlike(to_java(key)))


def key_units(c: Corpus, key: str) -> DataFrame:
    """(unit_id) with a pair of which a pattern matches the key: of units, those with a row that has
    such a pattern and another one."""
    if c.patterns is not None:
        found = _marked(c, key).filter("_sel").select("unit_id")
        return found if c.one_row else found.distinct()
    ends = c.pairs.select("unit_id", F.explode(F.array("pattern1", "pattern2")).alias("pattern")).distinct()
    return ends.join(matching_patterns(c, key), "pattern", "left_semi").select("unit_id").distinct()


def pair_stats(c: Corpus, selected: DataFrame | None = None, with_gdf: bool = True, key: str | None = None) -> DataFrame:
    """(pattern1, pattern2, gdf, ctf): units of each pair, and those of them that are selected.
    Without ``with_gdf``, which is null then, only the selected units are combined."""
    if selected is None:
        return c.pairs.groupBy("pattern1", "pattern2").agg(F.count("*").alias("gdf")).withColumn("ctf", F.col("gdf"))
    in_rows = key is not None and c.one_row  # a row tells whether its unit is selected
    if not with_gdf:
        if c.patterns is None:
            rows = c.pairs.join(selected, "unit_id", "left_semi")
        else:
            rows = combined(_marked(c, key).filter("_sel") if in_rows else c.patterns.join(selected, "unit_id", "left_semi"), c.one_row)
        return rows.groupBy("pattern1", "pattern2").agg(F.count("*").alias("ctf")).withColumn("gdf", F.lit(None).cast("long"))
    if in_rows:
        marked = combined(_marked(c, key), True, "_sel").withColumn("_sel", F.when(F.col("_sel"), True))
    else:
        marked = c.pairs.join(selected.withColumn("_sel", F.lit(True)), "unit_id", "left")
    return marked.groupBy("pattern1", "pattern2").agg(F.count("*").alias("gdf"), F.count("_sel").alias("ctf")).filter("ctf > 0")


def key_frequency(stats: DataFrame, c: Corpus, key: str) -> DataFrame:
    """One row: key_fq, the local frequency of the patterns that match; null if any lacks counts."""
    hits = stats.join(matching_patterns(c, key), "pattern", "left_semi")
    return hits.agg(F.when(F.bool_and(F.col("fq_local").isNotNull()), F.sum("fq_local")).alias("key_fq"))


def score(method: int, ctf: Column, gdf: Column, idf1: Column, idf2: Column, n: Column, key_fq: Column) -> Column:
    """The weight of a pair."""
    w = F.sqrt(idf1 * idf2)
    if method == 1:
        return (1 + F.log(ctf)) * w
    if method == 7:
        ten = F.lit(math.log(10))
        return (1 + F.log(ctf) / ten) * w / (1 + F.log(key_fq) / ten)
    if method == 12:
        return (1 + F.floor(key_fq / ctf)) * w
    if method == 16:
        return (1 + F.log(n / gdf)) * w * (1 + F.log(ctf))
    raise OptionError(f"no such method: {method}")


def standardized(scored: DataFrame) -> DataFrame:
    """Adds z: 0 where the sample's deviation is 0 or not finite. Mean and deviation are one row
    that is broadcast."""
    sd = F.stddev_samp("cw")
    fine = F.coalesce((sd > 0) & (sd < float("inf")) & ~F.isnan(sd), F.lit(False))
    spread = scored.agg(F.avg("cw").alias("_mean"), F.when(fine, sd).otherwise(0.0).alias("_sd"))
    return scored.crossJoin(F.broadcast(spread)).withColumn("z", F.when(F.col("_sd") > 0, (F.col("cw") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)).drop("_mean", "_sd")


def weigh(c: Corpus, key: str | None = None, method: int = 7) -> DataFrame:
    """Edges with their patterns; ``ordered`` gives them their order, ``with_unit_ids`` their units.

    Methods 7 and 12 need a key whose patterns have frequencies; the rows raise an error if they
    don't. A key that selects no unit gives no edge. gdf is null where a key is given and the method
    doesn't need it: then only the key's units are combined."""
    if method not in METHODS:
        raise OptionError(f"no such method: {method}")
    if method in KEYED and key is None:
        raise OptionError(f"method {method} needs a key")
    selected = None if key is None else key_units(c, key)
    stats = token_stats(c, selected, key)
    pairs = pair_stats(c, selected, method == 16, key)
    if method in KEYED:
        # one row; an error where units are selected and their patterns have no frequency
        hit = F.col("pattern").rlike(to_java(key))
        total = F.when(F.bool_and(~hit | F.col("fq_local").isNotNull()), F.sum(F.when(hit, F.col("fq_local"))))
        found = stats.agg(total.alias("key_fq"), F.coalesce(F.sum("in_local"), F.lit(0)).alias("_local"))
        fine = (F.col("_local") == 0) | (F.coalesce("key_fq", F.lit(0)) > 0)
        key_fq = found.select(F.when(fine, F.col("key_fq")).otherwise(F.raise_error(F.lit(NO_FREQUENCIES))).alias("key_fq"))
    return scored_edges(stats, pairs, method, key_fq if method in KEYED else None)


def scored_edges(stats: DataFrame, pairs: DataFrame, method: int, key_fq: DataFrame | None = None) -> DataFrame:
    """Edges of a row per pattern (pattern, token, df, idf, fq_local, n) and a row per pair (pattern1, pattern2, gdf, ctf)."""
    one, two = (stats.select(F.col("pattern").alias(f"pattern{i}"), F.col("token").alias(f"token{i}"), F.col("df").alias(f"df{i}"), F.col("idf").alias(f"idf{i}"), F.col("fq_local").alias(f"fq{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    facts = pairs.join(one, "pattern1").join(two, "pattern2")
    if key_fq is not None:
        facts = facts.crossJoin(F.broadcast(key_fq))
    cw = score(method, F.col("ctf"), F.col("gdf"), F.col("idf1"), F.col("idf2"), F.col("n1"), F.lit(None) if key_fq is None else F.col("key_fq"))
    return standardized(facts.withColumn("cdf", F.col("ctf")).withColumn("cw", cw)).select(*EDGE_COLUMNS, "pattern1", "pattern2", "gdf")


def weigh_runs(pairs: DataFrame, fields: Sequence[int] = DEFAULT_FIELDS, method: int = 16) -> DataFrame:
    """Edges of pair rows (ord, unit_id, token1, token2, fq1, fq2) whose df, gdf and ctf count runs of a unit's lines instead of different
    units, as a program does that remembers the last unit only: where a unit's lines are apart, it counts again. Equal to
    ``weigh`` without a key where they are together. The number of units, and fq, don't depend on it."""
    if method not in METHODS or method in KEYED:
        raise OptionError(f"no method without a key: {method}")
    c = corpus(pairs, fields)
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"token{i}").alias("token")) for i in (1, 2)))
    touched = pairs.select("ord", "unit_id", F.explode(sides).alias("e")).select("ord", "unit_id", "e.*").withColumn("pattern", project(F.col("token"), fields))
    df = run_counts(touched, ["pattern"], "unit_id", ["ord", "side"]).withColumnRenamed("runs", "df")
    variants = run_counts(touched, ["pattern", "token"], "unit_id", ["ord", "side"])
    named = variants.groupBy("pattern").agg(F.min_by("token", F.struct(-F.col("runs"), "token")).alias("token"))
    fq = c.tokens.groupBy("pattern").agg(F.when(F.bool_and(F.col("cnt").isNotNull()), F.sum("cnt")).alias("fq_local"))
    stats = df.join(named, "pattern").join(fq, "pattern").crossJoin(F.broadcast(c.units)).withColumn("idf", F.log(F.col("n") / F.col("df")))
    both = pairs.select("ord", "unit_id", project(F.col("token1"), fields).alias("p"), project(F.col("token2"), fields).alias("q")).filter("p <> q")
    found = run_counts(both.select("ord", "unit_id", F.least("p", "q").alias("pattern1"), F.greatest("p", "q").alias("pattern2")), ["pattern1", "pattern2"], "unit_id", ["ord"])
    return scored_edges(stats, found.withColumnsRenamed({"runs": "gdf"}).withColumn("ctf", F.col("gdf")), method)


def weigh_table(rows: DataFrame, unit: str, key: str, tokens: DataFrame, fields: Sequence[int] = DEFAULT_FIELDS, method: int = 16) -> DataFrame:
    """Edges as ``weigh`` gives them without a key, of a table of rows (unit, key) whose tokens are rows (key, token) of another table.

    Patterns and tokens are numbered in their order, so that units and pairs are numbers in all that is shuffled or stored;
    text is met by the counted pairs only, and of a pair only its first token has to move with it."""
    if method not in METHODS or method in KEYED:
        raise OptionError(f"no method without a key: {method}")
    named = tokens.filter(F.col("token").isNotNull()).select(key, "token", project(F.col("token"), fields).alias("pattern"))
    placed = numbered(named.select("pattern", "token").distinct(), "pattern", "token").withColumnRenamed("row", "t")
    # a pattern's number is that of its first token
    terms = stored(placed.join(placed.groupBy("pattern").agg(F.min("t").alias("p")), "pattern"), "terms")
    coded = rows.filter(F.col(unit).isNotNull()).select(unit, key).join(named.join(terms, ["pattern", "token"]).select(key, "p", "t"), key)
    counts = coded.select(unit, "p", "t").repartition(unit).groupBy(unit, "p", "t").agg(F.count("*").alias("c"))
    listed = counts.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct("p", "t", "c"))).alias("tokens"))
    units = stored(listed.filter(F.size("tokens") > 1).select("tokens"), "units")
    n = F.lit(units.count())

    first = (F.col("_i") == 0) | (F.get("tokens", F.col("_i") - 1)["p"] != F.col("e.p"))
    each = units.select("tokens", F.posexplode("tokens").alias("_i", "e")).select("e.*", first.alias("first"))
    variants = each.groupBy("p", "t").agg(F.count("*").alias("vdf"), F.sum("c").alias("fq"), F.count_if("first").alias("df"))
    merged = variants.groupBy("p").agg(F.min_by("t", F.struct(-F.col("vdf"), "t")).alias("t"), F.sum("fq").alias("fq"), F.sum("df").alias("df"))
    stats = stored(merged.join(terms.drop("p"), "t").select("p", "pattern", "token", "df", "fq"), "stats")

    one, two = (stats.toDF(*(f"{x}{i}" for x in stats.columns)) for i in (1, 2))
    both = behind(units.select(F.array_distinct("tokens.p").alias("p")), "p", []).select(F.col("a").alias("p1"), F.col("b").alias("p2"))
    # pairs of frequent patterns, at most OFTEN, are counted before they are shuffled; hardly any of the others come twice
    # in a task, and they go where their first pattern's token is at once
    often = stats.join(F.broadcast(stats.agg(F.sum("df").alias("_all"))), F.col("df") * OFTEN > F.col("_all")).select(F.col("p").alias("p1"))
    n_often = often.count()
    n_rest = stats.count() - n_often

    def met(how: str) -> DataFrame:
        return both.join(F.broadcast(often), "p1", how) if n_often and n_rest else both

    kinds = ([met("left_semi")] if n_often else []) + ([met("left_anti").repartition("p1")] if n_rest or not n_often else [])
    pairs = reduce(DataFrame.union, (k.groupBy("p1", "p2").agg(F.count("*").alias("gdf")).join(one, "p1") for k in kinds))
    facts = pairs.join(two, "p2").withColumns({f"idf{i}": F.log(n / F.col(f"df{i}")) for i in (1, 2)})
    cw = score(method, F.col("gdf"), F.col("gdf"), F.col("idf1"), F.col("idf2"), n, F.lit(None))
    return standardized(facts.withColumns({"ctf": F.col("gdf"), "cdf": F.col("gdf"), "cw": cw})).select(*EDGE_COLUMNS, "pattern1", "pattern2", "gdf")


def ordered(edges: DataFrame) -> DataFrame:
    """Edges by their patterns' bytes."""
    return edges.orderBy("pattern1", "pattern2")


def edge_units(c: Corpus, key: str | None = None) -> DataFrame:
    """(pattern1, pattern2, unit_id, ord): the local units of each pair, a row each."""
    rows = c.pairs if key is None else c.pairs.join(key_units(c, key), "unit_id", "left_semi")
    return rows.select("pattern1", "pattern2", "unit_id", "ord")


def with_unit_ids(edges: DataFrame, c: Corpus, key: str | None = None) -> DataFrame:
    """Adds unit_ids, in the order of the input: for edges whose units fit into a row.
    Edges are joined first, so that only those that are left gather theirs."""
    wanted = edge_units(c, key).join(edges.select("pattern1", "pattern2"), ["pattern1", "pattern2"], "left_semi")
    units = wanted.groupBy("pattern1", "pattern2").agg(F.expr("transform(sort_array(collect_list(struct(ord, unit_id))), x -> x.unit_id)").alias("unit_ids"))
    return edges.join(units, ["pattern1", "pattern2"], "left")


def raw_pair_stats(pairs: DataFrame) -> DataFrame:
    """(token1, token2, ctf, cdf): of complete tokens in the order given; repeats count, and pairs of
    equal tokens stay."""
    return pairs.groupBy("token1", "token2").agg(F.count("*").alias("ctf"), F.countDistinct("unit_id").alias("cdf"))
