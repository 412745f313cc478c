"""Graphs of weighted edges: thresholds, nodes, degrees, sizes, and pruning by structure."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligate.errors import OptionError
from colligate.operators.pairs import pair_table, unit_ends
from colligate.sinks.store import discard, stored


def prune(edges: DataFrame, min_cw: float | None = None, min_z: float | None = None, min_ctf: int | None = None) -> DataFrame:
    """Edges that reach the thresholds; each is inclusive and optional."""
    for name, least in (("ctf", min_ctf), ("cw", min_cw), ("z", min_z)):
        if least is not None:
            edges = edges.filter(F.col(name) >= least)
    return edges


def exclude(edges: DataFrame, pattern: str) -> DataFrame:
    """Edges neither of whose tokens has the (Java) regular expression."""
    return edges.filter(~F.col("token1").rlike(pattern) & ~F.col("token2").rlike(pattern))


def touching(edges: DataFrame, pattern: str) -> DataFrame:
    """Edges one of whose tokens has the (Java) regular expression."""
    return edges.filter(F.col("token1").rlike(pattern) | F.col("token2").rlike(pattern))


def top_edges(edges: DataFrame, k: int, by: str = "z") -> DataFrame:
    """The ``k`` edges with the largest values, ties to the smaller tokens."""
    return edges.orderBy(F.desc(by), "token1", "token2").limit(k)


def nodes(edges: DataFrame) -> DataFrame:
    """(id, df, idf, fq, degree) of the ends; a loop counts twice. Ends with one id and
    different numbers are an error."""
    ends = edges.select(F.explode(F.array(*(F.struct(F.col(f"token{i}").alias("id"), F.col(f"df{i}").alias("df"), F.col(f"idf{i}").alias("idf"), F.col(f"fq{i}").alias("fq")) for i in (1, 2)))).alias("e")).select("e.*")
    fq = F.coalesce("fq", F.lit(-1))
    found = ends.groupBy("id").agg(F.min("df").alias("df"), F.min("idf").alias("idf"), F.min("fq").alias("fq"), F.count("*").alias("degree"), F.max("df").alias("df_"), F.max("idf").alias("idf_"), F.min(fq).alias("f"), F.max(fq).alias("f_"))
    same = (F.col("df") == F.col("df_")) & (F.col("idf") == F.col("idf_")) & (F.col("f") == F.col("f_"))
    return found.withColumn("id", F.when(same, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("a node has different numbers: "), F.col("id"))))).drop("df_", "idf_", "f", "f_")


def with_font_size(nodes_: DataFrame, by: str = "fq", smallest: float = 7.0, largest: float = 32.0) -> DataFrame:
    """Adds font_size: ``by`` scaled to the range; its middle where all are equal. Sizes by fq
    need an fq of every node. The bounds are one row that is broadcast."""
    if by not in ("fq", "idf", "degree"):
        raise OptionError(f"no such size: {by}")
    weight: Column = F.col(by).cast("double")
    if by == "fq":
        weight = F.when(F.col("fq").isNotNull(), weight).otherwise(F.raise_error(F.lit("sizes by fq need an fq of every node")))
    rows = nodes_.withColumn("_w", weight)
    bounds = rows.agg(F.min("_w").alias("_low"), F.max("_w").alias("_high"))
    scaled = smallest + (F.col("_w") - F.col("_low")) / (F.col("_high") - F.col("_low")) * (largest - smallest)
    sized = rows.crossJoin(F.broadcast(bounds)).withColumn("font_size", F.when(F.col("_high") > F.col("_low"), scaled).otherwise(F.lit((smallest + largest) / 2)))
    return sized.drop("_w", "_low", "_high")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node is connected with.

    Labels sink to the neighbours' smallest, then to their label's label; each round is
    written to the shared folder, and the rounds grow with the logarithm of the longest way."""
    links = edges.select(F.col("token1").alias("a"), F.col("token2").alias("b"))
    both = stored(links.union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        sunk = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("d"))
        new = stored(sunk.join(up, "c").select("id", "old", F.least("c", "d").alias("component")), "labels")
        discard(last)
        if new.filter("old <> component").isEmpty():
            discard(both)
            return new.select("id", "component")
        last, labels = new, new.select("id", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with the most nodes, ties to the smallest id."""
    found = components(edges)
    first = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return edges.join(found.join(F.broadcast(first), "component", "left_semi").select(F.col("id").alias("token1")), "token1", "left_semi")


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, steps): the nodes that are connected with a node of ``starts`` (id), which are among them, and the least number of
    edges to one. Each round goes one step from the nodes found in the last one; an undirected step leads to these, to the ones
    before or to new ones, so that only the last two rounds are compared: work grows with what is reached, not with the graph's nodes."""
    links = edges.select(F.col("token1").alias("a"), F.col("token2").alias("b"))
    both = stored(links.union(links.select("b", "a")), "links")
    rounds = [stored(starts.select("id").distinct(), "reached")]
    while True:
        step = both.join(rounds[-1].select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        for before in rounds[-2:]:
            step = step.join(before, "id", "left_anti")
        new = stored(step, "reached")
        if new.isEmpty():
            break
        rounds.append(new)
    discard(both, new)
    return reduce(DataFrame.union, [r.select("id", F.lit(i).alias("steps")) for i, r in enumerate(rounds)])


def component_of(edges: DataFrame, node: str) -> DataFrame:
    """The edges connected with a node."""
    found = reached(edges, edges.sparkSession.createDataFrame([(node,)], "id string"))
    return edges.join(found.select(F.col("id").alias("token1")), "token1", "left_semi")


def without_islands(edges: DataFrame, least_nodes: int) -> DataFrame:
    """The edges of components of at least so many nodes."""
    found = components(edges)
    large = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least_nodes)
    return edges.join(found.join(large, "component", "left_semi").select(F.col("id").alias("token1")), "token1", "left_semi")


def min_degree(edges: DataFrame, least: int) -> DataFrame:
    """The edges both of whose nodes have at least this degree among all edges."""
    ends = edges.select(F.explode(F.array("token1", "token2")).alias("id")).groupBy("id").agg(F.count("*").alias("d")).filter(F.col("d") >= least).select("id")
    return edges.join(ends.withColumnRenamed("id", "token1"), "token1", "left_semi").join(ends.withColumnRenamed("id", "token2"), "token2", "left_semi")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """What is left when nodes of a degree under ``k`` are taken away until none is left."""
    now = stored(edges, "core")
    n = now.count()
    while n:
        left = stored(min_degree(now, k), "core")
        m = left.count()
        if m == n:
            discard(left)
            break
        discard(now)
        now, n = left, m
    return now


def coreness(edges: DataFrame) -> DataFrame:
    """(id, core): for each node the largest k whose k-core has it, of all k at once; an edge counts as often as it is there, a loop twice.

    A node's number starts as its degree and sinks to the largest h such that h of its neighbours have h or more,
    until none changes; neighbours are counted by their numbers, so that a node may have any number of them. Each round
    is written to the shared folder."""
    links = edges.select(F.col("token1").alias("a"), F.col("token2").alias("b"))
    both = stored(links.union(links.select("b", "a")), "links")
    now = stored(both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("core")), "core")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "core"), "b").groupBy("a", "core").agg(F.count("*").alias("n"))
        as_large = F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("core")))
        least = near.select(F.col("a").alias("id"), F.least("core", as_large).alias("h")).groupBy("id").agg(F.max("h").alias("h"))
        new = stored(now.join(least, "id").select("id", F.col("core").alias("old"), F.least("core", "h").alias("core")), "core")
        discard(now)
        now = new
        if new.filter("old <> core").isEmpty():
            discard(both)
            return new.select("id", "core")


def transitions(units: DataFrame, begin: str = "<BOS>", end: str = "<EOS>") -> DataFrame:
    """(x, y, af, p): how often y follows x in units (ord, unit_id, tokens), and of all that follows x."""
    framed = units.select(F.concat(F.array(F.lit(begin)), "tokens", F.array(F.lit(end))).alias("t"))
    steps = framed.select(F.explode(F.arrays_zip(F.expr("slice(t, 1, size(t) - 1)").alias("x"), F.expr("slice(t, 2, size(t) - 1)").alias("y"))).alias("s"))
    return _shares(steps.select("s.x", "s.y"))


def transitions_of_table(df: DataFrame, unit: str, token: Column, order: Sequence[str], begin: str = "<BOS>", end: str = "<EOS>") -> DataFrame:
    """The same of a table with a row per token, where a unit may be as long as the table."""
    inner = pair_table(df, unit, token, order, 1, True, with_counts=False).select(F.col("token1").alias("x"), F.col("token2").alias("y"))
    ends = unit_ends(df, unit, token, order).select(F.explode(F.array(F.struct(F.lit(begin).alias("x"), F.col("first").alias("y")), F.struct(F.col("last").alias("x"), F.lit(end).alias("y")))).alias("e"))
    return _shares(inner.union(ends.select("e.x", "e.y")))


def _shares(steps: DataFrame) -> DataFrame:
    af = steps.groupBy("x", "y").agg(F.count("*").alias("af"))
    total = af.groupBy("x").agg(F.sum("af").alias("n"))
    return af.join(total, "x").select("x", "y", "af", (F.col("af") / F.col("n")).alias("p"))


def distribution(edges: DataFrame, column: str = "z", bins: int = 10) -> DataFrame:
    """(bin, low, high, n): a histogram over ``bins`` equal ranges of a column."""
    bounds = edges.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    step = (F.col("_high") - F.col("_low")) / bins
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col(column) - F.col("_low")) / step), F.lit(bins - 1))).otherwise(0)
    counted = edges.crossJoin(F.broadcast(bounds)).groupBy(place.cast("int").alias("bin"), "_low", "_high").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("_low") + F.col("bin") * step).alias("low"), (F.col("_low") + (F.col("bin") + 1) * step).alias("high"), "n")


def quantiles(values: DataFrame, shares: Sequence[float], bins: int = 1024, few: int = 4096) -> list[float | None]:
    """The exact quantiles of finite doubles (x): what lies at the place share * (n - 1) of the sorted values, between two of them in
    proportion.

    The range is cut into bins that are counted; a bin in which a place lies is cut again, from its least to its largest value, until it has
    one value or so ``few`` that they are sorted. The driver gets ``bins`` counts a round for each bin that is cut."""
    whole = values.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not whole["n"]:
        return [None] * len(shares)
    places = [share * (whole["n"] - 1) for share in shares]
    ranks = {int(r) for p in places for r in (math.floor(p), math.ceil(p))}
    found: dict[int, float] = {}
    cut = [(whole["low"], whole["high"], 0, whole["n"])]  # least, largest, how many come before, how many there are
    while cut:
        inside = {c: [r for r in ranks if c[2] <= r < c[2] + c[3]] for c in cut}
        found |= {r: low for (low, high, _, _), own in inside.items() if low == high for r in own}
        for low, high, before, n in (c for c in cut if c[0] < c[1] and c[3] <= few):
            own = sorted(r["x"] for r in values.filter(F.col("x").between(low, high)).collect())
            found |= {r: own[r - before] for r in inside[low, high, before, n]}
        cut = [c for c in cut if c[0] < c[1] and c[3] > few]
        if not cut:
            break
        which = F.lit(None).cast("struct<i:int,bin:int>")
        for i, (low, high, _, _) in enumerate(cut):  # halves, so that no difference is infinite
            bin_ = F.least(F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1)).cast("int")
            which = F.when(F.col("x").between(low, high), F.struct(F.lit(i).alias("i"), bin_.alias("bin"))).otherwise(which)
        rows = values.select("x", which.alias("w")).filter("w is not null").groupBy("w").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        new = []
        for i, c in enumerate(cut):
            before = c[2]
            for r in sorted((r for r in rows if r["w"]["i"] == i), key=lambda r: r["w"]["bin"]):
                if any(before <= k < before + r["n"] for k in inside[c]):
                    new.append((r["low"], r["high"], before, r["n"]))
                before += r["n"]
        cut = new
    return [(math.floor(p) + 1 - p) * found[math.floor(p)] + (p - math.floor(p)) * found[math.ceil(p)] for p in places]


def finite(rows: DataFrame, column: str) -> DataFrame:
    """(x): the finite values of a column, as a table in the shared folder."""
    x = F.col(column).cast("double")
    return stored(rows.select(x.alias("x")).filter((F.col("x") < float("inf")) & (F.col("x") > float("-inf"))), "values")


def quantile_table(rows: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): the quantiles of a column's finite values."""
    values = finite(rows, column)
    found = quantiles(values, shares)
    discard(values)
    return rows.sparkSession.createDataFrame([(float(s), v) for s, v in zip(shares, found, strict=True)], "share double, value double")


def summary(edges: DataFrame, column: str = "z", shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row about the distribution of a column's finite values: n, mean, sd (of a sample), least, largest, skewness and
    kurtosis (in excess of the normal one, both of the population) and, as an array, the quantiles of ``shares``."""
    values = finite(edges, column)
    about = values.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("largest"),
        F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"),
    )
    row = (*about.first(), quantiles(values, shares))
    discard(values)
    return edges.sparkSession.createDataFrame([row], "n long, mean double, sd double, least double, largest double, skewness double, kurtosis double, percentiles array<double>")
