"""Token pairs inside units.

``pair`` works inside a row (no shuffle), so units may be a stream. The row, not
the unit id, is the scope of pairing. fq1 and fq2 count a token in its whole row. Units that don't fit into a row are tables with
a row per token: ``pair_table`` walks them in pieces, ``pair_types`` pairs their different tokens block by
block, and ``ordered_pair_counts`` counts ordered pairs without making them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligate.errors import OptionError
from colligate.sinks.store import numbered, stored

#: Places of a row that are paired with all behind them at once.
STEP = 32
#: Different tokens in a block of a unit, unless it has so many that there would be more than ``BLOCKS`` blocks; and the most then.
BLOCK_TYPES, BLOCKS, LARGEST_BLOCK = 1024, 64, 16_384
#: Rows of a unit whose ordered pairs are made; more are counted by what precedes them.
LEAF_ROWS = 64
#: Rows of a table that are walked in one piece.
PIECE_ROWS = 65_536


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_runs(tokens: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """For each different token, ``use`` of all places (t, i) sorted by token, where its own start, and
    how many they are. The tokens are sorted once."""
    places = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k)["t"] != F.get(s, k - 1)["t"]))
        return let(starts, lambda at: F.transform(at, lambda k, j: use(s, k, F.coalesce(F.get(at, j + 1), F.size(s)) - k)))

    return F.when(F.size(tokens) > 0, let(places, runs))


def counted(tokens: Column) -> Column:
    """The different tokens (i, t, c), first seen first, each with its first place and its count."""
    return F.array_sort(_in_runs(tokens, lambda s, k, n: F.struct(F.get(s, k)["i"].alias("i"), F.get(s, k)["t"].alias("t"), n.cast("long").alias("c"))))


def counted_places(tokens: Column) -> Column:
    """All tokens (i, t, c) in order, each with its count."""
    all_ = _in_runs(tokens, lambda s, k, n: F.transform(F.slice(s, k + 1, n), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"), n.cast("long").alias("c"))))
    return F.array_sort(F.flatten(all_))


def behind(rows: DataFrame, column: str, rest: Sequence[str], last: Column | None = None, outer: bool = False) -> DataFrame:
    """(rest, a, b): each element of the array ``column`` with those behind it, at most ``last`` of them, in order.
    ``STEP`` elements are handled at once, so that memory grows with the array, not with its pairs. With ``outer`` a row with a null array
    gives one row with a null ``a``."""
    explode = F.explode_outer if outer else F.explode
    steps = rows.select(*rest, F.col(column).alias("_t"), explode(F.sequence(F.lit(0), F.floor((F.size(column) - 1) / STEP).cast("int"))).alias("_k"))
    first, many = F.col("_k") * STEP, F.size("_t") if last is None else last
    left = steps.select(*rest, explode(F.transform(F.slice("_t", first + 1, STEP), lambda x, i: F.struct(x.alias("x"), F.slice("_t", first + i + 2, many).alias("more")))).alias("_a"))
    both = left.select(*rest, F.col("_a.x").alias("a"), explode("_a.more").alias("b"))
    return both.filter("a is null or b is not null") if outer else both


def pair(units: DataFrame, window: int | None = None, ordered: bool = False, with_rejected: bool = False) -> DataFrame:
    """(ord, unit_id, token1, token2, fq1, fq2) of units (ord, unit_id, tokens).

    Without a window: each unordered pair of different tokens once, or with ``ordered`` every pair of
    places. With one: every pair of places at most ``window`` apart; repeats and pairs
    of equal tokens are kept. Unordered pairs are stored smaller token first. A unit without a token has no row, or
    ``with_rejected`` one with null tokens, so that one pass gives the pairs and what there is to warn of.
    """
    if window is not None and window < 1:
        raise OptionError("a window is a positive number of tokens")
    rest = [c for c in units.columns if c != "tokens"]
    sized = units.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")))
    once = window is None and not ordered
    rows = sized.select(*rest, (counted if once else counted_places)(F.col("tokens")).alias("_t"))
    both = behind(rows if with_rejected else rows.filter("_t is not null"), "_t", rest, None if window is None else F.lit(window), with_rejected)
    if ordered:
        return both.select(*rest, F.col("a.t").alias("token1"), F.col("b.t").alias("token2"), F.col("a.c").alias("fq1"), F.col("b.c").alias("fq2"))
    swap = F.col("b.t") < F.col("a.t")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name) for x, y, name in (("a.t", "b.t", "token1"), ("b.t", "a.t", "token2"), ("a.c", "b.c", "fq1"), ("b.c", "a.c", "fq2"))]
    return both.select(*rest, *ends)


def _events(df: DataFrame, unit: str, token: Column, order: Sequence[str]) -> DataFrame:
    """(unit_id, t, o): the rows with a unit and a token."""
    return df.filter(F.col(unit).isNotNull() & token.isNotNull()).select(F.col(unit).cast("string").alias("unit_id"), token.alias("t"), F.struct(*order).alias("o"))


def pair_table(df: DataFrame, unit: str, token: Column, order: Sequence[str], window: int = 1, ordered: bool = False, with_counts: bool = True) -> DataFrame:
    """(unit_id, token1, token2, fq1, fq2): what ``pair`` gives with a window, of a table with a row per
    token, where a unit may be as long as the table. Rows are sorted by unit and order over all
    partitions and numbered; pieces of equal size, each with the first rows of the next one, are
    walked. Without ``with_counts`` fq1 and fq2 are left out."""
    if window < 1:
        raise OptionError("a window is a positive number of tokens")
    events = _events(df, unit, token, order)
    placed = numbered(events, "unit_id", "o").select("unit_id", "t", "row")
    size = max(PIECE_ROWS, 16 * window)
    piece = F.floor(F.col("row") / size)
    own = placed.select("*", piece.alias("piece"), F.lit(True).alias("own"))
    ahead = placed.filter((F.col("row") % size < window) & (F.col("row") >= size)).select("*", (piece - 1).alias("piece"), F.lit(False).alias("own"))
    next_ = Window.partitionBy("piece").orderBy("row").rowsBetween(1, window)
    met = own.union(ahead).withColumn("more", F.collect_list(F.struct("unit_id", "t")).over(next_)).filter("own")
    pairs = met.select("unit_id", "t", F.explode(F.filter("more", lambda x: x["unit_id"] == F.col("unit_id"))).alias("b")).select("unit_id", "t", F.col("b.t").alias("u"))
    first, second = (F.col("t"), F.col("u")) if ordered else (F.least("t", "u"), F.greatest("t", "u"))
    pairs = pairs.select("unit_id", first.alias("token1"), second.alias("token2"))
    if not with_counts:
        return pairs
    counts = events.groupBy("unit_id", "t").agg(F.count("*").alias("c"))
    for i in (1, 2):
        pairs = pairs.join(counts.select("unit_id", F.col("t").alias(f"token{i}"), F.col("c").alias(f"fq{i}")), ["unit_id", f"token{i}"])
    return pairs.select("unit_id", "token1", "token2", "fq1", "fq2")


def pair_types(df: DataFrame, unit: str, token: Column, block_types: int = BLOCK_TYPES) -> DataFrame:
    """(unit_id, token1, token2, fq1, fq2): each unordered pair of different tokens of a unit once, of a table with a row per
    token, where a unit may have more tokens than fit into a row. A unit's different tokens are sorted and cut into blocks, its blocks in
    pairs dealt to the cells of a triangle, and the tokens of a cell's two blocks, of which those of the first are smaller, are joined: a
    pair is made where it leaves, and is in no array.
    Every block goes to as many cells as its unit has blocks; blocks grow with the unit, up to ``LARGEST_BLOCK``, so that these copies don't
    grow with its pairs."""
    events = df.filter(F.col(unit).isNotNull() & token.isNotNull()).select(F.col(unit).cast("string").alias("unit_id"), token.alias("t"))
    placed = numbered(events.groupBy("unit_id", "t").agg(F.count("*").alias("c")), "unit_id", "t")
    size = F.greatest(F.lit(block_types), F.least(F.ceil(F.count("*") / BLOCKS), F.lit(LARGEST_BLOCK)))
    sizes = placed.groupBy("unit_id").agg(F.min("row").alias("first"), size.alias("size"), F.ceil(F.count("*") / size).cast("int").alias("k"))
    dealt = placed.join(sizes, "unit_id").withColumn("own", F.floor((F.col("row") - F.col("first")) / F.col("size")).cast("int"))
    # the number is given, so that cells aren't put together for being small: their pairs are many
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(n: int, own: str, other: str, others: Column) -> DataFrame:
        cells = dealt.select("unit_id", F.col("own").alias(own), F.explode(others).alias(other), F.col("t").alias(f"token{n}"), F.col("c").alias(f"fq{n}"), F.col("row").alias(f"row{n}"))
        return cells.repartition(tasks, "unit_id", "i", "j")

    left, right = side(1, "i", "j", F.sequence("own", F.col("k") - 1)), side(2, "j", "i", F.sequence(F.lit(0), "own"))
    # a merge join holds one block; the table is small, its copies aren't, so that they would be broadcast otherwise
    both = left.join(right.hint("merge"), ["unit_id", "i", "j"]).filter("row1 < row2")
    return both.select("unit_id", "token1", "token2", "fq1", "fq2")


def ordered_pair_counts(df: DataFrame, unit: str, token: Column, order: Sequence[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(token1, token2, n, n_units): how often token2 comes anywhere behind token1 in a unit, and in how many units, of a table
    with a row per token, where a unit may be as long as the table.

    Rows are sorted and numbered; pairs are made only within leaves of ``leaf_rows`` rows. Leaves are those of a
    binary tree. Two rows of different leaves part at one node of it, on the left and on the right, so that the products of
    the counts of tokens on either side of each node are what is missing: work grows with the rows and, for each node, with the
    different tokens on its sides, not with the pairs."""
    placed = numbered(_events(df, unit, token, order), "unit_id", "o").select("unit_id", "t", "row")
    leaves = placed.withColumn("leaf", F.floor(F.col("row") / leaf_rows))
    rows = leaves.groupBy("unit_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("row", "t"))).alias("_t"))
    near = behind(rows, "_t", ["unit_id"]).groupBy("unit_id", F.col("a.t").alias("token1"), F.col("b.t").alias("token2")).agg(F.count("*").alias("n"))
    counts = leaves.groupBy("unit_id", "leaf", "t").agg(F.count("*").alias("c"))
    long_units = leaves.groupBy("unit_id").agg(F.min("leaf").alias("first"), F.max("leaf").alias("last")).filter("first < last")
    # above the highest bit in which a unit's first and last leaf differ, nothing of it parts
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("first").bitwiseXOR(F.col("last")))).cast("int") - 1)
    sides = counts.join(long_units, "unit_id").select("unit_id", "t", "c", "leaf", F.explode(levels).alias("level"))
    node, right = F.expr("shiftright(leaf, level + 1)"), F.expr("shiftright(leaf, level) & 1")
    sums = stored(sides.groupBy("unit_id", "level", node.alias("node"), right.alias("right"), "t").agg(F.sum("c").alias("c")), "sides")
    a, b = (sums.filter(f"right = {k}").select("unit_id", "level", "node", F.col("t").alias(f"token{k + 1}"), F.col("c").alias(f"c{k}")) for k in (0, 1))
    far = a.join(b, ["unit_id", "level", "node"]).groupBy("unit_id", "token1", "token2").agg(F.sum(F.col("c0") * F.col("c1")).alias("n"))
    return near.union(far).groupBy("unit_id", "token1", "token2").agg(F.sum("n").alias("n")).groupBy("token1", "token2").agg(F.sum("n").alias("n"), F.count("*").alias("n_units"))


def run_counts(rows: DataFrame, node: Sequence[str], unit: str, order: Sequence[str | Column]) -> DataFrame:
    """(node, runs): of rows in order, the runs of equal units among the rows of each node. Where a unit's rows of a node
    are together, they are one run, and runs are units. Rows are sorted by node and order over all partitions; pieces of
    equal size, each with the last row of the one before it, are walked, so that a node may have any share of the rows."""
    placed = numbered(rows.select(*node, F.col(unit).alias("_unit"), F.struct(*order).alias("_o")), *node, "_o")
    piece = F.floor(F.col("row") / PIECE_ROWS)
    own = placed.select("*", piece.alias("piece"), F.lit(True).alias("own"))
    before = placed.filter(F.col("row") % PIECE_ROWS == PIECE_ROWS - 1).select("*", (piece + 1).alias("piece"), F.lit(False).alias("own"))
    here = F.struct(*node, "_unit")
    last = F.lag(here).over(Window.partitionBy("piece").orderBy("row"))
    starts = own.union(before).withColumn("_starts", F.coalesce(~last.eqNullSafe(here), F.lit(True))).filter("own")
    return starts.groupBy(*node).agg(F.count_if("_starts").alias("runs"))


def unit_ends(df: DataFrame, unit: str, token: Column, order: Sequence[str]) -> DataFrame:
    """(unit_id, first, last): the first and the last token of each unit of such a table."""
    return _events(df, unit, token, order).groupBy("unit_id").agg(F.min_by("t", "o").alias("first"), F.max_by("t", "o").alias("last"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(token1, token2, n, n_units): occurrences of each pair as it stands, and its units."""
    return pairs.groupBy("token1", "token2").agg(F.count("*").alias("n"), F.countDistinct("unit_id").alias("n_units"))
