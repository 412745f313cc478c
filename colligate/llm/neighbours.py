"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled so that the largest inner product is the smallest distance (one
more coordinate lifts each to the largest norm), and projected to a few
dimensions by Gaussian (2-stable) vectors: a projected squared distance is the true
one times a chi-square variable. The projected space is split by a kd-tree whose
upper part, fitted on the projections of a sample of about ``SAMPLE_ROWS`` rows or ``SAMPLE_PER_BLOCK`` for each
block (a share of all rows by hash), deals all rows to blocks of about ``block_rows``; each block is a kd-tree of its own. A query takes
the leaves in order of their projected distance and verifies their members on
the original vectors, until the chi-square test says that a nearer neighbour is
left with a probability under ``MISS``. It starts in its own block; the block's
result decides which other blocks the test does not rule out: a descent of the upper part finds them, which
visits no more of it than they ask for. What reaches the driver and the tasks is the sample and the upper part (16 bytes a block).

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part; equal vectors are ranked by id; a query with fewer
candidates than wanted gets all; rows that repeat an id and its vector count once, other vectors under one id are ranked each,
and a query id with several gets the best of all of them; of equal vectors only the rows that can be ranked are indexed; an empty table gives no row. Scores are inner
products of the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import stored, table, within_share

DIMENSIONS, SEED = 8, 11
SAMPLE_ROWS, SAMPLE_PER_BLOCK, BLOCK_ROWS, LEAF_ROWS = 20_000, 16, 8_192, 128
#: Chance that a true neighbour lies beyond the projected distance where a query stops.
MISS = 0.05
#: Queries of one piece of work.
QUERY_ROWS = 4_096
#: Pairs of query and block that a task finds at once.
REACHED_ROWS = 1_000_000
DEFAULT_TOP = 20


def chi_square_quantile(p: float, k: int) -> float:
    """x with P(chi-square of k degrees <= x) = p, by bisection over the series of the
    incomplete gamma function."""

    def below(x: float) -> float:
        a, z = k / 2, x / 2
        term = total = 1 / a
        for n in range(1, 1000):
            term *= z / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z > 0 else 0.0

    low, high = 0.0, 10.0 * k + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(size: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dimensions))


class Space:
    """Lifts vectors to one norm and projects them."""

    def __init__(self, size: int, norm: float, dimensions: int = DIMENSIONS) -> None:
        self.norm, self.matrix = norm, projection(size + 1, dimensions)

    def rows(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, lift]) @ self.matrix

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Of a query, scaled to the largest norm, with nothing in the last coordinate."""
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return (x * (self.norm / length)) @ self.matrix[:-1]

    def distance(self, x: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Squared distance of lifted vectors from the scaled query with this inner product."""
        length = np.sqrt((x * x).sum(axis=1))
        return np.maximum(0, 2 * self.norm**2 - 2 * inner * (self.norm / length)[:, None])


def split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """The leaves, as row numbers, of a kd-tree that halves at medians of the widest side."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            leaves.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, axis], len(rows) // 2)
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return leaves


class Splitter:
    """The upper part of the kd-tree: deals points to blocks."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.axis, self.at = depth, np.zeros(2**depth, np.int64), np.zeros(2**depth)
        parts = {1: np.arange(len(sample))}
        for node in range(1, 2**depth):
            rows = parts.pop(node)
            own = sample[rows]
            axis = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
            at = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.at[node] = axis, at
            below = own[:, axis] < at if len(own) else np.zeros(0, bool)
            parts[2 * node], parts[2 * node + 1] = rows[below], rows[~below]

    def block(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - 2**self.depth


    def reached(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point's row, block) of every block whose cell is within the squared distance ``reach`` of a
        point. All points go down together; a cell's distance adds up by axis as planes are crossed."""
        row, node = np.arange(len(points)), np.ones(len(points), np.int64)
        off = np.zeros(points.shape)  # how far the cell is from the point, by axis
        for _ in range(self.depth):
            axis = self.axis[node]
            gap = points[row, axis] - self.at[node]
            near = 2 * node + (gap >= 0)
            beyond = off.copy()
            beyond[np.arange(len(row)), axis] = np.maximum(np.abs(gap), off[np.arange(len(row)), axis])
            crossed = (beyond**2).sum(axis=1) <= reach[row]
            row, node, off = np.concatenate([row, row[crossed]]), np.concatenate([near, near[crossed] ^ 1]), np.concatenate([off, beyond[crossed]])
        return row, node - 2**self.depth


def bounds(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        p = points[:, j : j + 1]
        out += np.maximum(0, np.maximum(low[None, :, j] - p, p - high[None, :, j])) ** 2
    return out


def search(space: Space, ids: np.ndarray, x: np.ndarray, own: np.ndarray, queries: np.ndarray, known: np.ndarray, top: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, inner product) of the best found for each query in a block.

    ``own`` has the queries' ids, which aren't their own neighbours; ``known`` the inner
    product that a result has to reach. All queries take their next leaf together."""
    points = space.rows(x)
    leaves = split(points, LEAF_ROWS)
    low, high = (np.array([f(points[r], axis=0) for r in leaves]) for f in (np.min, np.max))
    far = bounds(low, high, space.queries(queries))
    order = np.argsort(far, axis=1, kind="stable")
    best = np.full((len(queries), top), -np.inf)
    best_id = np.full((len(queries), top), -1, np.int64)
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        leaf = order[active, step]
        limit = np.maximum(best[active, -1], known[active])
        stop = far[active, leaf] > ratio * space.distance(queries[active], limit[:, None])[:, 0]
        active, leaf = active[~(stop & np.isfinite(limit))], leaf[~(stop & np.isfinite(limit))]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for rows in np.split(by_leaf, edges):
            members, asked = leaves[leaf[rows[0]]], active[rows]
            inner = queries[asked] @ x[members].T
            inner[own[asked][:, None] == ids[members][None, :]] = -np.inf
            # only queries with a member that could be among their best; equal ones are ranked by id
            nearer = (inner >= np.maximum(best[asked, -1], known[asked])[:, None]).any(axis=1)
            asked, inner = asked[nearer], inner[nearer]
            both = np.concatenate([best[asked], inner], axis=1)
            both_id = np.concatenate([best_id[asked], np.broadcast_to(ids[members], inner.shape)], axis=1)
            ranks = np.lexsort((both_id, -both), axis=1)[:, :top]
            best[asked] = np.take_along_axis(both, ranks, axis=1)
            best_id[asked] = np.take_along_axis(both_id, ranks, axis=1)
    row, place = np.nonzero(np.isfinite(best))
    return row, best_id[row, place], best[row, place]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)


def distinct(rows: DataFrame, most: int) -> DataFrame:
    """(vec_id, x) of the rows with the ``most`` smallest ids of each vector. Equal vectors are ranked
    by id, so with one more than are wanted (a query is left out itself) no result differs, and a
    group of copies takes no more room than that."""

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf = pdf.assign(v=[v.tobytes() for v in pdf["x"]]).drop_duplicates(["vec_id", "v"]).drop(columns="v").sort_values("vec_id")
                yield pdf[(pdf.groupby([v.tobytes() for v in pdf["x"]]).cumcount() < most).to_numpy()]

    ids = F.slice(F.sort_array(F.collect_set("vec_id")), 1, most)
    groups = rows.mapInPandas(smallest, "vec_id long, x array<double>").groupBy("x").agg(ids.alias("ids"))
    return stored(groups.select(F.explode("ids").alias("vec_id"), "x"), "distinct")


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = DEFAULT_TOP, miss: float = MISS, block_rows: int = BLOCK_ROWS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of every row where
    ``is_query`` (a condition on ``vec_id``), among all other rows."""
    result = "query_id long, rank int, vec_id long, score double"
    rows = valid(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return df.sparkSession.createDataFrame([], result)
    size, norm = sizes["size"], math.sqrt(sizes["norm"])
    rows = rows.filter(F.size("x") == size)
    kept = distinct(rows, top + 1)
    n = kept.count()
    space, ratio = Space(size, norm, dimensions), chi_square_quantile(1 - miss, dimensions)
    depth = max(0, math.ceil(math.log2(n / block_rows)))
    blocks = 2**depth

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"p": list(space.rows(_matrix(pdf["x"])))})

    wanted = max(SAMPLE_ROWS, SAMPLE_PER_BLOCK * blocks)
    sample = kept.filter(within_share(F.xxhash64("vec_id", "x"), wanted, n)).select("x").mapInPandas(project, "p array<double>").toPandas()
    splitter = Splitter(_matrix(sample["p"]), depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(block=splitter.block(space.rows(_matrix(pdf["x"]))))

    schema = "vec_id long, x array<double>, block long"
    placed = stored(kept.mapInPandas(place, schema), "placed")

    def find(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        row, found, score = search(space, data["vec_id"].to_numpy(), _matrix(data["x"]), asked["query_id"].to_numpy(), _matrix(asked["q"]), asked["known"].fillna(-np.inf).to_numpy(), top, ratio)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "vec_id": found, "score": score})

    def visit(asked: DataFrame) -> DataFrame:
        """Every block that is asked, with its queries in pieces of about ``QUERY_ROWS``."""
        pieces = asked.groupBy("block").agg(F.count("*").alias("k")).select("block", F.ceil(F.col("k") / QUERY_ROWS).cast("int").alias("pieces"))
        work = asked.join(pieces, "block").select("query_id", "q", "known", "block", F.pmod(F.xxhash64("query_id"), "pieces").cast("int")).toDF("query_id", "q", "known", "work_block", "work_piece")
        data = placed.join(pieces, "block").select("vec_id", "x", "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).toDF("vec_id", "x", "data_block", "data_piece")
        return data.groupBy("data_block", "data_piece").cogroup(work.groupBy("work_block", "work_piece")).applyInPandas(find, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        ordered = F.array_distinct(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))))
        return found.groupBy("query_id").agg(F.slice(ordered, 1, top).alias("best"))

    asked = stored(rows.filter(is_query).mapInPandas(place, schema), "asked").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), "block")
    home = stored(visit(asked.withColumn("known", F.lit(None).cast("double"))), "home")
    kth = best(home).select("query_id", F.when(F.size("best") == top, -F.get("best", F.lit(top - 1))["s"]).alias("known"))
    again = asked.join(kth, "query_id", "left")

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            q, known = _matrix(pdf["q"]), pdf["known"].fillna(-np.inf).to_numpy()
            reach = np.where(np.isfinite(known), ratio * space.distance(q, np.where(np.isfinite(known), known, 0)[:, None])[:, 0], np.inf)
            points, step = space.queries(q), max(1, REACHED_ROWS // blocks)
            for at in range(0, len(pdf), step):  # so few at once that all blocks of all of them fit
                own = pdf.iloc[at : at + step]
                row, block = splitter.reached(points[at : at + step], reach[at : at + step])
                elsewhere = block != own["block"].to_numpy()[row]
                row, block = row[elsewhere], block[elsewhere]
                yield pd.DataFrame({"query_id": own["query_id"].to_numpy()[row], "q": own["q"].to_numpy()[row], "block": block, "known": own["known"].to_numpy()[row]})

    away = visit(again.mapInPandas(others, "query_id long, q array<double>, block long, known double"))
    merged = best(home.union(away)).select("query_id", F.posexplode("best").alias("pos", "b"))
    return merged.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
