"""Pairs of a stream of unit lines, and weights that follow it.

Pairing happens inside a line, so a stream of pairs needs no state. Weights need the whole corpus. ``count_stream`` keeps what they are made of
up to date: a state store remembers which units, patterns, tokens and pairs of patterns of a unit were seen, and each
batch adds the counts of those that are new, so that a batch costs what arrives in it; ``weigh_counts`` gives
the edges so far, equal to those of all pairs at once. Weights with a key depend on which units it selects, which later pairs may
change: ``reweigh`` computes them anew from all that has arrived.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colligate.errors import OptionError
from colligate.functions.tokens import DEFAULT_FIELDS, project
from colligate.operators.pairs import pair
from colligate.plans.weigh import KEYED, METHODS, corpus, scored_edges, weigh
from colligate.sources.text import parse_units


def stream_units(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(unit_id, tokens) of text files that arrive in a folder."""
    lines = spark.readStream.format("text").option("lineSep", "\n").options(**options).load(folder)
    return parse_units(lines).filter(F.size("tokens") > 0)


def stream_pairs(spark: SparkSession, folder: str, window: int | None = None, ordered: bool = False, **options: str) -> DataFrame:
    """(unit_id, token1, token2, fq1, fq2) of such files."""
    return pair(stream_units(spark, folder, **options), window, ordered)


def write_pairs(pairs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends pairs as Parquet, exactly once."""
    return pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def reweigh(pairs: DataFrame, path: str, checkpoint: str, use: Callable[[DataFrame, int], None], trigger: dict | None = None, **options) -> StreamingQuery:
    """Appends each batch of pairs to ``path`` and hands ``use`` the edges of all that is there.
    A batch that is repeated after a failure replaces its own folder. Rows are in the order of the
    batches, and of the rows in each."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch={number}")
        all_pairs = df.sparkSession.read.parquet(path).withColumn("ord", F.struct("batch", "place"))
        fields = options.get("fields")
        use(weigh(corpus(all_pairs, fields) if fields else corpus(all_pairs), options.get("key"), options.get("method", 16)), number)

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _facts(pairs: DataFrame, fields: Sequence[int]) -> DataFrame:
    """(kind, unit_id, a, b, cnt): what each pair of a unit says: there is the unit, there are patterns, tokens with
    their counts, and a pair of patterns."""
    none = F.lit(None).cast("string")

    def fact(kind: str, a=none, b=none, cnt=F.lit(None)):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), cnt.cast("long").alias("cnt"))

    p, q = F.col("_p"), F.col("_q")
    sides = [x for pattern, i in ((p, 1), (q, 2)) for x in (fact("pattern", pattern), fact("token", pattern, F.col(f"token{i}"), F.col(f"fq{i}")))]
    known = pairs.withColumns({"_p": project(F.col("token1"), fields), "_q": project(F.col("token2"), fields)})
    both = F.when(p != q, fact("pair", F.least(p, q), F.greatest(p, q)))
    return known.select("unit_id", F.explode(F.array_compact(F.array(fact("unit"), *sides, both))).alias("f")).select("f.kind", "unit_id", "f.a", "f.b", "f.cnt")


def count_stream(pairs: DataFrame, path: str, checkpoint: str, fields: Sequence[int] = DEFAULT_FIELDS, trigger: dict | None = None) -> StreamingQuery:
    """Adds the counts of a stream of pairs to the folder ``path``. A batch that is repeated after a failure replaces its own
    counts. Of a token's counts in a unit the one seen first holds; within a batch, any, as they are equal in valid input."""
    new = _facts(pairs, fields).dropDuplicates(["kind", "unit_id", "a", "b"])

    def batch(df: DataFrame, number: int) -> None:
        _summed(df.withColumn("n", F.lit(1)).withColumn("known", F.col("cnt").isNotNull())).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("cnt").alias("cnt"), F.bool_and("known").alias("known"))


def weigh_counts(spark: SparkSession, path: str, method: int = 16) -> DataFrame:
    """The edges of what ``count_stream`` has counted, by a method without a key."""
    if method not in METHODS or method in KEYED:
        raise OptionError(f"no method without a key: {method}")
    counts = _summed(spark.read.parquet(path))
    own = lambda kind: counts.filter(F.col("kind") == kind)
    tokens = own("token").groupBy(F.col("a").alias("pattern")).agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("token"), F.sum("cnt").alias("cnt"), F.bool_and("known").alias("known"))
    df = own("pattern").select(F.col("a").alias("pattern"), F.col("n").alias("df"))
    stats = tokens.join(df, "pattern").crossJoin(F.broadcast(own("unit").select("n")))
    stats = stats.withColumns({"idf": F.log(F.col("n") / F.col("df")), "fq_local": F.when(F.col("known"), F.col("cnt"))})
    return scored_edges(stats, own("pair").select(F.col("a").alias("pattern1"), F.col("b").alias("pattern2"), F.col("n").alias("gdf"), F.col("n").alias("ctf")), method)
