"""Connected components, and the smallest id of a group, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligate.llm.common import discard, stored

#: Parts that the rows of one key are dealt to while their smallest is found.
SALTS = 256


def with_first(df: DataFrame, key: Column, order: Column, wanted: Column) -> DataFrame:
    """Adds ``first``: the smallest ``order`` among the rows of the same ``key``
    where ``wanted`` holds, else null. Rows of a frequent key are dealt to
    ``SALTS`` parts, and each part learns the smallest of all parts."""
    rows = df.withColumns({"_key": F.when(wanted, key), "_order": order}).withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(SALTS)))
    parts = rows.filter("_key is not null").groupBy("_key", "_salt").agg(F.min("_order").alias("first"))
    first = parts.groupBy("_key").agg(F.min("first").alias("first"), F.collect_list("_salt").alias("_salts")).select("_key", F.explode("_salts").alias("_salt"), "first")
    return rows.join(first, ["_key", "_salt"], "left").drop("_key", "_salt", "_order")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of ``links`` (a, b).

    Labels sink to the smallest neighbour's and then to their label's label, until
    none changes; each round is written to the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        sunk = labels.join(near, "id").select("id", "component", F.least("component", "c").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("d"))
        new = stored(sunk.join(up, "c", "left").select("id", F.col("component").alias("old"), F.least("c", F.coalesce("d", "c")).alias("component")), "labels")
        discard(last)
        if new.filter("old <> component").isEmpty():
            discard(both)
            return new.select("id", "component")
        last, labels = new, new.select("id", "component")
