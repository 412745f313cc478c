"""Samples and top lists are cut before rows leave their partitions."""

import pytest
from pyspark.sql import functions as F

from colligate.llm import jaccard, quality, toxicity
from colligate.llm.common import within_share


@pytest.mark.parametrize("wanted", [1, 500, 5_000, 20_000, 30_000])
def test_share_of_hashes(spark, wanted):
    n = 20_000
    got = spark.range(n).filter(within_share(F.xxhash64("id"), wanted, n)).count()
    assert got == n if wanted >= n else abs(got - wanted) <= 6 * wanted**0.5 + 3


def test_smallest_hashes_are_those_of_a_full_sort(spark):
    rows = spark.range(20_000).select(F.col("id").alias("_id"), F.xxhash64("id").alias("_h"))
    for most in (0, 1, 300, 20_000, 30_000):
        want = sorted(map(tuple, rows.select("_h", "_id").collect()))[:most]
        assert sorted(map(tuple, toxicity._first(rows, most, 20_000).select("_h", "_id").collect())) == want


def test_sample_of_texts_whatever_the_ids(spark):
    df = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("m"))
    sample = quality.sampled(df)
    assert abs(sample.count() - quality.SAMPLE_ROWS) < 6 * quality.SAMPLE_ROWS**0.5
    assert sample.rdd.getNumPartitions() == quality.SAMPLE_TASKS
    assert "SinglePartition" not in sample._jdf.queryExecution().executedPlan().toString()
    assert quality.sampled(df.limit(3)).count() == 3 and quality.sampled(df.limit(0)).count() == 0


@pytest.mark.parametrize("kept", [0, 1, 7, 40, 1000])
def test_most_frequent_shingles(spark, monkeypatch, kept):
    monkeypatch.setattr(jaccard, "FREQUENT_KEPT", kept)
    counts = [(i, 24 + i * i % 977) for i in range(300)]
    got = sorted(map(tuple, jaccard._most_frequent(spark.createDataFrame(counts, "token long, df long")).collect()))
    assert len(got) <= kept
    least = min((d for _, d in got), default=10**9)
    assert got == [x for x in counts if x[1] >= least]
    if kept >= 300:
        assert got == counts
