import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colligate.operators import pairs


@pytest.mark.parametrize(("blocks", "largest"), [(1, 100), (3, 100), (4, 5)])
def test_blocks_grow_with_the_unit(spark, monkeypatch, blocks, largest):
    monkeypatch.setattr(pairs, "BLOCKS", blocks)
    monkeypatch.setattr(pairs, "LARGEST_BLOCK", largest)
    held = {"large": [f"t{i * i % 61}" for i in range(90)], "two": ["é", "z", "é"], "one": ["a"]}
    df = spark.createDataFrame([(u, t) for u, own in held.items() for t in own], "u string, t string")
    want = sorted((u, a, b, n[a], n[b]) for u, own in held.items() for n in [Counter(own)] for a, b in itertools.combinations(sorted(n), 2))
    got = pairs.pair_types(df, "u", F.col("t"), 1)
    assert sorted(map(tuple, got.collect())) == want


def test_pairs_leave_one_by_one(spark):
    """Pairs come out of a merge join: exploded arrays would hold all pairs of a cell in memory, and a broadcast all copies."""
    df = spark.createDataFrame([("u", f"t{i}") for i in range(50)], "u string, t string")
    got = pairs.pair_types(df, "u", F.col("t"), 8)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    above, _, _ = plan.partition("SortMergeJoin")
    assert "SortMergeJoin [unit_id" in plan and "Generate" not in above
    assert got.count() == 50 * 49 // 2
