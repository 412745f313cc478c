import re

import pytest
from pyspark.sql import functions as F

from colligate.errors import OptionError
from colligate.plans import weigh as w
from colligate.queries import QUERIES
from colligate.sources.text import parse_units, units_from_table


def test_units_are_put_together_once(spark):
    lines = ["u1 a/x b/y a/x c/x", "u2 b/y a/x", "u3 c/x c/z", "u4 a/x a/x", "u5 d"]
    c = w.corpus_of_units(parse_units(spark.createDataFrame(list(enumerate(lines)), "ord long, value string")), (2,), one_row=True)
    got = {r["unit_id"]: (r["p"], [tuple(t) for t in r["tokens"]]) for r in c.patterns.collect()}
    assert got == {
        "u1": (["x", "y"], [("x", "a/x", 2), ("x", "c/x", 1), ("y", "b/y", 1)]),
        "u2": (["x", "y"], [("x", "a/x", 1), ("y", "b/y", 1)]),
        "u3": (["x", "z"], [("x", "c/x", 1), ("z", "c/z", 1)]),
    }
    # what is read afterwards is that table, not the lines
    for df in (c.tokens, c.pairs, c.units):
        assert {p.rsplit("/", 1)[0] for p in df.inputFiles()} == {p.rsplit("/", 1)[0] for p in c.patterns.inputFiles()} != set()
    assert sorted((r["unit_id"], r["token"], r["first"]) for r in c.tokens.collect() if r["unit_id"] == "u1") == [("u1", "a/x", True), ("u1", "b/y", True), ("u1", "c/x", False)]


@pytest.mark.parametrize(("fields", "method"), [((2,), 16), ((1, 2), 1), ((2,), 1)])
def test_numbered_tables_weigh_alike(spark, fields, method):
    """Tokens that share a pattern, come twice or stand alone; a token of two keys, and rows without a unit or a token."""
    named = {1: "b/x", 2: "a/x", 3: "é/y", 4: "c/z", 5: "a/x", 6: None, 7: "d/w", 8: "z/é"}
    held = {1: [1, 2, 3, 3], 2: [2, 5], 3: [1, 3, 4, 6], 4: [4, 4, 7], 5: [8], 6: [5, 8, 3, 9], 7: [1, 4, 7, 8], 8: [2, 3], None: [1, 3]}
    rows = spark.createDataFrame([(u, k) for u, own in held.items() for k in own], "u long, k long")
    tokens = spark.createDataFrame(list(named.items()), "k long, token string")
    units = units_from_table(rows.join(tokens, "k"), "u", F.col("token"), ["k"])
    want = w.weigh(w.corpus_of_units(units, fields, one_row=True), None, method)
    got = w.weigh_table(rows, "u", "k", tokens, fields, method)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert shown(got) == shown(want) != []
    with pytest.raises(OptionError):
        w.weigh_table(rows, "u", "k", tokens, fields, 7)


def test_pairs_of_surface_forms_are_numbers(spark):
    """What is gathered by pairs is not their text, of which there are some hundred bytes in each."""
    plan = QUERIES["cw_surface"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[\w+#\d+L, \w+#\d+L\]", plan) and "Aggregate [pattern1" not in plan


@pytest.mark.parametrize(("often", "tasks"), [(1, 1), (6, 2), (10_000, 1)])
def test_rare_pairs_are_shuffled_once(spark, monkeypatch, often, tasks):
    """Pairs of rare patterns go to their first pattern's token without being counted before; those of frequent ones are combined first."""
    monkeypatch.setattr(w, "OFTEN", often)
    held = {1: "abcd", 2: "ab", 3: "ace", 4: "af", 5: "bcg", 6: "ah", 7: "bd"}
    rows = spark.createDataFrame([(u, ord(k)) for u, own in held.items() for k in own], "u long, k long")
    tokens = spark.createDataFrame([(ord(k), f"{k}/x{k}") for k in "abcdefghij"], "k long, token string")
    want = w.weigh(w.corpus_of_units(units_from_table(rows.join(tokens, "k"), "u", F.col("token"), ["k"]), (1,), one_row=True), None, 16)
    got = w.weigh_table(rows, "u", "k", tokens, (1,), 16)
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert shown(got) == shown(want) and len(shown(got)) == 12
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [p1") == 2 * (often < 10_000)  # of edges, and of their mean
    assert plan.count("Aggregate [p1") == 2 * tasks
