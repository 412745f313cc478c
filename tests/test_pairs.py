import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colligate.errors import OptionError
from colligate.operators import graph, pairs
from colligate.operators.pairs import ordered_pair_counts, pair, pair_counts, pair_table, pair_types
from colligate.sources.text import convert_tagged, parse_units, read_units, rejected_units

METHOD_LINES = ["u1 K K A B", "u2 K A B", "u3 A B C", "u4 C D"]


def units(spark, *lines):
    return parse_units(spark.createDataFrame(list(enumerate(lines)), "ord long, value string"))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


ALL = ("unit_id", "token1", "token2", "fq1", "fq2")


def test_unordered_pairs_once_with_counts(spark):
    got = rows(pair(units(spark, *METHOD_LINES)).orderBy("ord"), *ALL)
    assert got[:3] == [("u1", "A", "K", 1, 2), ("u1", "B", "K", 1, 2), ("u1", "A", "B", 1, 1)]
    assert len(got) == 10 and got[-1] == ("u4", "C", "D", 1, 1)


def test_ordered_keeps_repeats_and_equal_tokens(spark):
    got = sorted(rows(pair(units(spark, "u a b a"), ordered=True), "token1", "token2", "fq1", "fq2"))
    assert got == [("a", "a", 2, 2), ("a", "b", 2, 1), ("b", "a", 1, 2)]


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("window", [1, 2, 4, 50])
def test_windows_against_brute_force(spark, window, ordered):
    lines = ["u1 a b a c b b", "u2 x", "u1 b a", "u3 q q q r"]
    want = []
    for line in lines:
        u, *t = line.split()
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + window + 1)):
                a, b = (t[i], t[j]) if ordered else sorted((t[i], t[j]))
                want.append((u, a, b, t.count(a), t.count(b)))
    assert sorted(rows(pair(units(spark, *lines), window, ordered), *ALL)) == sorted(want)


def test_counts_of_pairs(spark):
    got = rows(pair_counts(pair(units(spark, "u1 a b a b", "u2 a b"), 1, True)).orderBy("token1"), "token1", "token2", "n", "n_units")
    assert got == [("a", "b", 3, 2), ("b", "a", 1, 1)]


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("window", [1, 3])
def test_tables_give_what_units_give(spark, monkeypatch, window, ordered):
    """Units longer than a piece, units of one row, nulls, and an order that isn't the table's."""
    monkeypatch.setattr(pairs, "PIECE_ROWS", 16)
    rng = random.Random(window)
    seqs = {u: [rng.choice("abcd") for _ in range(n)] for u, n in (("u1", 100), ("u2", 1), ("u3", 7), ("u4", 0), ("u5", 40))}
    table = [(u, i, t) for u, seq in seqs.items() for i, t in enumerate(seq)] + [("u1", 500, None), (None, 1, "a")]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "u string, i int, t string")
    lines = [f"{u} {' '.join(seq)}" for u, seq in seqs.items()]
    want = sorted(rows(pair(units(spark, *lines), window, ordered), *ALL))
    assert sorted(rows(pair_table(df, "u", F.col("t"), ["i"], window, ordered), *ALL)) == want
    if ordered and window == 1:
        whole = graph.transitions(units(spark, *(x for x in lines if " " in x.strip())))
        assert sorted(map(tuple, graph.transitions_of_table(df, "u", F.col("t"), ["i"]).collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(OptionError):
        pair_table(df, "u", F.col("t"), ["i"], 0)


def test_many_tokens_in_a_unit(spark):
    t = [f"t{i % 3000}" for i in range(6000)]
    got = pair(units(spark, "u " + " ".join(t)), 1).groupBy("fq1", "fq2").count().collect()
    assert [tuple(r) for r in got] == [(2, 2, 5999)]


def test_invalid_window():
    with pytest.raises(OptionError):
        pair(None, 0)


@pytest.mark.parametrize("ordered", [False, True])
def test_steps_of_long_rows(spark, ordered, monkeypatch):
    rng = random.Random(3)
    t = [f"t{rng.randint(0, 60)}" for _ in range(150)]
    want = [(a, b) for i, a in enumerate(t) for b in t[i + 1 :]] if ordered else [tuple(sorted(p)) for p in itertools.combinations(dict.fromkeys(t), 2)]
    got = pair(units(spark, "u " + " ".join(t), "v x"), ordered=ordered).collect()
    assert [(r["token1"], r["token2"]) for r in got] == want  # also the order
    assert all((r["fq1"], r["fq2"]) == (t.count(r["token1"]), t.count(r["token2"])) for r in got)


def test_rejected_units_come_in_the_same_pass(spark):
    got = pair(units(spark, "e1", "u a b", "one a", "e2"), with_rejected=True).select("unit_id", "token1", "token2").collect()
    assert list(map(tuple, got)) == [("e1", None, None), ("u", "a", "b"), ("e2", None, None)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_of_types_equal_rows(spark, block):
    rng = random.Random(block)
    seqs = {"hot": [rng.choice([f"t{k}" for k in range(40)]) for _ in range(200)], "u": ["a", "b", "a"], "one": ["x"], "two": ["x", "x"]}
    table = [(u, t, "extra") for u, seq in seqs.items() for t in seq] + [("hot", None, ""), (None, "a", "")]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "u string, t string, unit_id string")
    want = sorted(rows(pair(units(spark, *(f"{u} {' '.join(seq)}" for u, seq in seqs.items()))), *ALL))
    assert sorted(rows(pair_types(df, "u", F.col("t"), block), *ALL)) == want
    assert pair_types(df.filter("u = 'no'"), "u", F.col("t"), block).count() == 0


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_ordered_counts_equal_pairs(spark, leaf):
    rng = random.Random(leaf)
    seqs = {f"u{k}": [rng.choice("abcde") for _ in range(rng.randint(0, 9))] for k in range(8)} | {"hot": [rng.choice("abcdef") for _ in range(130)], "many": [f"t{k}" for k in range(20)]}
    table = [(u, i, t) for u, seq in seqs.items() for i, t in enumerate(seq)] + [("hot", 7000, None), (None, 1, "a")]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "u string, i int, t string")
    counts, found = Counter(), set()
    for u, seq in seqs.items():
        for a, b in itertools.combinations(seq, 2):
            counts[a, b] += 1
            found.add((u, a, b))
    own = Counter((a, b) for _, a, b in found)
    got = ordered_pair_counts(df, "u", F.col("t"), ["i"], leaf).collect()
    assert {(r["token1"], r["token2"]): (r["n"], r["n_units"]) for r in got} == {k: (n, own[k]) for k, n in counts.items()}


@pytest.mark.parametrize("piece", [2, 5, 65_536])
def test_runs(spark, monkeypatch, piece):
    monkeypatch.setattr(pairs, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    data = [(rng.choice(["p", "p", "p", "q", None]), rng.choice(["u1", "u2", None]), i) for i in range(60)]
    want, last = Counter(), {}
    for node, unit, _ in data:
        want[node] += node not in last or last[node] != unit
        last[node] = unit
    df = spark.createDataFrame(rng.sample(data, len(data)), "node string, u string, i int")
    assert dict(map(tuple, pairs.run_counts(df, ["node"], "u", ["i"]).collect())) == want
    assert pairs.run_counts(df.filter("i < 0"), ["node"], "u", ["i"]).count() == 0


def test_lines(spark, tmp_path):
    one, two = tmp_path / "1.txt", tmp_path / "2.txt"
    one.write_bytes("# comment\n\n  u1\ta  b\r\nu2\n".encode())
    two.write_bytes("u3 ä\rx y\n".encode())
    got = read_units(spark, str(one), str(two)).orderBy("ord")
    assert rows(got, "unit_id", "tokens") == [("u1", ["a", "b"]), ("u3", ["ä", "x", "y"])]
    assert [r["ord"]["file"] for r in got.collect()] == [0, 1]
    assert rows(rejected_units(units(spark, "u1 a", "u2")), "unit_id") == [("u2",)]


def test_tagged_tokens(spark):
    got = rows(convert_tagged(units(spark, "u 咲き/四-用:咲く:サク/サキ 花/名/ハナ")), "tokens")
    assert got == [(["咲き/咲く/四/サキ", "花/花/名/ハナ"],)]
    with pytest.raises(Exception, match="malformed token"):
        convert_tagged(units(spark, "u a/b")).collect()


def test_empty(spark):
    assert pair(units(spark)).count() == 0
