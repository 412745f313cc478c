import io
import json
import sys

import pytest

import __spark_entry__ as entry
from colligate.cli import main
from colligate.queries import ORACLE_SQL, QUERIES
from colligate.errors import OptionError
from colligate.operators.pairs import pair
from colligate.plans.weigh import corpus, weigh
from colligate.sources.text import read_units
from colligate.streaming.pairs import count_stream, reweigh, stream_pairs, weigh_counts, write_pairs


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark, tmp_path, capsys):
    units = tmp_path / "units.txt"
    units.write_text("u1 K K A B\nu2 K A B\nu3 A B C\nu4 C D\nu5\n")
    assert main(["pair", "-w", "3", "-a", str(units), "-O", str(tmp_path / "adjacent")]) == 0
    assert main(["pair", str(units)]) == 0
    said = capsys.readouterr()
    assert "u5" in said.err and said.out.startswith("u1\tA\tK\t1\t2\n") and said.out.count("\n") == 10
    pairs = tmp_path / "pairs.tsv"
    pairs.write_text(said.out)
    assert main(["weigh", "-p", "1", "-k", "^K$", "-M", "1", str(pairs)]) == 0
    edges = capsys.readouterr().out
    assert edges.split("\n")[0].startswith("A\tB\t2\t2\t3\t0.287682072452\t2\t3\t0.287682072452\t2\t0.4870880898693746")
    (tmp_path / "edges.tsv").write_text(edges)
    (tmp_path / "c.json").write_text(json.dumps({"format": "json"}))
    assert main(["emit", "-c", str(tmp_path / "c.json"), "-Z", "0", str(tmp_path / "edges.tsv")]) == 0
    assert len(json.loads(capsys.readouterr().out)["edges"]) == 2
    assert main(["weigh", "-p", "1", "-M", "1", "-U", str(tmp_path / "units"), str(pairs)]) == 0
    assert all(line.count("\t") == 11 for line in capsys.readouterr().out.splitlines())
    assert "A\tB\tu1\nA\tB\tu2\nA\tB\tu3\n" in "".join(p.read_text() for p in sorted((tmp_path / "units").glob("part-*")))
    assert main(["weigh", str(pairs)]) == 1
    assert main(["emit", "-c", str(tmp_path / "none.json"), str(pairs)]) == 1


def test_pipes(spark, tmp_path, capsys, monkeypatch):
    def piped(*args, text):
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
        assert main(list(args)) == 0
        return capsys.readouterr()

    monkeypatch.chdir(tmp_path)
    lines = [f"e{i}" for i in range(120)]
    said = piped("pair", text="\n".join([*lines, "u1 K K A B", "u2 ä K A B"]) + "\n")
    assert said.err.count("without a token") == 120 and said.out.count("\n") == 9  # a warning for each
    edges = piped("weigh", "-p", "1", "-M", "1", "-", text=said.out).out
    assert piped("emit", text=edges).out.startswith('graph "G" {')  # no configuration: defaults
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "emit-config.json").write_text('{"format": "md"}')
    assert piped("emit", "-Z", "-9", text=edges).out.startswith("| token1 |")


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("u1 a b a\n# no\nu2 b c\n")
    write_pairs(stream_pairs(spark, str(folder), window=1), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    seen = []
    reweigh(stream_pairs(spark, str(folder)), str(tmp_path / "all"), str(tmp_path / "c2"), lambda e, i: seen.append(e.count()), fields=(1,)).awaitTermination()
    assert seen == [2]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    db = duckdb.connect()
    for t in ("part", "lineitem", "events"):
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    norm = lambda rows: sorted((tuple(float(f"{v:.6g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    want = db.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert norm(map(tuple, got.select(*cols).collect())) == norm(want)


@pytest.mark.parametrize("method", [1, 16])
def test_counts_follow_the_stream(spark, tmp_path, method):
    """Batches that repeat units, patterns and pairs add only what is new; the edges equal those of all pairs at once."""
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [["u1 A/x B/x A/y C/x", "u2 A/x B/y"], ["u2 A/x C/x B/y", "u3 B/x C/x", "u1 A/x B/x"], ["u4 D/x A/y", "u5 D/x"]]
    for i, lines in enumerate(batches):
        (folder / f"{i}.txt").write_text("".join(f"{x}\n" for x in lines))
        count_stream(stream_pairs(spark, str(folder)), str(tmp_path / "counts"), str(tmp_path / "log"), (1,)).awaitTermination()
        rows = lambda e: {(r["pattern1"], r["pattern2"]): tuple(r) for r in e.collect()}
        files = [str(folder / f"{k}.txt") for k in range(i + 1)]
        want, got = rows(weigh(corpus(pair(read_units(spark, *files)), (1,)), None, method)), rows(weigh_counts(spark, str(tmp_path / "counts"), method))
        assert set(got) == set(want)
        for key, row in want.items():
            assert all(a == pytest.approx(b) for a, b in zip(got[key], row, strict=True)), (key, got[key], row)
    with pytest.raises(OptionError):
        weigh_counts(spark, str(tmp_path / "counts"), 7)
