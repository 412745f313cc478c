"""Lines and pieces as data sources."""

import random

import pytest
from pyspark.sql import functions as F

from colligate.operators.pairs import pair
from colligate.plans.weigh import corpus, edge_units, weigh, with_unit_ids
from colligate.sinks import graph as sinks
from colligate.sources import files
from colligate.sources.text import BYTES, parse_edges, parse_units


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_splits_have_each_line_once(tmp_path, monkeypatch, size):
    rng = random.Random(size)
    monkeypatch.setattr(files, "READ_BYTES", rng.choice([1, 3, 50]))
    for k, data in enumerate([b"", b"a", b"\n", b"a\n", b"a\nbb\n\nccc", b"\n\n\n", b"\xff\r\n" * 9, b"".join(bytes([rng.choice(b"ab\n")]) for _ in range(200))]):
        path = tmp_path / f"{k}.txt"
        path.write_bytes(data)
        found = [x for s in files.splits_of(str(path), files.files_of(str(path)), 0, size) for x in files.lines_in(s)]
        want, at = [], 0
        for line in data.split(b"\n"):
            if at < len(data):
                want.append((at, line))
            at += len(line) + 1
        assert found == want


def test_lines_of_folders(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "b").mkdir(parents=True)
    (folder / "b" / "2.txt").write_bytes("u2 埼 崎\nu3\n".encode("shift_jis"))
    (folder / "a.txt").write_text("# no\nu1 a b a\n")
    (folder / "_SUCCESS").write_text("hidden")
    got = parse_units(files.read_source(spark, str(folder), BYTES, 3)).orderBy("ord").collect()
    assert [(r["ord"]["file"], r["ord"]["start"], r["unit_id"], len(r["tokens"])) for r in got] == [(0, 5, "u1", 3), (1, 0, "u2", 2), (1, 9, "u3", 0)]
    assert [t.encode("latin-1").decode("shift_jis") for t in got[1]["tokens"]] == ["埼", "崎"]
    with pytest.raises(Exception, match="not UTF-8"):
        files.read_source(spark, str(folder)).collect()
    with pytest.raises(Exception, match="no such file"):
        files.read_source(spark, str(tmp_path / "none")).collect()


def test_streamed_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        pairs = pair(parse_units(files.stream_source(spark, str(folder))).filter(F.size("tokens") > 0))
        pairs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["ord"]["file"], r["unit_id"], r["token1"], r["token2"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "z.txt").write_text("u1 a b\n")
    assert run() == [(0, "u1", "a", "b")]
    (folder / "a.txt").write_text("u2 b c\n")  # sorted before what was read, yet new
    assert run() == [(0, "u1", "a", "b"), (1, "u2", "b", "c")]
    assert len(run()) == 2


def test_pieces_of_edges_equal_lines(spark, tmp_path):
    rng = random.Random(5)
    lines = [f"u{k} " + " ".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 6))) for k in range(300)]
    units = parse_units(spark.createDataFrame(list(enumerate(lines)), "ord long, value string"))
    c = corpus(pair(units), (1,))
    edges = sinks.numbered(weigh(c, None, 16), "pattern1", "pattern2")
    want = "".join(r["line"] + "\n" for r in sinks.edge_lines(with_unit_ids(edges, c)).orderBy("row").collect())
    pieces = sinks.edge_pieces(edges, edge_units(c))
    out = tmp_path / "out"
    files.write_pieces(pieces.repartitionByRange(3, "row").sortWithinPartitions("row", "place", "ord").select("text"), str(out))
    parts = sorted(out.glob("part-*"))
    assert "".join(p.read_text() for p in parts) == want and len(want) > 4000
    assert all(p.read_text().endswith("\n") for p in parts if p.stat().st_size)
    assert {p.name for p in out.iterdir()} == {*(p.name for p in parts), "_SUCCESS"}
    assert parse_edges(files.read_source(spark, str(out))).count() == want.count("\n")


def test_failed_pieces_leave_nothing(spark, tmp_path):
    out = tmp_path / "out"
    bad = spark.range(4).select(F.when(F.col("id") < 3, "x").otherwise(F.raise_error(F.lit("no"))).alias("text"))
    with pytest.raises(Exception):
        files.write_pieces(bad, str(out))
    assert not out.exists() or not any(out.iterdir())
