"""Order and bytes of text sources."""

import itertools
import random
import sys

import pytest

from colligate.cli import main
from colligate.sources import text
from colligate.sources.text import BYTES, encoded, read_lines, read_units


def folder_of(tmp_path, *parts):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, lines in enumerate(parts):
        (folder / f"part-{i:05}").write_bytes("".join(f"{x}\n" for x in lines).encode())
    return folder


@pytest.mark.parametrize("many", [256, 2])
def test_folders_are_read_by_name(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(text, "MANY_FILES", many)
    rng = random.Random(1)
    parts = [[f"u{i}_{k} {'x' * rng.randint(0, 30)}" for k in range(n)] for i, n in enumerate((1, 500, 2, 90))]
    folder = folder_of(tmp_path, *parts)
    odd = tmp_path / "a [1] é%20{b}.txt"
    odd.write_text("first a\n")
    want = ["first a", *(x for p in parts for x in p), "first a"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = read_lines(spark, [str(odd).replace("[", "\\[").replace("{", "\\{"), str(folder), str(tmp_path / "a *.txt")])
        assert [r["value"] for r in lines.collect()] == want  # partitions come in order
        assert [r["value"] for r in lines.orderBy("ord").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert read_lines(spark, [str(tmp_path / "none")]).count() == 0
    assert read_lines(spark, []).count() == 0


def test_other_encodings_are_refused_or_kept(spark, tmp_path):
    path = tmp_path / "sjis.txt"
    path.write_bytes("u1 埼 崎 a\n".encode("shift_jis"))  # 8D E9, 8D E8
    with pytest.raises(Exception, match="not UTF-8"):
        read_units(spark, str(path)).collect()
    tokens = read_units(spark, str(path), encoding=BYTES).first()["tokens"]
    assert [t.encode("latin-1").decode("shift_jis") for t in tokens] == ["埼", "崎", "a"]
    encoded(read_lines(spark, [str(path)], BYTES).selectExpr("value as line"), BYTES).write.text(str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))) == path.read_bytes()


def whole(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


UNITS = ["u1 埼/a/N/k 崎/b/N/k 表/c/V/k 表/c/V/k", "u2 埼/a/N/k 崎/b/N/k", "u3", "u4 表/c/V/k 能/d/N/k 埼/a/N/k"]


@pytest.mark.parametrize("encoding", ["shift_jis", "utf-8"])
def test_chains_over_folders_keep_bytes_and_order(spark, tmp_path, capsysbinary, encoding):
    """pair, weigh and emit over folders of unequal parts give the bytes that they give over one file; of UTF-8 the same bytes as
    when it is read as such."""
    one = tmp_path / "one.txt"
    one.write_bytes("".join(f"{x}\n" for x in UNITS).encode(encoding))
    cut = tmp_path / "cut"
    cut.mkdir()
    for i, (a, b) in enumerate(((0, 1), (1, 3), (3, 4))):
        (cut / f"part-{i}").write_bytes("".join(f"{x}\n" for x in UNITS[a:b]).encode(encoding))
    config = tmp_path / "c.json"
    config.write_text('{"format": "md", "table": {"columns": ["token1", "raw_token2", "ctf", "unit_ids"], "headers": ["語"], "label_fields": [1, 3]}}', encoding="utf-8")
    key = "^埼".encode(encoding).decode(sys.getfilesystemencoding(), "surrogateescape")

    def chain(source, name, *options):
        assert main(["pair", str(source), "-O", str(tmp_path / f"{name}-pairs"), *options]) == 0
        assert b"u3" in capsysbinary.readouterr().err
        assert main(["weigh", "-p", "1,3", "-M", "1", "-k", key, str(tmp_path / f"{name}-pairs"), "-O", str(tmp_path / f"{name}-edges"), *options]) == 0
        assert main(["emit", "-c", str(config), str(tmp_path / f"{name}-edges"), *options]) == 0
        return whole(tmp_path / f"{name}-pairs"), whole(tmp_path / f"{name}-edges"), capsysbinary.readouterr().out

    got = chain(cut, "cut", "-E", "bytes")
    assert got == chain(one, "one", *(() if encoding == "utf-8" else ("-E", "bytes")))
    pairs = []
    for line in UNITS:
        unit, *tokens = line.encode(encoding).split()
        for a, b in itertools.combinations(dict.fromkeys(tokens), 2):
            a, b = min(a, b), max(a, b)
            pairs.append(b"\t".join([unit, a, b, b"%d" % tokens.count(a), b"%d" % tokens.count(b)]))
    assert got[0] == b"".join(p + b"\n" for p in pairs)
    assert got[2].startswith("| 語 |".encode()) and "埼/N".encode(encoding) in got[2]
    assert main(["pair", str(one), "-O", str(tmp_path / "one-pairs")]) == 1  # exists
