"""Commands: ``pair``, ``weigh`` and ``emit``, over files that Spark reads.

``python -m colligate.cli pair [-a | -w N] [-o | -u] [-E ENCODING] [-O OUT] [FILE...]``
``python -m colligate.cli weigh [-p FIELDS | -s] [-k REGEX] [-M METHOD] [-U UNITS] [-E ENCODING] [-O OUT] [FILE]``
``python -m colligate.cli emit [-c CONFIG] [-T FORMAT] [-W MIN_CW] [-Z MIN_Z] [-E ENCODING] [-O OUT] [FILE]``

Without a file, or for ``-``, standard input is read: it is copied to the shared folder, piece by piece,
so that Spark can read it in parallel. Without ``-O`` the result goes to standard output. Of contradicting
options the last wins. ``-U`` writes the units of each edge as rows (patterns and unit id) to a folder, and leaves
them out of the edges' lines: for edges with more units than a line should hold. ``-E bytes`` reads and writes files of any encoding
byte by byte; otherwise text is UTF-8.
"""

from __future__ import annotations

import argparse
import math
import os
import re
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate import ship
from colligate.errors import ColligateError, OptionError
from colligate.functions.tokens import DEFAULT_FIELDS, parse_fields
from colligate.operators.pairs import pair
from colligate.plans.config import Config, as_read_config, load_config, override
from colligate.plans.weigh import KEYED, corpus, edge_units, weigh
from colligate.sinks import graph as sinks
from colligate.sinks.store import shared_folder
from colligate.sources.files import write_pieces
from colligate.sources.text import BYTES, UTF8, as_read, encoded, parse_units, read_edges, read_lines, read_pairs

VERSION = "0.1.0"
#: Where a configuration is looked for if none is named; without that file, defaults hold.
DEFAULT_CONFIG = "config/emit-config.json"
#: Bytes of standard input that are copied at once.
PIECE = 1 << 20
#: The setting of how many files a task may have open.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def positive(text: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) < 1:
        raise argparse.ArgumentTypeError(f"not a positive whole number: {text}")
    return int(text)


def number(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not math.isfinite(value):
        raise argparse.ArgumentTypeError(f"not a number: {text}")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="colligate")
    top.add_argument("-v", "--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("pair", help="pairs of the tokens of each unit")
    p.add_argument("-a", "--adjacent", dest="window", action="store_const", const=1)
    p.add_argument("-w", "--window", dest="window", type=positive)
    p.add_argument("-o", "--ordered", dest="ordered", action="store_true")
    p.add_argument("-u", "--unordered", dest="ordered", action="store_false")
    w = commands.add_parser("weigh", help="weighted edges of pairs")
    w.add_argument("-p", "--pattern-fields", dest="fields", type=str)
    w.add_argument("-s", "--surface", dest="fields", action="store_const", const="1,2,3,4")
    w.add_argument("-k", "--key")
    w.add_argument("-M", "--method", type=int, default=7)
    w.add_argument("-U", "--units", help="a folder for the units of each edge")
    e = commands.add_parser("emit", help="a graph or table of edges")
    e.add_argument("-c", "--config")
    e.add_argument("-T", "--format")
    e.add_argument("-W", "--min-cw", type=number)
    e.add_argument("-Z", "--min-z", type=number)
    for c in (p, w, e):
        c.add_argument("-E", "--encoding", choices=[UTF8, BYTES], default=UTF8)
        c.add_argument("-O", "--output", help="a folder for text files")
        c.add_argument("files", nargs="*" if c is p else "?", default=[] if c is p else "-")
    return top


def _paths(spark: SparkSession, files: list[str] | str) -> list[str]:
    """The files; standard input, once, as a file in the shared folder."""
    named = [files] if isinstance(files, str) else files or ["-"]
    copied = _copied_input(spark) if "-" in named else ""
    return [copied if f == "-" else f for f in named]


def _copied_input(spark: SparkSession) -> str:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/input-{uuid.uuid4().hex}.txt")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    while piece := sys.stdin.buffer.read(PIECE):
        out.write(bytearray(piece))
    out.close()
    return path.toString()


def _print(line: str, encoding: str, end: str = "\n") -> None:
    if encoding == UTF8:
        sys.stdout.write(line + end)
    else:
        sys.stdout.flush()
        sys.stdout.buffer.write((line + end).encode("latin-1"))


def _out(lines: DataFrame, args: argparse.Namespace, *order: str) -> None:
    lines = lines.orderBy(*order)
    if args.output:
        encoded(lines.select("line"), args.encoding).write.text(args.output)
        return
    for row in lines.toLocalIterator():
        _print(row["line"], args.encoding)


def _warn(unit: str) -> None:
    print(f"colligate: unit without a token: {unit}", file=sys.stderr)


def _pair(units: DataFrame, args: argparse.Namespace) -> None:
    """Writes pairs, and warns of units without a token, in one pass over the units and in their order."""
    spark, found = units.sparkSession, pair(units, args.window, args.ordered, with_rejected=True)
    lines = sinks.pair_lines(found, "token1 is null")
    if not args.output:
        for row in lines.toLocalIterator():
            _warn(row["line"]) if row["rejected"] else _print(row["line"], args.encoding)
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, both = hadoop(args.output), hadoop(f"{args.output.rstrip('/')}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise OptionError(f"{args.output} exists")
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, 2)  # two files are open at once, so that rows aren't sorted
    try:
        encoded(lines, args.encoding).write.partitionBy("rejected").text(both.toString())
    finally:
        spark.conf.set(WRITERS, before)
    own = hadoop(both, "rejected=false")
    fs.rename(own, target) if fs.exists(own) else fs.mkdirs(target)
    fs.create(hadoop(target, "_SUCCESS")).close()
    if fs.exists(hadoop(both, "rejected=true")):
        for row in read_lines(spark, [hadoop(both, "rejected=true").toString()], args.encoding).toLocalIterator():
            _warn(row["value"])
    fs.delete(both, True)


def _weighed(pieces: DataFrame, args: argparse.Namespace) -> None:
    """Writes edges whose lines come in pieces; a line stays in one file, and a task sorts its pieces without holding them."""
    if args.output:
        ranges = pieces.repartitionByRange("row").sortWithinPartitions("row", "place", "ord")
        write_pieces(encoded(ranges.select("text"), args.encoding, "text").select(F.col("text").cast("binary")), args.output)
        return
    for row in pieces.orderBy("row", "place", "ord").toLocalIterator():
        _print(row["text"], args.encoding, "")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    ship(spark)
    if args.command == "pair":
        _pair(parse_units(read_lines(spark, _paths(spark, args.files), args.encoding)), args)
    elif args.command == "weigh":
        fields = parse_fields(args.fields) if args.fields is not None else DEFAULT_FIELDS
        if args.method in KEYED and args.key is None:
            raise OptionError(f"method {args.method} needs a key")
        c = corpus(read_pairs(spark, *_paths(spark, args.files), encoding=args.encoding), fields)
        args.key = args.key and as_read(args.key, args.encoding)
        edges = weigh(c, args.key, args.method)
        edges = sinks.numbered(edges, "pattern1", "pattern2")
        if args.units:
            rows = edge_units(c, args.key).orderBy("pattern1", "pattern2", "ord")
            encoded(rows.select(F.concat_ws("\t", "pattern1", "pattern2", "unit_id").alias("line")), args.encoding).write.text(args.units)
            _out(sinks.edge_lines(edges.withColumn("unit_ids", F.lit(None).cast("array<string>"))), args, "row")
        else:
            _weighed(sinks.edge_pieces(edges, edge_units(c, args.key)), args)
    else:
        config, path = Config(), args.config or DEFAULT_CONFIG
        if args.config or os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                config = load_config(f.read(), path)
        config = as_read_config(override(config, args.format, args.min_cw, args.min_z), lambda x: as_read(x, args.encoding))
        edges = sinks.numbered(read_edges(spark, *_paths(spark, args.files), encoding=args.encoding), "ord")
        _out(sinks.lines(edges, config), args, "section", "row")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("colligate").getOrCreate()
    try:
        run(spark, args)
    except (ColligateError, OSError) as e:
        print(f"colligate: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # errors that rows raise come wrapped by Spark
        said = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?) SQLSTATE", str(e), re.DOTALL)
        if said is None:
            raise
        print(f"colligate: {said[1]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
