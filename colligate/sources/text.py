"""Units, pairs and edges from text files, and units from tables.

Lines come in the order of the input: files in the order given, those of a folder by name, lines by place. Text is UTF-8, and anything
else is refused; with the encoding ``bytes`` each byte is a character of its own (the first 256 of Unicode), so that
files of any encoding keep their bytes and are compared by them; ``encoded`` gives the bytes back.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.errors import OptionError

BLANKS = " \t\r\n"
COUNT = r"^\+?0*[1-9][0-9]*$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


#: Encodings of text.
UTF8, BYTES = "utf-8", "bytes"
#: Files that are read one by one, so that partitions come in their order; lines of more files are sorted.
MANY_FILES = 256


def _check(encoding: str) -> None:
    if encoding not in (UTF8, BYTES):
        raise OptionError(f"no such encoding: {encoding}")


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path stands for, by name, as patterns that match nothing else."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in sorted(spark.read.text(path).inputFiles())]


def read_lines(spark: SparkSession, paths: Sequence[str], encoding: str = UTF8) -> DataFrame:
    """(ord, value): the lines of the files and folders in the order given, which is also that of the partitions.
    Only a line feed ends one. ``ord`` has the file's number, where the part of it that a task reads starts, and the
    line's place in the partition."""
    _check(encoding)
    files = [f for p in paths for f in _files(spark, p)]
    place, start = F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_block_start").alias("start")
    if len(files) <= MANY_FILES:
        each = [_text(spark, f).select(F.struct(F.lit(i).alias("file"), start, place).alias("ord"), "value") for i, f in enumerate(files)]
        lines = reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], "ord struct<file:int,start:long,line:long>, value string")
    else:
        lines = reduce(DataFrame.unionByName, [_numbered_files(spark, p, i) for i, p in enumerate(paths)]).orderBy("ord")
    if encoding == BYTES:
        return lines.withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return lines.withColumn("value", _fatal(F.is_valid_utf8("value"), F.col("value"), "not UTF-8 (read it as bytes), line", F.to_json(F.col("ord"))))


def _numbered_files(spark: SparkSession, path: str, i: int) -> DataFrame:
    """(ord, value) of a folder of many files: their numbers are joined by name, with as many slashes behind the scheme as there may be."""
    lines, slashes = _text(spark, path), "^([^:/]+):/+"
    names = [re.sub(slashes, r"\1:/", f) for f in sorted(lines.inputFiles())]
    numbers = spark.createDataFrame([(f, (i << 24) + k) for k, f in enumerate(names)], "_path string, file int")
    placed = lines.select(F.regexp_replace("_metadata.file_path", slashes, "$1:/").alias("_path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value")
    return placed.join(F.broadcast(numbers), "_path").select(F.struct("file", "start", "line").alias("ord"), "value")


def encoded(lines: DataFrame, encoding: str, column: str = "line") -> DataFrame:
    """Lines as they are written: of characters that stand for bytes, the bytes."""
    return lines if encoding == UTF8 else lines.withColumn(column, F.encode(column, "ISO-8859-1").cast("string"))


def as_read(text: str, encoding: str) -> str:
    """A string from outside (an argument, a configuration) as the same string is read from files."""
    return text if encoding == UTF8 else text.encode("utf-8", "surrogateescape").decode("latin-1")


def _words(value: Column) -> Column:
    """What blanks separate; runs of them count as one."""
    return F.filter(F.split(value, "[ \t\r\n]+"), lambda x: x != "")


def parse_units(lines: DataFrame) -> DataFrame:
    """(ord, unit_id, tokens) of lines (ord, value); blank lines and comments are left
    out, units without a token kept. Nothing is shuffled, so lines may be a stream."""
    words = lines.withColumn("_w", _words("value")).filter((F.size("_w") > 0) & ~F.startswith(F.get("_w", F.lit(0)), F.lit("#")))
    rest = [F.col(c) for c in lines.columns if c != "value"]
    return words.select(*rest, F.get("_w", F.lit(0)).alias("unit_id"), F.expr("slice(_w, 2, size(_w))").alias("tokens"))


def read_units(spark: SparkSession, *paths: str, encoding: str = UTF8) -> DataFrame:
    """Units that have a token."""
    return parse_units(read_lines(spark, paths, encoding)).filter(F.size("tokens") > 0)


def rejected_units(units: DataFrame) -> DataFrame:
    """(ord, unit_id) of units without a token, of which a warning may be given."""
    return units.filter(F.size("tokens") == 0).select("ord", "unit_id")


def _fatal(holds: Column, value: Column, message: str, *about: Column) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), *(F.coalesce(a.cast("string"), F.lit("")) for a in about))))


def positive_count(text: Column) -> Column:
    """A positive whole number; anything else is an error."""
    return _fatal(F.coalesce(text.rlike(COUNT) & text.try_cast("long").isNotNull(), F.lit(False)), text.try_cast("long"), "not a positive count", text)


def read_pairs(spark: SparkSession, *paths: str, encoding: str = UTF8) -> DataFrame:
    """(ord, unit_id, token1, token2, fq1, fq2) of lines of three or five columns."""
    words = read_lines(spark, paths, encoding).withColumn("w", _words("value")).filter((F.size("w") > 0) & ~F.startswith(F.get("w", F.lit(0)), F.lit("#")))
    at = lambda i: F.get("w", F.lit(i))
    checked = words.withColumn("w", _fatal(F.size("w").isin(3, 5), F.col("w"), "a pair has three or five columns", F.col("value")))
    count = lambda i: F.when(F.size("w") == 5, positive_count(at(i)))
    return checked.select("ord", at(0).alias("unit_id"), at(1).alias("token1"), at(2).alias("token2"), count(3).alias("fq1"), count(4).alias("fq2"))


def _size(text: Column) -> Column:
    return F.when(text.rlike(r"^[ \t]*\+?[0-9]+$"), F.trim(text).try_cast("long"))


def _double(text: Column) -> Column:
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def parse_edges(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Weighted edges of lines (ord, value): the current layout of twelve columns, else the
    legacy one of ten without fq, then unit ids. Current is tried first. ``strict`` also
    asks for ctf > 0, cdf <= ctf, as many unit ids as ctf, and no empty token."""
    cut = lines.withColumn("value", F.regexp_replace("value", "[\r\n]+$", "")).filter("value <> '' and not startswith(value, '#')").withColumn("w", F.split("value", "\t", -1))
    at = lambda i: F.get("w", F.lit(i))
    optional = lambda i: F.struct((F.coalesce(at(i) == "-", F.lit(False)) | _size(at(i)).isNotNull()).alias("ok"), _size(at(i)).alias("v"))
    names = ["ctf", "cdf", "df1", "idf1", "fq1", "df2", "idf2", "fq2", "cw", "z"]

    def decoded(places: Sequence[int | None], width: int) -> Column:
        values, valid = [], [F.size("w") >= width]
        for name, i in zip(names, places, strict=True):
            if i is None:
                values.append(F.lit(None).cast("long").alias(name))
            elif name.startswith("fq"):
                values.append(optional(i)["v"].alias(name))
                valid.append(optional(i)["ok"])
            else:
                value = _double(at(i)) if name in ("idf1", "idf2", "cw", "z") else _size(at(i))
                values.append(value.alias(name))
                valid.append(value.isNotNull())
        units = F.expr(f"slice(w, {width + 1}, size(w))").alias("unit_ids")
        return F.when(reduce(Column.__and__, valid), F.struct(at(0).alias("token1"), at(1).alias("token2"), *values, units))

    current, legacy = decoded([2, 3, 4, 5, 6, 7, 8, 9, 10, 11], 12), decoded([2, 3, 4, 5, None, 6, 7, None, 8, 9], 10)
    edge = F.coalesce(current, legacy)
    rows = cut.select("ord", _fatal(edge.isNotNull(), edge, "not an edge", F.col("value")).alias("e")).select("ord", "e.*")
    if strict:
        fine = "ctf > 0 and cdf <= ctf and size(unit_ids) = ctf and token1 <> '' and token2 <> ''"
        rows = rows.withColumn("token1", _fatal(F.expr(fine), F.col("token1"), "an edge that isn't consistent", F.col("token1"), F.lit(" "), F.col("token2")))
    return rows


def read_edges(spark: SparkSession, *paths: str, strict: bool = False, encoding: str = UTF8) -> DataFrame:
    return parse_edges(read_lines(spark, paths, encoding), strict)


def convert_tagged(units: DataFrame) -> DataFrame:
    """Tokens ``surface/pos[:lemma[:reading of the lemma]]/reading`` as
    ``surface/lemma/pos/reading``, without what follows a hyphen in pos."""

    def convert(token: Column) -> Column:
        parts = F.split(token, "/")
        info = F.split(F.get(parts, F.lit(1)), ":")
        surface = F.get(parts, F.lit(0))
        lemma = F.coalesce(F.nullif(F.get(info, F.lit(1)), F.lit("")), surface)
        whole = F.concat_ws("/", surface, lemma, F.regexp_replace(F.get(info, F.lit(0)), "-.*", ""), F.get(parts, F.lit(2)))
        return _fatal(F.size(parts) == 3, whole, "malformed token", token)

    return units.withColumn("tokens", F.transform("tokens", convert))


def units_from_table(df: DataFrame, unit: str, token: Column, order: Sequence[str | Column]) -> DataFrame:
    """(ord, unit_id, tokens) with a unit per value of ``unit`` and its rows' tokens in order.
    ``ord`` follows the unit ids. A unit's tokens come together in one row, so units are
    what fits into one: baskets, sessions, documents."""
    place = F.struct(*(F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)), token.alias("t"))
    rows = df.filter(F.col(unit).isNotNull() & token.isNotNull()).groupBy(unit).agg(F.sort_array(F.collect_list(place)).alias("_rows"))
    return rows.select(F.xxhash64(unit).alias("ord") if dict(df.dtypes)[unit] == "string" else F.col(unit).cast("long").alias("ord"), F.col(unit).cast("string").alias("unit_id"), F.col("_rows.t").alias("tokens"))
