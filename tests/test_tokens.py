import re

import pytest
from pyspark.sql import functions as F

from colligate.errors import OptionError
from colligate.functions import formats, tokens
from colligate.functions.ere import to_java


def value(spark, column, token):
    return spark.createDataFrame([(token,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "token,chosen,want",
    [
        ("a/b/c/d/e", (4,), "d/e"), ("a/b/c/d", (2, 3, 4), "b/c/d"), ("a", (2, 3), "a"), ("a/b", (2, 4), "b"), ("a//c", (2, 3), "/c"), ("a//c", (2,), ""), ("a/b/c", (3, 1), "a/c"),
    ],
)
def test_projection(spark, token, chosen, want):
    assert value(spark, tokens.project(F.col("t"), chosen), token) == want


@pytest.mark.parametrize("token,chosen,sep,want", [("a/b/c/d/e", (4, 1), ":", "d:a"), ("a", (3,), "/", "a"), ("a/b", (2, 2, 1), "-", "b-a")])
def test_label(spark, token, chosen, sep, want):
    assert value(spark, tokens.label(F.col("t"), chosen, sep), token) == want


def test_fields(spark):
    assert value(spark, tokens.field(F.col("t"), 3), "a/b") is None
    assert value(spark, tokens.field_equals(F.col("t"), 3, "b"), "a/b") is False
    assert value(spark, tokens.field_equals(F.col("t"), 2, "b"), "a/b") is True


@pytest.mark.parametrize("text,want", [("2,3", (2, 3)), ("32", (2, 3)), ("2f/4F", (2, 4)), ("1 : 1", (1,))])
def test_parse_fields(text, want):
    assert tokens.parse_fields(text) == want


@pytest.mark.parametrize("text", ["", ",", "5", "a", "f"])
def test_invalid_fields(text):
    with pytest.raises(OptionError):
        tokens.parse_fields(text)


@pytest.mark.parametrize(
    "pattern,text,found",
    [("^[[:alpha:]]+$", "äb", True), ("^a$", "a\n", False), ("[]x]", "]", True), ("[^]]", "]", False), ("a.c", "a\nc", True), ("", "x", True), ("[a\\d]", "\\", True), ("[a\\d]", "7", False), ("(a|b){2}", "xab", True), ("[[&&]", "&", True)],
)
def test_extended_expressions(spark, pattern, text, found):
    assert value(spark, F.col("t").rlike(to_java(pattern)), text) is found


@pytest.mark.parametrize("pattern", [r"\d", "(?i)a", "a*+", "[a", "[[:nope:]]", "a\\"])
def test_what_is_not_an_extended_expression(pattern):
    with pytest.raises(OptionError):
        to_java(pattern)


def test_escapes():
    assert formats.json_string('a"\\\x01\n') == '"a\\"\\\\\\u0001\\n"'
    assert formats.script_string("</script>") == '"\\u003c/script>"'
    assert formats.dot_string('"\\\n\x02') == '"\\"\\\\\\n\\x02"'
    assert formats.markdown("a|b\\\n") == "a\\|b\\\\ "
    assert formats.html("<&>\"'") == "&lt;&amp;&gt;&quot;&#39;"
    assert formats.tex("a_b\n~^\\") == r"a\_b \textasciitilde{}\textasciicircum{}\textbackslash{}"
    assert re.fullmatch(r"0", formats.g(0.0, 12)) and formats.g(1e-7, 17) == "9.9999999999999995e-08"
