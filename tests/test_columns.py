"""Column expressions against the functions of Python."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from colligate.functions import columns, formats


def numbers(n, seed):
    rng = random.Random(seed)
    out = [0.0, -0.0, math.inf, -math.inf, math.nan, None, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.5, 2.5, 3.5, 0.125, 1e15, 1e16, 1e17, 123456.5, 999999.5, 9999995.0, 1e-4, 9.9999995e-5, 1e22, 1e23, 0.1]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.02:
            out.append(struct.unpack("d", rng.randbytes(8))[0])
        elif kind < 0.03:
            out.append(rng.randrange(1 << 52) * 5e-324)
        elif kind < 0.2:
            out.append(math.nextafter(10.0 ** rng.randrange(-5, 18), rng.choice([0.0, math.inf])))
        elif kind < 0.6:
            out.append(rng.randrange(-(10**7), 10**7) / 2 ** rng.randrange(24))
        elif kind < 0.85:
            out.append(float(f"{rng.randrange(1, 10**6)}5e{rng.randrange(-12, 16)}"))
        else:
            out.append(rng.uniform(-20, 20))
    return out


@pytest.mark.parametrize("digits", [0, 1, 2, 6, 12, 15, 16, 17])
def test_g(spark, digits):
    values = numbers(4_000, digits)
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(4)
    got = {r["i"]: r["t"] for r in columns.with_g(df, [("x", digits)]).withColumnRenamed(columns.g_name("x", digits), "t").collect()}
    for i, x in enumerate(values):
        assert got[i] == (None if x is None else formats.g(x, digits)), x


@pytest.mark.parametrize("name", ["json_string", "script_string", "dot_string", "markdown", "html", "tex"])
def test_escapes(spark, name):
    rng = random.Random(name)
    signs = [*map(chr, range(32)), *"\\\\\\\"'<>&|{}$#_%~^ab /é 😀\x7f"]
    values = ["", *("".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(2_000))]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    got = dict(df.select("i", getattr(columns, name)(F.col("x"))).collect())
    assert got == {i: getattr(formats, name)(x) for i, x in enumerate(values)}
