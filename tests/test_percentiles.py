"""Radix selection against sorting."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.operators import percentiles
from paylens.operators.percentiles import _with_image, exact_percentiles

WANTED = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p90": 0.9, "p999": 0.999, "p100": 1.0}


def any_double(r):
    """Every bit pattern is as likely; NaN left out."""
    while True:
        v = struct.unpack("<d", r.randbytes(8))[0]
        if not math.isnan(v):
            return v


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0,
         math.nextafter(1, 0), math.nextafter(1, 2), 2.0, math.nextafter(2, 0),
         1.7976931348623157e308, math.inf, -math.inf]


def bits(v):
    """The number that the bits make, sign apart."""
    n = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    return -n if v < 0 else n


def test_images_are_the_bits(spark):
    r = random.Random(1)
    values = EDGES + [-v for v in EDGES] + [any_double(r) for _ in range(3000)]
    values += [math.ldexp(r.random(), -r.randrange(1000, 1080)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in _with_image(df).collect():
        assert row.m == bits(row.v), row.v
    odd = _with_image(spark.sql("SELECT double('nan') AS v")).first().m
    assert odd > bits(math.inf)


def sorted_at(values, p):
    held = sorted(values)
    at = (len(held) - 1) * p
    low, high = held[math.floor(at)], held[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("kind", ["all", "band", "equal", "two", "money"])
def test_equal_to_sorting(spark, kind):
    r = random.Random(2)
    values = {
        "all": lambda: [any_double(r) / 4 for _ in range(4000)],
        "band": lambda: [100 * (1 + r.random() / 2000) for _ in range(4000)],
        "equal": lambda: [3.25] * 500, "two": lambda: [-1.5] * 300 + [7.0],
        "money": lambda: [round(r.lognormvariate(5, 2), 2) for _ in range(4000)],
    }[kind]()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double")
    got = exact_percentiles(df, "v", WANTED).first()
    for name, p in WANTED.items():
        assert got[name] == sorted_at(values, p), name


def test_values_in_one_narrow_band_use_many_tasks(spark):
    """All in one leading digit; the next one still divides them into many groups."""
    df = spark.range(200_000).select((100 + F.col("id") / 4_000_000).alias("v"))
    held = _with_image(df)
    counts = [held.select(F.shiftright("m", s).alias("d")).distinct().count()
              for s in percentiles._SHIFTS]
    assert counts[0] <= 2 and counts[1] > 1000 and counts[2] == 200_000
    got = exact_percentiles(df, "v", {"p": 0.75}).first().p
    assert got == np.percentile(100 + np.arange(200_000) / 4_000_000, 75)
    # What one task orders is bounded by a digit, whatever the number of values.
    assert all(a - b <= 21 for a, b in zip(percentiles._SHIFTS, percentiles._SHIFTS[1:]))
