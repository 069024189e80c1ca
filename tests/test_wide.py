"""Wide tables: generated methods that the JIT compiler takes, and the same results as narrow ones."""

import datetime
import decimal
import re

import pytest
from pyspark.sql import functions as F

from facsimile import Synthesizer, column_profile, fit, sample
from facsimile.operators import sample as sampling
from facsimile.operators.kinds import exact_distinct
from workloads.common import order_nested, read

JIT_LIMIT = 8000  # bytes of a method beyond which the JIT compiler leaves it


@pytest.fixture
def method_sizes(spark):
    """Bytes of the longest method of each generated stage; an adaptive plan does not tell before it runs."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
    spark.conf.set("spark.sql.adaptive.enabled", was)


def test_wide_samples_compile(spark, sf_dir, method_sizes):
    lines = read(spark, sf_dir, "lineitem").limit(500)
    wide = lines.select(*[(F.col("l_extendedprice") * i).alias(f"price{i}") for i in range(1, 41)])
    model = fit(wide, independent=True)
    sizes = [n for rng in ("hash", "power") for n in method_sizes(sample(model, 100, rng=rng))]
    assert sizes and max(sizes) <= JIT_LIMIT


def test_nested_samples_compile(spark, sf_dir, method_sizes):
    maker = Synthesizer(exact=True, independent=True).fit(order_nested(spark, sf_dir))
    sizes = method_sizes(maker.sample(100, rng="power"))
    assert sizes and max(sizes) <= JIT_LIMIT


def test_wide_profiles_compile(spark, sf_dir, method_sizes):
    lines = read(spark, sf_dir, "lineitem")
    wide = lines.select(*[(F.col("l_extendedprice") * i).alias(f"price{i}") for i in range(1, 25)])
    sizes = method_sizes(column_profile(wide, counts=set()))
    assert sizes and max(sizes) <= JIT_LIMIT


def test_few_and_many_categories_are_drawn_alike(spark, sf_dir, monkeypatch):
    model = fit(read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"), exact=True, independent=True)
    some = sample(model, 3000, rng="power").collect()
    monkeypatch.setattr(sampling, "CASE_ENTRIES", 0)
    assert sample(model, 3000, rng="power").collect() == some
    assert {r.o_orderstatus for r in some} == {"F", "O", "P"}


def test_exact_distinct_counts_each_type(spark):
    big, nan, inf = 2**60, float("nan"), float("inf")
    day = datetime.date(2020, 1, 1)
    rows = [
        (1, big, 0.5, "a", True, day, decimal.Decimal(1), b"x"), (1, big + 1, nan, "b", False, None, None, b"y"), (2, big, inf, None, True, day, None, None),
        (None, None, 0.5, "a", None, datetime.date(2020, 1, 2), decimal.Decimal(2), None), (3, -big, -2.0, "", None, day, decimal.Decimal(1), None),
    ]
    df = spark.createDataFrame(rows, "`a.b` int, whole long, part double, word string, flag boolean, day date, wide decimal(20,0), raw binary")
    got = {r["column"]: r["distinct"] for r in exact_distinct(df).collect()}
    assert got == {"a.b": 3, "whole": 3, "part": 2, "word": 3, "flag": 2, "day": 2, "wide": 2}
