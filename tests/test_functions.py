import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import quantiles, rounding, special


def evaluate(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_log_gamma_and_digamma(spark):
    xs = [0.05, 0.5, 1.0, 2.5, 10.0, 123.4, 5000.0]
    rows = [(x,) for x in xs]
    ours = evaluate(spark, "a double", rows, special.log_gamma(F.col("a")))
    assert ours == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)
    euler = 0.5772156649015329
    ours = evaluate(spark, "a double", [(1.0,), (2.0,), (5.0,), (0.5,)], special.digamma(F.col("a")))
    assert ours == pytest.approx([-euler, 1 - euler, 25 / 12 - euler, -euler - 2 * math.log(2)], rel=1e-12)
    ours = evaluate(spark, "a double", [(1.0,), (0.5,)], special.trigamma(F.col("a")))
    assert ours == pytest.approx([math.pi**2 / 6, math.pi**2 / 2], rel=1e-12)


def test_gamma_cdf_against_closed_forms(spark):
    rows, expected = [], []
    for x in (0.0, 1e-6, 0.3, 1.0, 4.0, 30.0):
        rows.append((0.5, x))
        expected.append(math.erf(math.sqrt(x)))
        for a in (1, 2, 7, 40):
            rows.append((float(a), x))
            expected.append(1 - sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) if x else float(k == 0) for k in range(a)))
    ours = evaluate(spark, "a double, x double", rows, special.gamma_cdf(F.col("a"), F.col("x")))
    assert ours == pytest.approx(expected, abs=1e-12)


def test_gamma_cdf_large_shape(spark):
    # For large shapes the median is close to a - 1/3, and the series must still be long enough.
    rows = [(a, a - 1 / 3 + 8 / (405 * a)) for a in (50.0, 1000.0, 20000.0)]
    ours = evaluate(spark, "a double, x double", rows, special.gamma_cdf(F.col("a"), F.col("x")))
    assert ours == pytest.approx([0.5] * 3, abs=1e-6)


def test_gamma_shape_solves_the_likelihood_equation(spark):
    s = [1e-6, 0.001, 0.05, 0.5, 2.0, 6.0]
    table = spark.createDataFrame([(v,) for v in s], "s double").withColumn("a", special.gamma_shape(F.col("s")))
    left = [r[0] for r in table.select(F.log("a") - special.digamma(F.col("a"))).collect()]
    assert left == pytest.approx(s, rel=1e-8)
    assert evaluate(spark, "s double", [(0.0,)], special.gamma_shape(F.col("s"))) == [None]


def test_normal_quantile_and_two_sided(spark):
    ps = [1e-14, 1e-6, 0.01, 0.2, 0.5, 0.61, 0.97, 1 - 1e-9]
    ours = evaluate(spark, "p double", [(p,) for p in ps], special.normal_quantile(F.col("p")))
    assert ours == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-15)
    zs = [0.0, 0.5, -1.0, 1.96, 3.0, -6.0]
    ours = evaluate(spark, "z double", [(z,) for z in zs], special.normal_two_sided(F.col("z")))
    assert ours == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], abs=1e-13)


def test_quantile8_matches_median_unbiased(spark):
    rng = random.Random(3)
    rows = [(sorted(rng.uniform(-5, 5) for _ in range(n)),) for n in (1, 2, 3, 8, 41)]
    for q in (0.1, 0.5, 0.95, 0.99):
        ours = evaluate(spark, "v array<double>", rows, quantiles.quantile8(F.col("v"), q))
        assert ours == pytest.approx([np.quantile(r[0], q, method="median_unbiased") for r in rows], rel=1e-12)
    assert evaluate(spark, "v array<double>", [([],)], quantiles.quantile8(F.col("v"), 0.5)) == [None]


def test_median_of_sorted(spark):
    rows = [([1.0],), ([1.0, 4.0],), ([1.0, 2.0, 9.0],), ([],)]
    assert evaluate(spark, "v array<double>", rows, quantiles.median_of_sorted(F.col("v"))) == [1.0, 2.5, 2.0, None]


def test_stored_precision(spark):
    rows = [("PRCPTOT", 1.23456), ("SPI3", 1.23456), ("SPI3_Drought_Peak", 1.23456), ("SPI3_Flood_Duration", 1.23456)]
    ours = evaluate(spark, "i string, v double", rows, rounding.round_value(F.col("i"), F.col("v")))
    assert ours == [1.23, 1.2346, 1.2346, 1.23]
