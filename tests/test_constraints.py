import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import constraints as K

NAN = float("nan")


def table(spark, groups):
    rows = [(g, float(y) if y is not None else None, float(s) if s is not None else None) for g, pairs in groups.items() for y, s in pairs]
    return spark.createDataFrame(rows, "g string, y double, s2 double")


def by_group(df):
    return {r["g"]: r.asDict() for r in df.collect()}


def lstsq(y, x):
    return np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), np.asarray(y, float), rcond=None)[0]


rng = np.random.default_rng(0)
UP = [(2 * s + 1 + rng.normal(), s) for s in rng.uniform(0, 9, 40)]
DOWN = [(30 - 2 * s, s) for s in rng.uniform(0, 9, 40)]
FLAT = [(y, 3.0) for y in rng.uniform(0, 5, 20)]


def test_line_and_cap(spark):
    groups = {"up": UP, "down": DOWN, "flat": FLAT, "four": UP[:4], "nine": UP[:9], "none": [(1.0, None), (NAN, 2.0)],
              "gaps": UP + [(None, 1.0), (1000.0, NAN)], "small": [(0.1, 1.0)] * 3}
    fit = by_group(K.fit_together(table(spark, groups), ["g"], [K.line_and_cap("y", "s2")]))
    a, b = lstsq(*zip(*UP))
    for g in ("up", "gaps"):  # pairs with a missing side do not count, not even for the cap
        assert fit[g]["a"] == pytest.approx(a) and fit[g]["b"] == pytest.approx(b)
        assert fit[g]["toc_max"] == pytest.approx(1.1 * max(y for y, _ in UP))
    assert fit["down"]["a"] == 0.0 and fit["down"]["b"] == pytest.approx(30.0)  # the intercept is not refitted
    a, b = lstsq(*zip(*FLAT))
    assert fit["flat"]["a"] == pytest.approx(a) and fit["flat"]["b"] == pytest.approx(b)
    for g, k in (("four", 4), ("nine", 9)):
        assert fit[g]["a"] == 0.0 and fit[g]["b"] == np.median([y for y, _ in UP[:k]])
    assert (fit["none"]["a"], fit["none"]["b"], fit["none"]["toc_max"], fit["none"]["n_pairs"]) == (0.0, 0.0, 30.0, 0)
    assert fit["small"]["toc_max"] == 1.0


@pytest.mark.parametrize("n", range(1, 10))
def test_small_median_is_exact(spark, n):
    ys = rng.normal(size=n)
    fit = K.fit_together(table(spark, {"g": [(y, 1.0) for y in ys]}), ["g"], [K.line_and_cap("y", "s2")]).first()
    assert fit["b"] == pytest.approx(np.median(ys), rel=1e-15)


def test_band_and_line(spark):
    groups = {"up": UP, "four": UP[:4], "flat y": [(2.0, s) for s in range(8)], "no s2": [(1.0, None)] * 6,
              "one ratio": [(2.0, 4.0)] * 6}
    fit = by_group(K.fit_band_and_line(table(spark, groups), ["g"], "y", "s2"))
    y, s = map(np.array, zip(*UP))
    a, b = lstsq(s, y)
    ratio = 100 * s / np.maximum(y, 1e-6)
    assert fit["up"]["a_s2"] == pytest.approx(a) and fit["up"]["b_s2"] == pytest.approx(b)
    assert fit["up"]["hi_min"] == pytest.approx(np.quantile(ratio, 0.01))
    assert fit["up"]["hi_max"] == pytest.approx(np.quantile(ratio, 0.99))
    assert (fit["four"]["a_s2"], fit["four"]["b_s2"]) == (1.0, 0.0)
    a, b = lstsq(range(8), [2.0] * 8)
    assert fit["flat y"]["a_s2"] == pytest.approx(a) and fit["flat y"]["b_s2"] == pytest.approx(b)
    assert (fit["no s2"]["a_s2"], fit["no s2"]["hi_min"], fit["no s2"]["hi_max"]) == (1.0, 0.0, 1e9)
    assert (fit["one ratio"]["hi_min"], fit["one ratio"]["hi_max"]) == (0.0, 1e9)


def test_refine_lines(spark):
    groups = {"up": UP, "down": DOWN, "nine": UP[:9], "zero y": [(0.0, s) for s in range(20)]}
    direct = by_group(K.fit_together(table(spark, groups), ["g"], [K.refine_line("y", "s2")]))
    a, b = lstsq(*zip(*UP))
    assert direct["up"]["a_lin"] == pytest.approx(a) and direct["up"]["b_lin"] == pytest.approx(b)
    assert all((direct[g]["a_lin"], direct[g]["b_lin"]) == (0.1, 0.0) for g in ("down", "nine"))
    inverse = by_group(K.fit_together(table(spark, groups), ["g"], [K.refine_inverse_line("y", "s2")]))
    y, s = map(np.array, zip(*UP))
    a, b = lstsq(s[y > 1e-6], y[y > 1e-6])
    assert inverse["up"]["a_lin"] == pytest.approx(a) and inverse["up"]["b_lin"] == pytest.approx(b)
    assert all((inverse[g]["a_lin"], inverse[g]["b_lin"]) == (1.0, 0.0) for g in ("down", "nine", "zero y"))


@pytest.mark.parametrize("rule, top, expected", [("raise_small", 2.0, 15.0), ("raise_small", 10.0, 11.0), ("floor_25", 2.0, 25.0),
                                                 ("floor_25", 100.0, 110.0), ("plain", 0.1, 1.0), ("plain", 10.0, 11.0)])
def test_refine_cap(spark, rule, top, expected):
    assert K.fit_together(table(spark, {"g": [(top, 1.0)]}), ["g"], [K.refine_cap("y", rule)]).first()["toc_max"] == pytest.approx(expected)


def test_unknown_names():
    with pytest.raises(ValueError):
        K.constrained("y", "s2", "other")


def applied(spark, rows, expr, **params):
    df = spark.createDataFrame(rows, "y double, s2 double")
    for name, value in params.items():
        df = df.withColumn(name, F.lit(float(value)))
    return [r[0] for r in df.select(expr).collect()]


def test_modes(spark):
    fit = {"a": 2.0, "b": 1.0, "toc_max": 10.0, "lambda_s2": 0.15}
    rows = [(-3.0, 1.0), (4.0, 2.0), (50.0, 2.0)]
    base = applied(spark, rows, K.constrained("y", "s2", "base"), **fit)
    assert base == [0.0, 4.0, 10.0] == applied(spark, rows, K.constrained("y", "s2", "nn"), **fit)
    full = applied(spark, rows, K.constrained("y", "s2", "full"), **fit)
    assert full == pytest.approx([0.45, 0.85 * 4 + 0.15 * 5, 10.0])
    assert full == applied(spark, rows, K.constrained("y", "s2", "s2"), **fit)
    assert applied(spark, rows, K.constrained("y", None, "full"), **fit) == base
    assert applied(spark, rows, K.constrained("y", "s2", "full", fitted=False)) == [0.0, 4.0, 50.0]


def test_band_clip_is_open_above_without_a_lower_ratio(spark):
    rows = [(1.0, 10.0), (99.0, 10.0), (5.0, None), (5.0, -1.0)]

    def run(lo, hi):
        return applied(spark, rows, K.band_clip("y", "s2", F.col("hi_min"), F.col("hi_max"), F.col("eps")), hi_min=lo, hi_max=hi, eps=1e-8)

    assert run(50, 200) == [5.0, 20.0, 5.0, -2.0]
    assert run(0, 200) == [5.0, 99.0, 5.0, 5.0]


def test_composite_order_and_flat_line(spark):
    fit = {"a_s2": 2.0, "b_s2": 0.0, "hi_min": 50.0, "hi_max": 200.0, "eps": 1e-8, "lambda_s2": 0.05}
    rows = [(-4.0, 10.0), (99.0, 10.0), (7.0, None)]
    assert applied(spark, rows, K.composite("y", "s2"), **fit) == pytest.approx([0.95 * 5 + 0.05 * 5, 0.95 * 20 + 0.05 * 5, 7.0])
    flat = {**fit, "a_s2": 0.0}
    assert applied(spark, rows, K.composite("y", "s2"), **flat) == [5.0, 20.0, 7.0]
    assert applied(spark, rows, K.composite("y", None), **fit) == [0.0, 99.0, 7.0]
    assert math.isclose(applied(spark, rows, K.composite("y", "s2", with_band=False), **fit)[1], 0.95 * 99 + 0.05 * 5)


def test_fits_share_one_aggregation(spark):
    fits = [K.line_and_cap("y", "s2"), K.refine_line("y", "s2"), K.inverse_line("y", "s2"), K.refine_cap("y", "plain", name="top")]
    together = by_group(K.fit_together(table(spark, {"up": UP, "four": UP[:4]}), ["g"], fits))
    for fit in fits:
        alone = by_group(K.fit_together(table(spark, {"up": UP, "four": UP[:4]}), ["g"], [fit]))
        for g in alone:
            assert {k: together[g][k] for k in alone[g]} == alone[g]
