import math

from pyspark.sql import functions as F

from holdfast.functions import columns as X

INF, NAN = float("inf"), float("nan")


def values(spark, rows, expr, schema="v double"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], schema).select(expr).collect()]


def test_parse_number_accepts_number_literals_only(spark):
    text = ["1.5", " 1.5 ", "2e3", ".5", "5.", "-inf", "Infinity", "nan", "1d", "1.0f", "1,234", "", "n/a", None, "+7"]
    assert values(spark, text, X.parse_number("v"), "v string") == [
        1.5, 1.5, 2000.0, 0.5, 5.0, -INF, INF, None, None, None, None, None, None, None, 7.0]


def test_white_space_of_any_kind_is_stripped(spark):
    text = ["\t1.5", "2\r\n", "\u00a03\u2003", " 4 5 ", "\n"]
    assert values(spark, text, X.parse_number("v"), "v string") == [1.5, 2.0, 3.0, None, None]


def test_finite(spark):
    assert values(spark, [1.0, None, NAN, INF, -INF], X.is_finite("v")) == [True, False, False, False, False]
    assert values(spark, [1.0, None, NAN, INF], X.finite_or_null("v")) == [1.0, None, None, None]


def test_floor_and_clip_keep_missing(spark):
    assert values(spark, [-1.0, 2.0, None], X.floor_at_zero("v")) == [0.0, 2.0, None]
    assert values(spark, [-1.0, 2.0, 9.0, None], X.clip("v", F.lit(0.0), F.lit(5.0))) == [0.0, 2.0, 5.0, None]
    assert values(spark, [9.0], X.clip("v", F.lit(0.0), F.lit(None).cast("double"))) == [9.0]
    low_wins_then_high = values(spark, [3.0], X.clip("v", F.lit(6.0), F.lit(5.0)))
    assert low_wins_then_high == [5.0]


def test_target_round_trip(spark):
    out = values(spark, [0.0, 1.0, 12.5, -3.0], X.unlog_target(X.log_target("v")))
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(out, [0.0, 1.0, 12.5, 0.0]))
