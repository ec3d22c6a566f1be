from pyspark.sql import functions as F

from holdfast.operators import clean as C
from holdfast.operators import features as D

INF, NAN = float("inf"), float("nan")


def test_all_or_nothing(spark):
    df = spark.createDataFrame([("1.5", "x", "2", "k"), (None, "2", "nan", "l"), ("3", "4", "", "m")],
                               "a string, b string, c string, `d.e (%)` string")
    out = C.coerce_if_all_numeric(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "double", "d.e (%)": "string"}
    assert [r["a"] for r in out.collect()] == [1.5, None, 3.0]
    assert dict(C.coerce_if_all_numeric(df, skip=["a"]).dtypes)["a"] == "string"


def test_drop_empty_columns_counts_nan_as_empty(spark):
    df = spark.createDataFrame([(None, NAN, 1.0, ""), (None, NAN, None, "")], "a string, b double, c double, d string")
    assert C.drop_empty_columns(df).columns == ["c", "d"]


def test_missing_and_infinite(spark):
    df = spark.createDataFrame([(1.0, 1.0), (INF, 1.0), (None, 1.0), (NAN, 1.0)], "a double, b double")
    assert C.drop_missing(C.coerce_numeric(df, ["a"]), ["a", "b"]).count() == 2  # infinity survives
    assert C.keep_finite(df, ["a", "b"]).count() == 1


def test_usable_settings(spark):
    df = spark.range(40).select(F.col("id").cast("double").alias("toc"), F.lit(1.0).alias("a"),
                                F.when(F.col("id") < 24, 1.0).alias("b"), F.when(F.col("id") < 25, 1.0).alias("c"))
    s = {"few rows": ["a", "b"], "enough": ["a", "c"], "one feature": ["a", "absent"]}
    assert C.usable_settings(df, "toc", s) == {"enough": ["a", "c"]}
    assert C.usable_settings(df, "toc", {"none": ["absent"]}) == {}
    rows = C.rows_by_setting(df, "toc", {"x": ["a", "b"], "y": ["a", "c"]}).groupBy("setting").count().collect()
    assert {r[0]: r[1] for r in rows} == {"x": 24, "y": 25}


def test_cap_rows(spark):
    df = spark.range(0, 900, 3).withColumnRenamed("id", "sample_id").repartition(6)
    assert sorted(r[0] for r in C.cap_rows(df, 5).collect()) == [0, 3, 6, 9, 12]
    assert C.cap_rows(df, 0).count() == 300
    assert C.cap_rows(df, 10_000).count() == 300


def test_cleaning_report(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (1.0, None)], "a double, y double")
    assert tuple(C.cleaning_report(df, ["a"], "y").first()) == (3, 1, 2)


def test_ratio_repair(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (3.0, 1.0, 1.0), (5.0, -1e-6, 1.0), (2.0, 1.0, None)], "U double, TH double, K double")
    out = D.repair_nonfinite(D.add_ratio_features(df)).collect()
    finite = sorted([1 / 1.000001, 3 / 1.000001, 2 / 1.000001])
    assert abs(out[2]["U_TH"] - finite[1]) < 1e-12
    assert out[3]["U_K"] is not None
    nothing = spark.createDataFrame([(None,)], "U_TH double").select("U_TH", F.col("U_TH").alias("U_K"), F.col("U_TH").alias("TH_K"))
    assert tuple(D.repair_nonfinite(nothing).first()) == (0.0, 0.0, 0.0)


def test_log_features_only_missing_outside_domain(spark):
    df = spark.createDataFrame([(9.0, 0.0), (-1.0, 3.0)], "RD double, RS double")
    rows = D.add_log_features(df).collect()
    assert rows[0]["dlogR"] == rows[0]["log_RD"] and rows[1]["log_RD"] is None and rows[1]["log_RS"] is not None


def test_encode_missing(spark):
    df, names = D.encode_missing(spark.createDataFrame([(None,), (NAN,), (2.0,)], "a double"), ["a"])
    assert names == ["a_filled", "a_is_missing"]
    assert [tuple(r) for r in df.select(*names).collect()] == [(-1e9, 1.0), (-1e9, 1.0), (2.0, 0.0)]


def test_the_report_comes_with_the_cleaned_table(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 1.0, None), (4, 5.0, 6.0)], "sample_id long, `a.b` double, t double")
    table, report = C.clean_with_report(df, ["a.b"], "t", f"{tmp_path}/cleaned")
    assert sorted(r.sample_id for r in table.collect()) == [1, 4]
    assert tuple(report.first()) == (4, 2, 2) == tuple(C.cleaning_report(df, ["a.b"], "t").first())
