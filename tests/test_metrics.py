import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import metrics as A
from holdfast.operators import summary as S

rng = np.random.default_rng(3)


def brute(y, p):
    y, p = np.asarray(y), np.asarray(p)
    res, tot = ((y - p) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    return 1 - res / tot, np.sqrt(((y - p) ** 2).mean()), np.abs(y - p).mean()


def test_metrics_against_numpy(spark):
    y, b, f = rng.normal(size=(3, 60))
    df = spark.createDataFrame([("A", 1, *map(float, r)) for r in zip(y, b, f)], "setting string, seed int, y_true double, y_base double, y_full double")
    got = {r["mode"]: r for r in A.metrics(df.repartition(4)).collect()}
    for mode, p in (("base", b), ("full", f)):
        assert (got[mode]["r2"], got[mode]["rmse"], got[mode]["mae"]) == pytest.approx(brute(y, p))


def test_r2_of_constant_and_single_truth(spark):
    rows = [("exact", 2.0, 2.0)] * 3 + [("off", 2.0, 2.5)] * 3 + [("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = {r["g"]: r["r2"] for r in A.metrics(df, ["g"], "y", {"m": "p"}).collect()}
    assert got == {"exact": 1.0, "off": 0.0, "one": None}


def test_residual_histogram_matches_numpy(spark):
    y, p = rng.normal(size=(2, 500))
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(y, p)] + [("c", 1.0, 0.5)] * 4, "setting string, y_true double, y_pred double")
    rows = A.residual_histogram(df).collect()
    counts, edges = np.histogram(y - p, bins=20)
    got = {r["bin"]: r for r in rows if r["setting"] == "s"}
    assert {b: r["rows"] for b, r in got.items()} == {i + 1: c for i, c in enumerate(counts) if c}
    assert got[20]["bin_high"] == pytest.approx(edges[-1])
    assert sum(r["rows"] for r in rows if r["setting"] == "c") == 4


def test_gate(spark):
    rows = spark.createDataFrame([("A", 0, 1.0, 9.0), ("A", 1, 1.0, 9.0), ("A", 2, 1.0, None)], "setting string, seed int, y_base double, y_refined double")
    val = spark.createDataFrame([("A", 0, "base", 0.5), ("A", 0, "refined", 0.5), ("A", 1, "base", 0.5), ("A", 1, "refined", 0.4)],
                                "setting string, seed int, mode string, r2 double")
    got = {r["seed"]: (r["y_full"], r["refined_accepted"]) for r in A.accept_if_better(rows, val).collect()}
    assert got == {0: (9.0, True), 1: (1.0, False), 2: (1.0, False)}


def runs(spark, table):
    return spark.createDataFrame(table, "setting string, mode string, seed int, r2 double, rmse double, mae double")


def test_summary_std_of_one_run(spark):
    one = runs(spark, [("A", "full", 0, 0.5, 1.0, 1.0)])
    assert S.ablation_summary(one).first()["r2_std"] is None
    assert S.ablation_summary(one, std_of_one=0.0).first()["r2_std"] == 0.0
    assert S.population_summary(one, F.lit(7)).first()["r2_std"] == 0.0


def test_summary_against_numpy(spark):
    values = rng.normal(size=9)
    row = S.ablation_summary(runs(spark, [("A", "full", i, float(v), 1.0, 1.0) for i, v in enumerate(values)])).first()
    assert row["r2_std"] == pytest.approx(values.std(ddof=1)) and row["n_repeats"] == 9
    assert [row[f"r2_{s}"] for s in ("median", "q1", "q3", "min", "max")] == pytest.approx(
        [np.median(values), *np.quantile(values, [0.25, 0.75]), values.min(), values.max()])


def test_best_of_best_ties_take_the_first_setting(spark):
    d = spark.createDataFrame([(0, "B", 0.5, 0.1), (0, "A", 0.5, 0.9), (1, "A", None, 0.2), (2, "B", 0.3, 0.2)],
                              "seed int, setting string, r2_base double, r2_full double")
    got = [tuple(r) for r in S.best_of_best(d, ["B", "A"]).collect()]
    assert got == [(0, "B", "A", 0.5, 0.9, pytest.approx(0.4)), (2, "B", "B", 0.3, 0.2, pytest.approx(-0.1))]
    assert S.best_of_best(d.where("false"), ["B", "A"]).count() == 0
    assert S.digest(S.best_of_best(d.where("false"), ["B", "A"])).count() == 0


def test_seed_picks_first_on_ties(spark):
    d = spark.createDataFrame([(5, 0.1), (3, 0.1), (9, -0.2), (7, 0.0)], "seed int, delta_r2 double")
    assert {r["tag"]: r["seed"] for r in S.seed_picks(d).collect()} == {"best": 3, "worst": 9, "median": 3}


def test_deltas_and_best_seed(spark):
    m = runs(spark, [("NoRes", "full", 0, 0.1, 1.0, 1.0), ("Full", "full", 0, 0.4, 1.0, 1.0), ("NoRes", "full", 1, 0.2, 1.0, 1.0),
                     ("Full", "full", 1, 0.4, 1.0, 1.0)])
    assert [r["delta_r2"] for r in S.delta_between_settings(m).collect()] == pytest.approx([0.3, 0.2])
    assert S.setting_difference(m).first()["r2_diff"] == pytest.approx(0.25)
    assert {r["setting"]: r["seed"] for r in S.best_seed(m).collect()} == {"NoRes": 1, "Full": 0}
