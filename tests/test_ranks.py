import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import ranks as Q

PROBS = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0, "q0": 0.0}


def frame(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("few_rows", [1, 100_000])
def test_quantiles_match_numpy(spark, monkeypatch, few_rows):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=701),
        "heavy tails": rng.standard_cauchy(500) * 1e6,
        "hot value": np.concatenate([np.full(400, 3.25), rng.uniform(0, 9, 200)]),
        "close": 1e6 + rng.uniform(0, 1e-3, 300),
        "one": [4.0],
        "two": [-1.0, 2.0],
        "constant": [7.0] * 50,
        "zeros and signs": [-0.0, 0.0, -1e-300, 1e-300, -5.0, 5.0],
    }
    monkeypatch.setattr(Q, "FEW_ROWS", few_rows)
    original = Q.select_ranks
    monkeypatch.setattr(Q, "select_ranks", lambda *a, **k: original(*a, **{**k, "few_rows": few_rows}))
    found = Q.exact_quantiles(frame(spark, groups), ["g"], "v", PROBS)
    for g, vs in groups.items():
        for name, p in PROBS.items():
            assert found[g,][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300), (g, name)
        assert found[g,]["n"] == len(vs)


def test_non_finite_values_do_not_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("a", None), ("a", 3.0), ("b", None)],
                               "g string, v double")
    assert Q.exact_quantiles(df, ["g"], "v", {"m": 0.5}) == {("a",): {"n": 2, "m": 2.0}}
    assert Q.quantile_table(df.where("g = 'b'"), ["g"], "v", {"m": 0.5}).count() == 0


def test_ranks_of_pairs_break_ties_by_second_column(spark):
    rows = [("s", format(h, "032x"), i) for i, h in enumerate([5, 5, 5, 1, 9])]
    df = spark.createDataFrame(rows, "g string, h string, id bigint")
    found = Q.select_ranks(df, ["g"], ["h", "id"], Q.hex_key("h"), {"r2": lambda n: F.lit(2), "r4": lambda n: n - 1, "out": lambda n: n + 1})
    assert {(r.tag, r.value[1]) for r in found} == {("r2", 0), ("r4", 2)}


def test_one_hot_value_needs_no_further_passes(spark, monkeypatch):
    passes = []
    original = Q._narrow
    monkeypatch.setattr(Q, "_narrow", lambda *a: passes.append(1) or original(*a))
    df = frame(spark, {"a": [2.5] * 500 + [9.0]})
    Q.select_ranks(df, ["g"], ["v"], Q.numeric_key("v"), {"m": lambda n: F.floor(n / 2)}, few_rows=10)
    assert len(passes) == 1


@pytest.mark.parametrize("n", [1, 7, 300])
@pytest.mark.parametrize("around", [(), (0.2,), (0.2, 0.32), (0.0,), (0.995,), (0.2, 0.205)])
def test_hex_windows_never_lose_a_rank(spark, n, around):
    import hashlib

    rows = [("g", hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, h string, id bigint")
    order = sorted((h, i) for _, h, i in rows)
    ranks = {str(k): (lambda _, k=k: F.lit(k)) for k in {1, n // 5 + 1, n // 2 + 1, n}}
    for few in (1, 1000):
        found = Q.select_ranks(df, ["g"], ["h", "id"], Q.hex_key("h", around), ranks, few_rows=few)
        assert {int(r.tag): r.value for r in found} == {int(k): order[int(k) - 1] for k in ranks}
