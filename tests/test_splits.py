import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.operators import splits as P


def ids(spark, n, shift=0):
    return spark.range(shift, shift + n).withColumnRenamed("id", "sample_id")


def brute_force(sample_ids, seed, test_size, val_size=None):
    order = sorted(sample_ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    n, n_test = len(order), math.ceil(test_size * len(order))
    n_val = math.ceil(val_size / (1.0 - test_size) * (n - n_test)) if val_size is not None else 0
    return {i: P.TEST if k < n_test else P.VAL if k < n_test + n_val else P.TRAIN for k, i in enumerate(order)}


@given(n=st.integers(1, 120), test_size=st.sampled_from([0.15, 0.2, 0.25, 0.5]), val_size=st.sampled_from([None, 0.15]))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_split_equals_full_ranking(spark, n, test_size, val_size):
    rows = P.repeated_split(ids(spark, n, 1000), [0, 7], test_size, val_size).collect()
    assert len(rows) == 2 * n
    for seed in (0, 7):
        got = {r["sample_id"]: r["split"] for r in rows if r["seed"] == seed}
        assert got == brute_force(range(1000, 1000 + n), seed, test_size, val_size)


def test_split_does_not_depend_on_partitioning(spark):
    a = P.repeated_split(ids(spark, 500).repartition(1), [3], 0.2)
    b = P.repeated_split(ids(spark, 500).repartition(13), [3], 0.2)
    assert set(map(tuple, a.collect())) == set(map(tuple, b.collect()))


def test_split_needs_no_shuffle_or_join(spark):
    cuts = P.find_cuts(ids(spark, 300), range(20), 0.2)
    plan = P.assign_splits(ids(spark, 300), cuts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_xxhash_digest_gives_the_same_sizes(spark):
    for digest in ("md5", "xxhash64"):
        cuts = P.find_cuts(ids(spark, 333), [0, 1], 0.2, 0.15, digest=digest)
        sizes = P.split_sizes(P.assign_splits(ids(spark, 333), cuts, digest=digest)).collect()
        assert {(r["n_train"], r["n_val"], r["n_test"]) for r in sizes} == {(216, 50, 67)}
    with pytest.raises(ValueError):
        P.split_digest(0, F.lit(1), "sha")


def test_split_within_subsets(spark):
    rows = ids(spark, 90).withColumn("setting", F.explode(F.array(*[F.when(F.col("sample_id") < lim, F.lit(name))
                                                                    for name, lim in (("A", 90), ("B'q", 40))]))).where("setting is not null")
    got = P.repeated_split(rows, [5], 0.25, within="setting").collect()
    for name, lim in (("A", 90), ("B'q", 40)):
        assert {r["sample_id"]: r["split"] for r in got if r["setting"] == name} == brute_force(range(lim), 5, 0.25)


def test_part_of_is_the_same_as_assign(spark):
    cuts = P.find_cuts(ids(spark, 200), [4], 0.2, 0.15)
    df = ids(spark, 200).select("sample_id", P.part_of(cuts[None, 4], 4).alias("part"))
    assert {r[0]: r[1] for r in df.collect()} == brute_force(range(200), 4, 0.2, 0.15)


def test_split_array_is_the_same_as_assign(spark):
    cuts = P.find_cuts(ids(spark, 150), [0, 6], 0.2, 0.15)
    packed = P.split_array(ids(spark, 150), cuts).select("sample_id", F.explode("splits").alias("e")).select("sample_id", "e.*")
    assert set(map(tuple, packed.collect())) == set(map(tuple, P.assign_splits(ids(spark, 150), cuts).collect()))


def test_seed_schedules():
    assert P.seed_schedule(3) == [0, 1, 2]
    assert P.seed_schedule(2, offset=40) == [40, 41]
    assert P.seed_schedule(stop=100, step=20) == [0, 20, 40, 60, 80]


def test_fan_out_uneven_seeds(spark):
    assert sorted(r["seed"] for r in P.fan_out(ids(spark, 1), [4, 1, 9]).collect()) == [1, 4, 9]


def test_bernoulli_share(spark):
    rows = P.bernoulli_split(ids(spark, 5000), [0], 0.2)
    assert abs(rows.where("split = 'test'").count() / 5000 - 0.2) < 0.02


def test_parts_as_given_values(sample_table):
    cut = P.find_cuts(sample_table, [3], 0.2, 0.1)[None, 3]
    valued = P.part_of(cut, 3, values=(F.when(F.col("sample_id") % 2 == 0, 1).otherwise(2), 3, 4))
    rows = sample_table.select("sample_id", P.part_of(cut, 3).alias("part"), valued.alias("value")).collect()
    want = {"train": lambda i: 1 + i % 2, "val": lambda i: 3, "test": lambda i: 4}
    assert {r.part for r in rows} == set(want) and all(r.value == want[r.part](r.sample_id) for r in rows)
