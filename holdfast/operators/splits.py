"""Deterministic repeated hold-out splits.

A row's place in the shuffle of seed ``s`` is its rank by
``md5('s:sample_id')``, ties by ``sample_id``. TEST is the first
``ceil(test_size * n)`` rows, VAL the next ones. Only the digest *at the cut*
is looked up (``ranks.select_ranks``, reading just the id column). After that a
row's part is a comparison with its seed's cut: the cuts of all seeds are one
literal array that rows are exploded over, so a split costs no shuffle and no
join. It depends on nothing but (seed, sample_id): settings that share rows
share splits, and repartitioning or losing an executor cannot change them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ranks import hex_key, select_ranks

TRAIN, VAL, TEST = "train", "val", "test"


@dataclass(frozen=True)
class Cut:
    """Rows of a run and the last TEST and VAL row (digest, id) of its shuffle."""

    n: int
    test: tuple[str, Any]
    val: tuple[str, Any] | None = None


# One cut per (subset, seed); the subset is None where all rows are split together.
Cuts = Mapping[tuple[Any, int], Cut]


def seed_schedule(n: int = 0, *, offset: int = 0, stop: int | None = None, step: int = 1) -> list[int]:
    """``n`` consecutive seeds from ``offset``, or ``range(offset, stop, step)``."""
    return list(range(offset, offset + n)) if stop is None else list(range(offset, stop, step))


def fan_out(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Every row once per seed. Narrow; evenly spaced seeds become a ``sequence``."""
    seeds = list(seeds)
    step = seeds[1] - seeds[0] if len(seeds) > 1 else 1
    if step > 0 and seeds == list(range(seeds[0], seeds[-1] + 1, step)):
        listed = F.sequence(F.lit(seeds[0]), F.lit(seeds[-1]), F.lit(step))
    else:
        listed = F.array(*[F.lit(s) for s in seeds])
    return df.withColumn("seed", F.explode(listed))


def split_digest(seed: Column | int, sample_id: Column, digest: str = "md5") -> Column:
    """Fixed-width hex digest of (seed, row). ``xxhash64`` is cheaper, md5 portable."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    if digest == "xxhash64":
        return F.lpad(F.hex(F.xxhash64(seed.cast("bigint"), sample_id)), 16, "0")
    if digest != "md5":
        raise ValueError(f"unknown digest: {digest}")
    return F.md5(F.concat_ws(":", seed.cast("string"), sample_id.cast("string")))


def test_rows(n: Column, test_size: float) -> Column:
    return F.ceil(F.lit(float(test_size)) * n)


def held_out_rows(n: Column, test_size: float, val_size: float) -> Column:
    """TEST rows plus VAL rows; VAL is a share of what TEST leaves over."""
    n_test = test_rows(n, test_size)
    share = F.lit(float(val_size)) / (F.lit(1.0) - F.lit(float(test_size)))
    return n_test + F.ceil(share * (n - n_test))


def find_cuts(
    df: DataFrame,
    seeds: Sequence[int],
    test_size: float,
    val_size: float | None = None,
    *,
    id_col: str = "sample_id",
    within: str | None = None,
    digest: str = "md5",
) -> dict[tuple[Any, int], Cut]:
    """The cuts of every seed (and subset named by column ``within``). Runs at once."""
    groups = [*([within] if within else []), "seed"]
    rows = fan_out(df.select(*groups[:-1], F.col(id_col).alias("_id")), seeds)
    rows = rows.withColumn("_h", split_digest(F.col("seed"), F.col("_id"), digest))
    ranks = {TEST: lambda n: test_rows(n, test_size)}
    if val_size is not None:
        ranks[VAL] = lambda n: held_out_rows(n, test_size, val_size)
    near = [test_size] + ([test_size + val_size] if val_size is not None else [])
    found: dict[tuple[Any, int], dict] = {}
    for r in select_ranks(rows, groups, ["_h", "_id"], hex_key("_h", near), ranks):
        key = r.group if within else (None, *r.group)
        found.setdefault(key, {"n": r.n})[r.tag] = r.value
    return {key: Cut(c["n"], c[TEST], c.get(VAL)) for key, c in sorted(found.items(), key=lambda kv: str(kv[0]))}


def _literal(value: Any) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(int(value)) + "L"


def _cut_array(cuts: Sequence[tuple[int, Cut]]) -> Column:
    """``array<struct<seed, test struct<h, id>[, val struct<h, id>]>>`` of literals."""

    def place(pair: tuple[str, Any]) -> str:
        return f"named_struct('h', {_literal(pair[0])}, 'id', {_literal(pair[1])})"

    def entry(seed: int, cut: Cut) -> str:
        val = "" if cut.val is None else f", 'val', {place(cut.val)}"
        return f"named_struct('seed', {seed}, 'test', {place(cut.test)}{val})"

    return F.expr("array(" + ", ".join(entry(seed, cut) for seed, cut in cuts) + ")")


def _part(place: Column, test: Column, val: Column | None, values: tuple[Any, Any, Any] = (TRAIN, VAL, TEST)) -> Column:
    # (digest, id) is compared as one value, so the digest is computed once per row
    in_train, in_val, in_test = values
    part = F.when(place <= test, in_test)
    if val is not None:
        part = part.when(place <= val, in_val)
    return part.otherwise(in_train)


def _place(seed: Column | int, id_col: str, digest: str) -> Column:
    sample_id = F.col(id_col)
    return F.struct(split_digest(seed, sample_id, digest).alias("h"), sample_id.alias("id"))


def part_of(
    cut: Cut, seed: int, id_col: str = "sample_id", digest: str = "md5", values: tuple[Any, Any, Any] = (TRAIN, VAL, TEST)
) -> Column:
    """TRAIN / VAL / TEST of a row in one run, from literals, or the value given for each."""

    def lit(pair: tuple[str, Any]) -> Column:
        return F.struct(F.lit(pair[0]).alias("h"), F.expr(_literal(pair[1])).alias("id"))

    return _part(_place(seed, id_col, digest), lit(cut.test), lit(cut.val) if cut.val else None, values)


def assign_splits(
    df: DataFrame,
    cuts: Cuts,
    *,
    id_col: str = "sample_id",
    within: str | None = None,
    digest: str = "md5",
) -> DataFrame:
    """Rows x seeds with ``seed`` and ``split`` (narrow)."""
    subsets: dict[Any, list[tuple[int, Cut]]] = {}
    for (subset, seed), cut in cuts.items():
        subsets.setdefault(subset, []).append((seed, cut))
    if within is None:
        arrays = _cut_array(subsets[None])
    else:
        arrays = None
        for subset, listed in subsets.items():
            hit = F.col(within) == F.lit(subset)
            arrays = F.when(hit, _cut_array(listed)) if arrays is None else arrays.when(hit, _cut_array(listed))
    with_val = any(cut.val is not None for cut in cuts.values())
    rows = df.withColumn("_cut", F.explode(arrays)).withColumn("seed", F.col("_cut.seed"))
    part = _part(_place(F.col("seed"), id_col, digest), F.col("_cut.test"), F.col("_cut.val") if with_val else None)
    return rows.withColumn("split", part).drop("_cut")


def split_array(df: DataFrame, cuts: Cuts, *, id_col: str = "sample_id", digest: str = "md5") -> DataFrame:
    """One row per sample with ``splits array<struct<seed, split>>`` instead of a row per seed."""
    with_val = any(cut.val is not None for cut in cuts.values())

    def entry(cut: Column) -> Column:
        part = _part(_place(cut["seed"], id_col, digest), cut["test"], cut["val"] if with_val else None)
        return F.struct(cut["seed"].alias("seed"), part.alias("split"))

    listed = _cut_array([(seed, cut) for (_, seed), cut in cuts.items()])
    return df.withColumn("splits", F.transform(listed, entry))


def repeated_split(
    df: DataFrame,
    seeds: Sequence[int],
    test_size: float,
    val_size: float | None = None,
    *,
    id_col: str = "sample_id",
    within: str | None = None,
    digest: str = "md5",
) -> DataFrame:
    """``find_cuts`` and ``assign_splits`` in one call."""
    cuts = find_cuts(df, seeds, test_size, val_size, id_col=id_col, within=within, digest=digest)
    return assign_splits(df, cuts, id_col=id_col, within=within, digest=digest)


def bernoulli_split(
    df: DataFrame, seeds: Sequence[int], test_size: float, *, id_col: str = "sample_id"
) -> DataFrame:
    """Approximate-size split in one narrow pass: digest prefix below a threshold."""
    limit = f"{min(int(test_size * 0x100000000), 0xFFFFFFFF):08x}"
    rows = fan_out(df, seeds)
    prefix = F.substring(split_digest(F.col("seed"), F.col(id_col)), 1, 8)
    return rows.withColumn("split", F.when(prefix < F.lit(limit), F.lit(TEST)).otherwise(F.lit(TRAIN)))


def split_sizes(splits: DataFrame, groups: Sequence[str] = ("seed",)) -> DataFrame:
    """``n_train, n_val, n_test`` per run."""
    return splits.groupBy(*groups).agg(
        *[F.count_if(F.col("split") == part).alias(f"n_{part}") for part in (TRAIN, VAL, TEST)]
    )
